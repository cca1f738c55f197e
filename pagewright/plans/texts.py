"""Queries over text: tokens, pages, URLs, addresses, numbers, intent, lint.

Few of the tables' texts hold emails, phones or sales talk, so inputs are composed from keys in SQL that both engines run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import email, intent, numbers, pages, phone, slop, urls
from .registry import query, rows, spread, table


@query("SELECT doc_id, length(text) AS chars, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), numbers.tokens(F.length("text")).alias("tokens"))


@query("SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY lang")
def token_totals_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(numbers.tokens(F.length("text"))).alias("tokens"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def title_from_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"))


_META = "SELECT page_id, '<META property=\"og:title\" content=\" T' || CAST(page_id AS STRING) || ' \"><meta name=''description'' content=''''><meta content=\"D' || CAST(page_id % 7 AS STRING) || '\" name=\"description\">' || html AS html FROM pages"


@query("SELECT page_id, 'T' || page_id AS og_title, 'D' || (page_id % 7) AS description FROM pages")
def meta_tag_values(spark, sf_dir):
    p = rows(spark, sf_dir, _META)
    return p.select("page_id", pages.meta_tag(F.col("html"), "og:title").alias("og_title"), pages.meta_tag(F.col("html"), "description").alias("description"))


_FETCHED = """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status,
  CASE event_type WHEN 'error' THEN '<title>Access Denied</title>' WHEN 'click' THEN '<p>Verify you are HUMAN</p>' WHEN 'view' THEN '<div class="g-recaptcha"></div>' ELSE '<title>Home</title>' END AS html FROM events"""


@query(f"""SELECT event_id, reason IS NOT NULL AS is_blocked, reason, CASE WHEN reason IS NOT NULL THEN status IN (429, 503) END AS retryable FROM (
  SELECT *, CASE WHEN status = 403 THEN 'HTTP Status 403 (Forbidden / Bot Blocked)' WHEN status = 429 THEN 'HTTP Status 429 (Rate Limited)' WHEN status = 503 THEN 'HTTP Status 503 (Service Unavailable)'
    WHEN contains(lower(html), 'verify you are human') THEN 'Anti-bot / CAPTCHA signature detected: "verify you are human"'
    WHEN contains(html, 'g-recaptcha') THEN 'Interactive CAPTCHA widget detected: "class="g-recaptcha""'
    WHEN contains(html, 'Access Denied') THEN 'Anti-bot challenge title detected: "Access Denied"' END AS reason FROM ({_FETCHED}))""")
def block_page_detect(spark, sf_dir):
    return rows(spark, sf_dir, _FETCHED).select("event_id", pages.blocked(F.col("status"), F.col("html")).alias("b")).select("event_id", "b.*")


_MESSAGES = """SELECT event_id, CASE user_id % 9 WHEN 0 THEN 'getaddrinfo ENOTFOUND host' WHEN 1 THEN 'Request timed out' WHEN 2 THEN 'HTTP 404: Not Found' WHEN 3 THEN 'ECONNRESET by peer' WHEN 4 THEN 'getaddrinfo EAI_AGAIN x'
  WHEN 5 THEN 'Anti-Bot protection triggered: HTTP Status 503' WHEN 6 THEN 'Target URL is invalid' WHEN 7 THEN 'PDF could not be parsed: timeout' ELSE 'strange ' || event_type END AS message FROM events"""


@query(f"""SELECT event_id, CASE WHEN contains(message, 'EAI_AGAIN') THEN 'connection_failed' WHEN starts_with(message, 'HTTP 4') THEN 'http_error' WHEN starts_with(message, 'PDF') THEN 'parse_error'
  WHEN contains(message, 'ENOTFOUND') THEN 'dead_domain' WHEN contains(message, 'Target URL') THEN 'invalid_input' WHEN contains(message, 'timed out') THEN 'timeout' WHEN contains(message, 'Anti-Bot') THEN 'anti_bot'
  WHEN contains(message, 'ECONNRESET') THEN 'connection_failed' ELSE 'error' END AS status, contains(message, '503') OR NOT (contains(message, 'HTTP 404') OR contains(message, 'PDF could')) AS retryable FROM ({_MESSAGES})""")
def failure_class(spark, sf_dir):
    m = F.col("message")
    return rows(spark, sf_dir, _MESSAGES).select("event_id", pages.failure(m).alias("status"), pages.retryable(m).alias("retryable"))


_CANONICAL = """CASE WHEN q = '' THEN base ELSE base || '?' || q END"""
_URL_PARTS = """SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS base,
  array_to_string(list_sort(list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_source='))), '&') AS q FROM pages"""


@query(f"SELECT page_id, {_CANONICAL} AS canonical FROM ({_URL_PARTS})")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, sha256('{{"url":"' || {_CANONICAL} || '","mode":"fast","cssSelector":"","pipelineVersion":"1","variant":null,"linkFormat":null,"imageMode":null}}') AS key FROM ({_URL_PARTS})""")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.cache_key(F.col("url")).alias("key"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '^www\\.', '') AS domain FROM pages")
def domain_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_key(F.col("url"), F.lit("x")).alias("domain"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '-')) || '.surrogate' AS domain FROM customer")
def domain_surrogate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", urls.domain_key(F.lit(None).cast("string"), F.col("c_name")).alias("domain"))


_OWN = "SELECT arg_min(regexp_extract(url, '://([^/]+)', 1), page_id) FROM pages WHERE contains(url, '/en/') AND NOT contains(url, 'utm_')"


@query(f"SELECT page_id, url FROM pages WHERE regexp_extract(url, '://([^/]+)', 1) = ({_OWN}) AND contains(url, '/en/') AND NOT contains(url, 'utm_')")
def host_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    own = p.where(F.contains("url", F.lit("/en/")) & ~F.contains("url", F.lit("utm_"))).agg(F.min_by(urls.host(F.col("url")), "page_id")).first()[0] or ""
    return p.where(urls.passes(F.col("url"), own, include=["/en/"], exclude=["utm_*"])).select("page_id", "url")


_DECORATED = "SELECT doc_id, text || ' mail ' || CASE doc_id % 3 WHEN 0 THEN 'Sales' || CAST(doc_id AS STRING) || '@Firm' || CAST(doc_id % 11 AS STRING) || '.com.br' WHEN 1 THEN 'user@example.com' ELSE 'logo@2x.png' END || ' end' AS text FROM documents"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[\\w.%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\\.[A-Za-z0-9-]{{1,63}})*\\.[A-Za-z]{{2,24}}'))::INTEGER AS found, CASE WHEN doc_id % 3 = 0 THEN ['sales' || doc_id || '@firm' || (doc_id % 11) || '.com.br'] ELSE []::VARCHAR[] END AS emails FROM ({_DECORATED})")
def email_scan(spark, sf_dir):
    d = rows(spark, sf_dir, _DECORATED)
    return d.select("doc_id", F.size(email.scan(F.col("text"))).alias("found"), email.clean_all(email.scan(F.col("text"))).alias("emails"))


_RAW_MAIL = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'mailto:Contato@Loja' || CAST(c_nationkey AS STRING) || '.com?subject=Oi' WHEN 1 THEN '<vendas.sp@firm' || CAST(c_custkey AS STRING) || '.com.br>.' WHEN 2 THEN 'user@firm.com' WHEN 3 THEN 'a..b@firm.com'
  WHEN 4 THEN 'maria@gmail.com' WHEN 5 THEN 'x@-firm.com' WHEN 6 THEN 'joao@sub.mailinator.com' ELSE 'icon@2x.retina.com' END AS raw FROM customer"""


@query(f"""SELECT c_custkey, email, CASE WHEN email IS NULL THEN NULL WHEN c_custkey % 8 IN (0, 1) THEN 'role' ELSE 'personal' END AS kind, email = 'maria@gmail.com' AS free_provider, email = 'joao@sub.mailinator.com' AS disposable FROM (
  SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'contato@loja' || c_nationkey || '.com' WHEN 1 THEN 'vendas.sp@firm' || c_custkey || '.com.br' WHEN 4 THEN 'maria@gmail.com' WHEN 6 THEN 'joao@sub.mailinator.com' END AS email FROM customer)""")
def email_clean(spark, sf_dir):
    e = rows(spark, sf_dir, _RAW_MAIL).select("c_custkey", email.clean(F.col("raw")).alias("email"))
    known = F.col("email").isNotNull()
    info = email.analyse(F.col("email"))
    return e.select("c_custkey", "email", F.when(known, info["kind"]).alias("kind"), F.when(known, info["free_provider"]).alias("free_provider"), F.when(known, info["disposable"]).alias("disposable"))


_HIDDEN_MAIL = "SELECT c_custkey, 'write vendas (arroba) loja' || CAST(c_custkey AS STRING) || ' (ponto) com (ponto) br or nome' || CAST(c_nationkey AS STRING) || ' @ firm.org today' AS text FROM customer"


@query("SELECT c_custkey, ['vendas@loja' || c_custkey || '.com.br', 'nome' || c_nationkey || '@firm.org'] AS emails FROM customer")
def email_deobfuscate(spark, sf_dir):
    return rows(spark, sf_dir, _HIDDEN_MAIL).select("c_custkey", email.find(F.col("text")).alias("emails"))


_PHONES = """SELECT id, c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(62) 99' || lpad(CAST(c_custkey AS STRING), 3, '0') || '-4321' WHEN 1 THEN '+55 (11) 3' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-4444'
  WHEN 2 THEN '(62) 8' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-9999' WHEN 3 THEN '2019-2026' WHEN 4 THEN '(20) 99' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-5432' ELSE '12.345.678/0001-95' END AS raw FROM (SELECT c_custkey AS id, c_custkey % 1000 AS c_custkey FROM customer)"""


@query("""SELECT id, CASE c_custkey % 6 WHEN 0 THEN '+556299' || k || '4321' WHEN 1 THEN '+55113' || k || '4444' WHEN 2 THEN '+556298' || k || '9999' WHEN 4 THEN '+552099' || k || '5432' END AS e164,
  CASE c_custkey % 6 WHEN 0 THEN 'mobile' WHEN 1 THEN 'fixed' WHEN 2 THEN 'mobile' WHEN 4 THEN 'unknown' END AS type, CASE c_custkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 4 THEN FALSE END AS valid
  FROM (SELECT c_custkey AS id, c_custkey % 1000 AS c_custkey, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS k FROM customer)""")
def phone_normalise(spark, sf_dir):
    p = phone.normalise(F.col("raw"))
    return rows(spark, sf_dir, _PHONES).select("id", p["e164"].alias("e164"), p["type"].alias("type"), p["valid"].alias("valid"))


_BASES = "SELECT o_orderkey, lpad(CAST(o_orderkey % 999999999 AS STRING), 9, '0') AS cpf, lpad(CAST(o_orderkey AS STRING), 8, '0') || '0001' AS cnpj FROM orders"
_DIGIT = "CAST(substr({c}, {i}, 1) AS INTEGER)"


def _sum(column: str, weights: list[int]) -> str:
    return " + ".join(f"{_DIGIT.format(c=column, i=i + 1)} * {w}" for i, w in enumerate(weights))


_CPF_SQL = f"""SELECT o_orderkey, cpf, d1, ((({_sum("cpf", list(range(11, 2, -1)))} + d1 * 2) * 10) % 11) % 10 AS d2 FROM (SELECT *, ((({_sum("cpf", list(range(10, 1, -1)))}) * 10) % 11) % 10 AS d1 FROM ({_BASES}))"""


@query(f"SELECT o_orderkey, NOT regexp_matches(cpf, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') OR NOT cpf || d1 || d2 = repeat(left(cpf, 1), 11) AS valid, FALSE AS broken FROM ({_CPF_SQL})")
def cpf_check(spark, sf_dir):
    made = rows(spark, sf_dir, _CPF_SQL)
    whole = F.concat("cpf", F.col("d1").cast("string"), F.col("d2").cast("string"))
    other = F.concat("cpf", ((F.col("d1") + 1) % 10).cast("string"), F.col("d2").cast("string"))
    return made.select("o_orderkey", phone.valid_cpf(whole).alias("valid"), phone.valid_cpf(other).alias("broken"))


_W1, _W2 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3]


@query(f"""SELECT o_orderkey, CASE WHEN cnpj = '000000000000' THEN NULL ELSE d1::VARCHAR || (CASE WHEN s2 % 11 < 2 THEN 0 ELSE 11 - s2 % 11 END)::VARCHAR END AS digits,
  left(cnpj, 2) || '.' || substr(cnpj, 3, 3) || '.' || substr(cnpj, 6, 3) || '/0001-95' AS formatted FROM (
  SELECT *, {_sum("cnpj", _W2)} + d1 * 2 AS s2 FROM (SELECT *, CASE WHEN ({_sum("cnpj", _W1)}) % 11 < 2 THEN 0 ELSE 11 - ({_sum("cnpj", _W1)}) % 11 END AS d1 FROM ({_BASES})))""")
def cnpj_check_digits(spark, sf_dir):
    return rows(spark, sf_dir, _BASES).select("o_orderkey", phone.cnpj_check_digits(F.col("cnpj")).alias("digits"), phone.cnpj_formatted(F.concat("cnpj", F.lit("95"))).alias("formatted"))


_NUMBERS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS STRING) || '.5K' WHEN 1 THEN CAST(p_partkey AS STRING) || ',2 mil' WHEN 2 THEN '1.' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') WHEN 3 THEN CAST(p_partkey AS STRING) || ' milhões' WHEN 4 THEN 'none' ELSE CAST(p_partkey AS STRING) || '.6' END AS raw FROM part"""


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey * 1000 + 500 WHEN 1 THEN p_partkey * 1000 + 200 WHEN 2 THEN 1000 + p_partkey % 1000 WHEN 3 THEN p_partkey * 1000000 WHEN 5 THEN p_partkey + 1 END::BIGINT AS n FROM part")
def shorthand_number(spark, sf_dir):
    return rows(spark, sf_dir, _NUMBERS).select("p_partkey", numbers.shorthand(F.col("raw")).alias("n"))


_CELLS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=SUM(A' || CAST(c_custkey AS STRING) || ')' WHEN 1 THEN '  +1' WHEN 2 THEN 'plain, \"' || c_name || '\"' WHEN 3 THEN NULL ELSE '-16.68' END AS cell FROM customer"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 4) THEN '''' || cell ELSE coalesce(cell, '') END AS safe, CASE WHEN c_custkey % 5 = 2 THEN '\"' || replace(cell, '\"', '\"\"') || '\"' WHEN c_custkey % 5 = 3 THEN '' ELSE '''' || cell END AS field FROM ({_CELLS})")
def csv_safe_cell(spark, sf_dir):
    c = pages.safe_cell(F.col("cell"))
    return rows(spark, sf_dir, _CELLS).select("c_custkey", c.alias("safe"), pages.csv_field(c).alias("field"))


_LISTS = "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN '[\"a' || CAST(c_nationkey AS STRING) || '\", \"b\", \"b\", \"\"]' ELSE ' x' || CAST(c_nationkey AS STRING) || ' , y,,y ' END AS raw FROM customer"


@query("SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN ['a' || c_nationkey, 'b'] ELSE ['x' || c_nationkey, 'y'] END AS items FROM customer")
def list_parse(spark, sf_dir):
    return rows(spark, sf_dir, _LISTS).select("c_custkey", numbers.parse_list(F.col("raw")).alias("items"))


_MAPS = "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://maps.example.com/place/x/@1.5,2.5,17z/data=!3d-' || CAST(s_suppkey % 90 AS STRING) || '.25!4d' || CAST(s_nationkey AS STRING) || '.5' WHEN 1 THEN 'https://maps.example.com/@' || CAST(s_suppkey % 90 AS STRING) || '.125,-' || CAST(s_nationkey AS STRING) || '.75,15z' ELSE 'https://maps.example.com/' END AS url FROM supplier"


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN -(s_suppkey % 90 + 0.25) WHEN 1 THEN s_suppkey % 90 + 0.125 END::DOUBLE AS lat, CASE s_suppkey % 3 WHEN 0 THEN s_nationkey + 0.5 WHEN 1 THEN -(s_nationkey + 0.75) END::DOUBLE AS lon FROM supplier")
def coords_from_url(spark, sf_dir):
    c = urls.coordinates(F.col("url"))
    return rows(spark, sf_dir, _MAPS).select("s_suppkey", c["lat"].alias("lat"), c["lon"].alias("lon"))


@query("SELECT o_orderkey, (SELECT list_reduce([0::HUGEINT] || list_transform(range(1, length(c) + 1), lambda i: (instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', substr(c, i::INTEGER, 1)) - 1)::HUGEINT), lambda a, d: a * 64 + d))::VARCHAR AS pk FROM (SELECT o_orderkey, 'Cx' || o_orderkey || '_-' AS c FROM orders)")
def shortcode_pk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", urls.shortcode_to_pk(F.concat(F.lit("Cx"), F.col("o_orderkey").cast("string"), F.lit("_-"))).alias("pk"))


_IPS = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10.' || CAST(c_custkey % 256 AS STRING) || '.0.1' WHEN 1 THEN '172.' || CAST(c_custkey % 40 AS STRING) || '.3.4' WHEN 2 THEN '8.8.' || CAST(c_custkey % 300 AS STRING) || '.8' ELSE 'no.ip' END AS ip FROM customer"


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN c_custkey % 40 BETWEEN 16 AND 31 WHEN 2 THEN CASE WHEN c_custkey % 300 <= 255 THEN FALSE END END AS private FROM customer")
def ip_private_v4(spark, sf_dir):
    return rows(spark, sf_dir, _IPS).select("c_custkey", urls.ipv4_private(F.col("ip")).alias("private"))


_PHRASES = """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Looking for a laptop, budget of $' || CAST(1000 + user_id AS STRING) WHEN 'signup' THEN 'still available?' WHEN 'view' THEN 'Office chairs for sale'
  WHEN 'click' THEN 'Procuro carro em Porto Alegre, pago até ' || CAST(user_id % 90 AS STRING) || ' mil' ELSE 'hiring: looking for a cook ' || CAST(user_id AS STRING) END AS text FROM events"""
_INTENT = f"""SELECT event_id, kind, kind IN ('buyer', 'price_question') AS is_lead, CASE kind WHEN 'buyer' THEN 75 + CASE WHEN region IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN budget > 0 THEN 10 ELSE 0 END WHEN 'price_question' THEN 50 ELSE 0 END AS score, region, budget FROM (
  SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buyer' WHEN 'signup' THEN 'price_question' WHEN 'view' THEN 'seller' WHEN 'click' THEN 'buyer' ELSE 'none' END AS kind,
    CASE WHEN event_type = 'click' THEN 'porto alegre' END AS region, CASE event_type WHEN 'purchase' THEN 1000 + user_id WHEN 'click' THEN user_id % 90 * 1000 END::DOUBLE AS budget FROM events)"""


@query(_INTENT)
def intent_score(spark, sf_dir):
    s = intent.score(F.col("text"), regions=["Porto", "Porto Alegre"])
    return rows(spark, sf_dir, _PHRASES).select("event_id", s.alias("i")).select("event_id", "i.kind", "i.is_lead", "i.score", "i.region", "i.budget")


@query(f"SELECT event_id, score FROM ({_INTENT}) WHERE is_lead ORDER BY score DESC, event_id LIMIT 25")
def intent_leads_topk(spark, sf_dir):
    s = intent.score(F.col("text"), regions=["Porto", "Porto Alegre"])
    return rows(spark, sf_dir, _PHRASES).select("event_id", s["score"].alias("score"), s["is_lead"].alias("is_lead")).where("is_lead").orderBy(F.col("score").desc(), "event_id").limit(25).select("event_id", "score")


_FORUM = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Please RECOMMEND one with no issue' WHEN 1 THEN 'It is broken, hire me' WHEN 2 THEN 'A quote for it' ELSE 'Hello' END AS title, text FROM documents"
_ANY = " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in words)} THEN '{name}'" for name, words in pages.FORUM.items())


@query(f"SELECT doc_id, CASE {_ANY} ELSE 'general_discussion' END AS category FROM (SELECT doc_id, lower(title || ' ' || coalesce(text, '')) AS t FROM ({_FORUM}))")
def forum_category(spark, sf_dir):
    return rows(spark, sf_dir, _FORUM).select("doc_id", pages.forum_category(F.col("title"), F.col("text")).alias("category"))


_COPY = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'We delve into the tapestry of game-changer ideas. ' WHEN 1 THEN 'Furthermore, 20% more in 30 dias. ' WHEN 2 THEN 'It''s not just about price, it''s about trust. '
  WHEN 3 THEN 'No cenário atual, é importante notar que a sinergia de ponta é um método revolucionário. ' ELSE '' END || text AS text FROM documents"""
_BLANK = r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _matches(pattern: str) -> str:
    """The number of a rule's matches by DuckDB's own engine, whose word edges are those of ECMAScript."""
    own = pattern.replace(r"[-\s]", f"[-{_BLANK[1:]}").replace(r"\s", _BLANK).replace(r"(?<![\p{L}\d])", r"(?:^|[^\p{L}\d])").replace("'", "''")
    return f"len(regexp_extract_all(text, '(?i){own}'))"


_BANNED, _ANTITHESES = (" + ".join(_matches(p) for p, kind, *_ in slop.rules() if kind == k) for k in ("banned_word", "false_antithesis"))


@query(f"""SELECT doc_id, banned::INTEGER AS banned, antitheses::INTEGER AS antitheses, numbers::INTEGER AS numbers, words::INTEGER AS words, (banned + antitheses + decorated + hollow)::INTEGER AS violations,
  least(100, greatest(0, banned * 25 + antitheses * 30 + decorated * 15 + hollow * 20 - least(20, 5 * numbers)))::INTEGER AS score FROM (
  SELECT *, (words > 20 AND emoji > ceil(words / 25.0))::INTEGER AS decorated, (words > 80 AND numbers = 0)::INTEGER AS hollow FROM (
  SELECT doc_id, {_BANNED} AS banned, {_ANTITHESES} AS antitheses, {_matches(slop.NUMBERS)} AS numbers, len(regexp_extract_all(text, '{slop.EMOJI}')) AS emoji,
    len(list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda w: w <> '')) AS words FROM ({_COPY})))""")
def slop_score(spark, sf_dir):
    return spread(rows(spark, sf_dir, _COPY)).select("doc_id", slop.lint(F.col("text")).alias("l")).select("doc_id", "l.banned", "l.antitheses", "l.numbers", "l.words", "l.violations", "l.score")


@query("""SELECT doc_id, words, greatest(1, sentences)::INTEGER AS sentences, floor(words / greatest(1, sentences)::DOUBLE + 0.5)::INTEGER AS average FROM (
  SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+'), lambda w: w <> ''))::INTEGER AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(trim(s, ' \t\n\r')) > 5)) AS sentences FROM documents)""")
def slop_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", slop.metrics(F.col("text")).alias("l")).select("doc_id", "l.words", "l.sentences", "l.average")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'um método eficiente ' || doc_id || '.' WHEN 1 THEN 'We analisar topic ' || doc_id ELSE 'plain ' || doc_id END AS cleaned FROM documents")
def sanitise_copy(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("No cenário atual, um método revolucionário "), k, F.lit("."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("We delve into topic "), k)).otherwise(F.concat(F.lit("plain "), k))
    return table(spark, sf_dir, "documents").select("doc_id", slop.sanitised(t).alias("cleaned"))


@query("SELECT doc_id, ['https://a.example/' || doc_id, '/b', 'https://c.example/x'] AS links, 'Head ' || doc_id AS title FROM documents")
def markdown_links(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    md = F.concat(F.lit("intro\n# Head "), k, F.lit("\n[a](https://a.example/"), k, F.lit(') and [b](</b> "t")\n\n[1]: https://c.example/x\n'))
    return table(spark, sf_dir, "documents").select("doc_id", pages.markdown_links(md).alias("links"), pages.markdown_title(md).alias("title"))


@query("SELECT c_custkey, 'Authorization: Bearer [redacted] for [redacted] at https://[redacted]@h.example/?token=[redacted]&n=' || c_custkey AS text FROM customer")
def redact_secrets(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("Authorization: Bearer abc."), k, F.lit(" for me"), k, F.lit("@mail.com at https://u:p@h.example/?token=x"), k, F.lit("&n="), k)
    return table(spark, sf_dir, "customer").select("c_custkey", pages.redacted(t).alias("text"))


@query("SELECT o_orderkey, (n * d * 3 + CASE WHEN e THEN n ELSE 0 END)::BIGINT AS requests, greatest(1, ceil((n * d * 3 + CASE WHEN e THEN n ELSE 0 END) / 30.0))::BIGINT AS minutes FROM (SELECT o_orderkey, o_orderkey % 50 + 1 AS n, greatest(1, o_orderkey % 4) AS d, o_orderkey % 2 = 0 AS e FROM orders)")
def work_estimate(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.work_estimate(k % 50 + 1, k % 4, k % 2 == 0).alias("w")).select("o_orderkey", "w.requests", "w.minutes")


@query("SELECT c_custkey, 'vendas' || (c_custkey % 10) || '@firm.com' AS email FROM customer")
def protected_email(spark, sf_dir):
    """Encoded by XOR with the key 0x2a in the query's own input, decoded by the operator."""
    plain = F.concat(F.lit("vendas"), (F.col("c_custkey") % 10).cast("string"), F.lit("@firm.com"))
    coded = F.array_join(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.lit(42))), 2, "0"))), "")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", email.decode_protected(F.concat(F.lit("2a"), coded)).alias("email"))
