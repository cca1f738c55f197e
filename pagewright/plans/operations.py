"""Queries over relations, continued: exports, caches, feeds, crawls of stored pages, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, pages, urls
from ..operators import crawl, jobs, leads, places
from ..sources import sinks
from .registry import query, rows, table
from .tables import _JOBS

_ENTRIES = """SELECT c_custkey AS input_id, c_name AS title, c_mktsegment AS category, array(c_mktsegment, 'Store') AS categories, c_acctbal AS review_rating, CAST(c_custkey % 90 AS DOUBLE) + 0.5 AS latitude,
  CASE c_custkey % 4 WHEN 0 THEN 'https://instagram.com/c' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://facebook.com/x' WHEN 2 THEN ' https://c.example/ ' ELSE NULL END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN array('a@x.com', 'b@x.com') ELSE array() END AS emails FROM customer"""


@query("""SELECT c_custkey::VARCHAR AS input_id, c_name AS title, c_mktsegment || ', Store' AS categories, printf('%.6f', c_acctbal::DOUBLE) AS review_rating, printf('%.6f', (c_custkey % 90 + 0.5)::DOUBLE) AS latitude,
  CASE WHEN c_custkey % 4 = 2 THEN 'https://c.example/' ELSE '' END AS website, CASE WHEN c_custkey % 4 = 0 THEN 'https://instagram.com/c' || c_custkey ELSE '' END AS instagram,
  CASE WHEN c_custkey % 3 = 0 THEN 'a@x.com, b@x.com' ELSE '' END AS emails, '' AS cid, 38 AS columns FROM customer""")
def export_rows(spark, sf_dir):
    out = leads.export_rows(rows(spark, sf_dir, _ENTRIES).withColumn("review_rating", F.col("review_rating").cast("double")))
    return out.select("input_id", "title", "categories", "review_rating", "latitude", "website", "instagram", "emails", "cid", F.lit(len(out.columns)).alias("columns"))


_RESULTS = """SELECT c_custkey, c_name AS title, '["' || c_mktsegment || '","Store","Café"]' AS categories, '' AS category, '' AS address,
  '{"street":"Rua ' || CAST(c_custkey % 9 AS STRING) || '","borough":"Centro","city":"Goiânia","state":"GO","postal_code":"74000-000","country":"BR"}' AS complete_address,
  CASE c_custkey % 3 WHEN 0 THEN '=1+1' ELSE '+55 62 99999-9999' END AS phone, CASE c_custkey % 2 WHEN 0 THEN 'https://instagram.com/p' ELSE 'firm.example' END AS website, 'a@x.com, b@x.com' AS emails,
  '4.' || CAST(c_custkey % 10 AS STRING) AS review_rating, CAST(c_custkey AS STRING) AS review_count, '{"Monday":["9-12","13-18"]}' AS open_hours, 'Owner' AS owner, '-16.5' AS latitude, '' AS longitude FROM customer"""


@query("""SELECT c_name AS "Nome", c_mktsegment AS "Categoria principal", 'Store | Café' AS "Outras categorias", 'Rua ' || (c_custkey % 9) || ', Centro, Goiânia, GO, 74000-000, BR' AS "Endereço", 'Goiânia' AS "Cidade",
  CASE c_custkey % 3 WHEN 0 THEN '''=1+1' ELSE '''+55 62 99999-9999' END AS "Telefone", CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'https://firm.example' END AS "Site", CASE c_custkey % 2 WHEN 0 THEN 'https://instagram.com/p' ELSE '' END AS "Instagram",
  '4,' || (c_custkey % 10) AS "Avaliação", c_custkey::VARCHAR AS "Quantidade de avaliações", '''-16,5' AS "Latitude", '' AS "Longitude", 22 AS columns FROM customer""")
def friendly_rows(spark, sf_dir):
    out = leads.friendly_rows(rows(spark, sf_dir, _RESULTS))
    names = ["Nome", "Categoria principal", "Outras categorias", "Endereço", "Cidade", "Telefone", "Site", "Instagram", "Avaliação", "Quantidade de avaliações", "Latitude", "Longitude"]
    return out.select(*[F.col(f"`{n}`") for n in names], F.lit(len(out.columns)).alias("columns"))


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND user_id = 7 ORDER BY event_id")
def event_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("job_id", F.col("user_id"))
    last = e.agg((F.max("event_id") / 2).cast("long")).first()[0] or 0
    return jobs.events_since(e, last, 7).select("event_id", "event_type")


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"SELECT user_id AS key, max(ts) AS cached_at FROM events WHERE event_type = 'view' GROUP BY 1 HAVING max(ts) > {_NOW} - INTERVAL 24 HOUR")
def cache_purge(spark, sf_dir):
    writes = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), "event_id")
    return crawl.cache_purged(crawl.cache_merged(writes.limit(0), writes), F.expr(_NOW)).select("key", "cached_at")


@query("SELECT count(DISTINCT user_id) AS entries FROM events WHERE event_type = 'view'")
def cache_count(spark, sf_dir):
    writes = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), "event_id")
    return crawl.cache_size(crawl.cache_merged(writes.limit(0), writes))


@query("SELECT user_id, event_type, count(*) AS waiting FROM events GROUP BY ALL")
def request_coalesce(spark, sf_dir):
    return jobs.coalesced(table(spark, sf_dir, "events"), ["user_id", "event_type"])


_EXTRACTED = "SELECT page_id, url, html, CASE WHEN page_id % 9 = 0 THEN 'HTTP 404' END AS error, length(html) AS char_count, CAST(ceil(length(html) / 4.0) AS BIGINT) AS estimated_tokens FROM pages"


@query(f"SELECT count(*) AS urls, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, coalesce(sum(char_count) FILTER (error IS NULL), 0)::BIGINT AS chars, coalesce(sum(estimated_tokens) FILTER (error IS NULL), 0)::BIGINT AS tokens FROM ({_EXTRACTED})")
def batch_totals(spark, sf_dir):
    return crawl.batch_totals(rows(spark, sf_dir, _EXTRACTED))


@query("SELECT page_id, page_id % 4 <> 0 AND length(regexp_replace(html, '\\s+', '', 'g')) >= 100 AS ok FROM pages")
def bench_success(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", jobs.bench_worked(F.when(F.col("page_id") % 4 == 0, 404).otherwise(200), F.col("html")).alias("ok"))


@query("SELECT event_id, n_name AS name FROM events JOIN nation ON user_id = n_nationkey")
def bench_site_join(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("site_id"))
    return jobs.bench_sites(runs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("name"))).select("event_id", "name")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE status = 'running'")
def jobs_of_status(spark, sf_dir):
    return jobs.with_status(rows(spark, sf_dir, _JOBS), "running").select("job_id")


_LINKS = """SELECT CAST(c_custkey AS BIGINT) AS id, 'https://' || CASE WHEN c_custkey % 11 = 0 THEN 'b' ELSE 'a' END || '.example/' || CASE WHEN c_custkey % 7 = 0 THEN 'private/' ELSE 'p/' END || CAST(c_custkey AS STRING) AS url,
  CASE WHEN c_custkey % 5 = 0 THEN 'HTTP 500' END AS error FROM customer"""
_MOST = "(SELECT max(c_custkey) FROM customer)"


@query(f"""WITH RECURSIVE p AS ({_LINKS}), l AS (
  SELECT s.url AS src, d.url AS dst FROM p s JOIN p d ON d.id IN (s.id * 2 % {_MOST} + 1, s.id * 3 % {_MOST} + 1) WHERE s.error IS NULL
), walk(url, depth) AS (
  SELECT 'https://a.example/p/1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN l ON walk.url = src WHERE depth < 4 AND starts_with(dst, 'https://a.example/') AND NOT contains(dst, '/private/')
)
SELECT p.url, min(depth)::INTEGER AS depth, error FROM walk JOIN p USING (url) GROUP BY ALL ORDER BY depth, url LIMIT 60""")
def crawl_site(spark, sf_dir):
    p = rows(spark, sf_dir, _LINKS)
    most = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 1
    s, d = p.select("id", F.col("url").alias("src")), p.select(F.col("id").alias("to"), F.col("url").alias("dst"))
    edges = s.select("src", F.explode(F.array(F.col("id") * 2 % most + 1, F.col("id") * 3 % most + 1)).alias("to")).join(d, "to").select("src", "dst")
    text = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private/\n")], "host string, body string")
    return crawl.crawl_site(p.select("url", "error"), edges, "https://a.example/p/1", crawl.robots_rules(text, "OurBot"), 4, 60).select("url", "depth", "error")


_FOUND = "SELECT event_id, 'h' || CAST(user_id % 40 AS STRING) AS host, '/p' || CAST(event_id % 300 AS STRING) AS url, CAST(event_id AS INT) AS place, event_type FROM events"


@query(f"""WITH s AS (SELECT * FROM ({_FOUND}) WHERE event_type = 'purchase'), c AS (SELECT host, count(*) AS n FROM s GROUP BY 1),
  b AS (SELECT host, url, place, 0 AS rank, 'sitemap' AS source FROM s UNION ALL SELECT f.host, f.url, f.place, 1, 'html_link' FROM ({_FOUND}) f LEFT JOIN c USING (host) WHERE event_type = 'click' AND coalesce(n, 0) < 10)
SELECT host, url, arg_min(source, (rank, place)) AS source FROM b GROUP BY ALL""")
def site_map(spark, sf_dir):
    f = rows(spark, sf_dir, _FOUND)
    pick = lambda kind: f.where(F.col("event_type") == kind).select("host", "url", "place")
    return crawl.site_map(pick("purchase"), pick("click")).select("host", "url", "source")


@query(f"SELECT host, arg_min(url, place) AS url FROM ({_FOUND}) GROUP BY host")
def first_wins(spark, sf_dir):
    return crawl.first_wins(rows(spark, sf_dir, _FOUND), ["host"], ["place"]).select("host", "url")


@query(f"SELECT count(*) AS pages, count(*) FILTER (error IS NULL) AS succeeded, sum(char_count)::BIGINT AS chars, sum(estimated_tokens)::BIGINT AS tokens, max(page_id % 5)::INTEGER AS deepest FROM ({_EXTRACTED})")
def crawl_totals(spark, sf_dir):
    out = crawl.crawl_summary(rows(spark, sf_dir, _EXTRACTED).withColumn("depth", (F.col("page_id") % 5).cast("int")))
    return out.select("pages", "succeeded", F.col("chars").cast("long").alias("chars"), F.col("tokens").cast("long").alias("tokens"), "deepest")


_OPTIONS = "SELECT user_id AS entry_id, 'about' || CAST(user_id % 3 AS STRING) AS about_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name, event_id % 4 = 0 AS enabled, array(event_type, 'x' || CAST(event_id % 3 AS STRING)) AS values FROM events"


@query("SELECT user_id AS entry_id, 'about' || (user_id % 3) AS about_id, event_type AS name, bool_or(event_id % 4 = 0) AS enabled, list_sort(list_distinct(flatten(list([event_type, 'x' || (event_id % 3)])))) AS values FROM events WHERE event_type <> 'error' GROUP BY ALL")
def options_merge(spark, sf_dir):
    return places.options_merged(rows(spark, sf_dir, _OPTIONS))


_REVIEWS = "SELECT c_custkey AS lead_id, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN array('no website', 'weak seo') WHEN 1 THEN array('no whatsapp') ELSE array('unknown') END AS weaknesses FROM customer"


@query("SELECT count(*) AS leads, 0.0::DOUBLE AS average_slop, TRUE AS all_passed FROM customer WHERE c_custkey % 3 <> 2")
def growth_plan(spark, sf_dir):
    return leads.plan_totals(leads.growth_plan(rows(spark, sf_dir, _REVIEWS)))


_CRM = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS title, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS category, array('a@x.com', 'b@x.com', 'c' || CAST(c_custkey AS STRING)) AS emails, '' AS phone, '' AS website FROM customer"


@query("SELECT count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS accepted, count(*) FILTER (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS rejected FROM customer")
def crm_totals(spark, sf_dir):
    """Rows that a CRM takes, and those that are refused: the writer here refuses none of the good ones."""
    good, bad = leads.crm_split(rows(spark, sf_dir, _CRM))
    refused = sinks.written_in_batches(good, lambda batch: None).unionByName(bad.select(F.to_json(F.struct("title", "category")).alias("value"), "reason"))
    return sinks.write_totals(good.select("title").unionByName(bad.select("title")), refused)


@query("SELECT c_custkey, 'a@x.com' AS email, ['b@x.com', 'c' || c_custkey] AS other_emails FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def crm_rows(spark, sf_dir):
    good, _ = leads.crm_split(rows(spark, sf_dir, _CRM))
    return good.select(F.regexp_extract(F.element_at("other_emails", 2), "c(\\d+)", 1).cast("long").alias("c_custkey"), "email", "other_emails")


@query("SELECT page_id, 'Title: T' || page_id || chr(10) || chr(10) || 'URL Source: ' || url || chr(10) || chr(10) || 'Markdown Content:' || chr(10) || '# T' || page_id AS text FROM pages")
def reader_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", pages.reader_text(F.col("url"), F.concat(F.lit("# T"), F.col("page_id").cast("string"))).alias("text"))


@query("SELECT event_id, CASE WHEN t BETWEEN 1167609600000000 AND 1705276800000000 + 86400000000 THEN make_timestamp(t) END AS published FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN epoch_us(ts) WHEN user_id % 3 = 1 THEN 1 ELSE epoch_us(ts) * 2 END AS t FROM events)")
def published_at(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.when(F.col("user_id") % 3 == 1, 1).otherwise(us * 2))
    made = numbers.valid_published_at(first.cast("long"), us, F.expr(_NOW))
    return table(spark, sf_dir, "events").select("event_id", made.alias("published"))


_ASKED = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'ftp://files.example/' || CAST(page_id AS STRING) WHEN 2 THEN 'http://me:pw@site.example/' || CAST(page_id AS STRING) WHEN 3 THEN 'http://10.' || CAST(page_id % 256 AS STRING) || '.0.1/x' WHEN 4 THEN 'https://172.' || CAST(page_id % 256 AS STRING) || '.1.1/'
  WHEN 5 THEN 'https://n' || CAST(page_id AS STRING) || '.internal/' WHEN 6 THEN 'http://100.' || CAST(page_id % 256 AS STRING) || '.0.9/' ELSE '/only/a/path' END AS url FROM pages"""


@query(f"""SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'only http and https' WHEN 2 THEN 'credentials in URL' WHEN 3 THEN 'private or local host' WHEN 4 THEN CASE WHEN page_id % 256 BETWEEN 16 AND 31 THEN 'private or local host' END
  WHEN 5 THEN 'private or local host' WHEN 6 THEN CASE WHEN page_id % 256 BETWEEN 64 AND 127 THEN 'private or local host' END WHEN 7 THEN 'invalid URL' END AS problem FROM ({_ASKED})""")
def fetch_problems(spark, sf_dir):
    """Why a URL must not be fetched: schemes, credentials, private ranges by their bounds, hosts without one."""
    return rows(spark, sf_dir, _ASKED).select("page_id", urls.target_problem(F.col("url")).alias("problem"))


@query("SELECT page_id, url AS target FROM pages")
def fetch_targets(spark, sf_dir):
    """Every stored page may be fetched: none has credentials, another scheme or a private host."""
    return table(spark, sf_dir, "pages").where(urls.target_problem(F.col("url")).isNull()).select("page_id", F.col("url").alias("target"))


@query("""SELECT event_id, list_filter([
  CASE WHEN user_id % 3 = 0 THEN 'Revise termos, localização e profundidade antes de executar novamente.' END, CASE WHEN user_id % 5 = 0 THEN 'Há resultados parciais; aumente o tempo máximo ou reduza o escopo.' END,
  CASE WHEN user_id % 2 = 0 THEN 'Revise os e-mails enriquecidos antes de qualquer contato e respeite a legislação aplicável.' END,
  CASE WHEN event_type = 'purchase' AND user_id % 3 > 0 THEN 'Crie uma exportação filtrada para trabalhar apenas com os contatos relevantes.' END], lambda x: x IS NOT NULL) AS advice FROM events""")
def job_advice(spark, sf_dir):
    u = F.col("user_id")
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    return table(spark, sf_dir, "events").select("event_id", jobs.recommendations(status, u % 3, u % 5 == 0, u % 2 == 0).alias("advice"))
