"""Queries over contacts of pages, contact pages, chat links and drafts, composed from the rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phone
from ..operators import crawl, leads
from .registry import query, rows, spread

#: Every page with links of its own: a mail link, a protected address (key 00), two phone links, and a chat link to the second.
_SITES = """SELECT page_id, url, html, lpad(CAST(page_id % 10000 AS STRING), 4, '0') AS few, lpad(CAST(page_id * 7919 % 100000000 AS STRING), 8, '0') AS many FROM pages"""
_LINKED = f"""SELECT page_id AS site, url, 0 AS page_rank, '<html><body><p>Talk to us</p><a href="mailto:info' || CAST(page_id AS STRING) || '@loja' || CAST(page_id % 9 AS STRING) || '.com.br?subject=x">mail</a><a href="/cdn-cgi/l/email-protection#00' || hex('team' || CAST(page_id AS STRING) || '@firma.com.br') || '">shown</a><a href="tel:+55 62 1234-' || few
  || '">desk</a><a href="TEL:(62) 9' || many || '">cell</a><a href="https://wa.me/55629' || many || '?text=hi">chat</a>' || CASE WHEN page_id % 4 = 0 THEN '<p>Or write to sales [at] loja' || CAST(page_id % 9 AS STRING) || '.com.br</p>' ELSE '' END || '</body></html>' AS html FROM ({_SITES})"""


@query(f"""SELECT page_id AS site, list_sort(CASE WHEN page_id % 4 = 0 THEN ['sales@loja' || (page_id % 9) || '.com.br'] ELSE [] END || ['info' || page_id || '@loja' || (page_id % 9) || '.com.br', 'team' || page_id || '@firma.com.br']) AS emails,
  ['+55621234' || few || ':tel:false', '+55629' || many || ':tel:true'] AS phones, ['55629' || many] AS whatsapps FROM ({_SITES})""")
def page_contacts(spark, sf_dir):
    found = leads.merged_contacts(leads.contacts(spread(rows(spark, sf_dir, _LINKED))))
    return found.select("site", "emails", F.transform("phones", lambda p: F.concat_ws(":", p["value"], p["origin"], p["whatsapp"].cast("string"))).alias("phones"), "whatsapps")


_SEGMENTS = "['contato-e-localizacao', 'sobremesas', 'steam', 'Fale%20Conosco.html', 'nossa-equipe', 'files/contact.pdf', 'inicio', 'Qu%C3%ADmica', 'quem-somos/equipe', 'About-Us.php', 'blog/contacts-book', 'x', 'a-empresas', 'corpo_clinico']"
_LABELS = "['Read on', 'Entre em Contato!', 'Institucional', 'Our   Team', 'A contact that is named in a label of far more than sixty characters', '']"
_HREFS = f"""SELECT page_id AS place, 'https://s' || CAST(page_id % 40 AS STRING) || '.example/inicio/' AS site, 'https://' || CASE WHEN page_id % 17 = 0 THEN 'other' ELSE 's' || CAST(page_id % 40 AS STRING) END || '.example/' || ELEMENT(a, page_id % 14) || CASE WHEN page_id % 3 = 0 THEN '?p=' || CAST(page_id AS STRING) ELSE '' END AS href, ELEMENT(b, page_id % 6) AS text
  FROM (SELECT page_id, {_SEGMENTS} AS a, {_LABELS} AS b FROM pages)"""
_WORDS = "(VALUES ('contato', 0), ('contatos', 0), ('contact', 0), ('contacts', 0), ('contact-us', 0), ('contactus', 0), ('fale-conosco', 0), ('faleconosco', 0), ('atendimento', 0), ('sobre', 1), ('sobre-nos', 1), ('about', 1), ('about-us', 1), ('quem-somos', 1), ('quemsomos', 1), ('a-empresa', 1), ('institucional', 1), ('equipe', 2), ('nossa-equipe', 2), ('team', 2), ('our-team', 2), ('corpo-clinico', 2), ('trabalhe-conosco', 3))"
_KEY = "'-' || regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g') || '-'"


@query(f"""WITH l AS ({_HREFS.replace('ELEMENT(a, page_id % 14)', 'a[page_id % 14 + 1]').replace('ELEMENT(b, page_id % 6)', 'b[page_id % 6 + 1]')}),
  s AS (SELECT *, split_part(href, '?', 1) AS page, unnest(list_transform(string_split(regexp_replace(regexp_extract(split_part(href, '?', 1), '://[^/]+(/.*)', 1), '/+$', ''), '/'), lambda x: {_KEY.format("regexp_replace(url_decode(x), '(?i)\\.(?:html?|php|aspx?)$', '')")}) || [CASE WHEN length(text) <= 60 THEN {_KEY.format('text')} ELSE '--' END]) AS key FROM l
    WHERE split_part(href, '/', 3) = split_part(site, '/', 3) AND NOT regexp_matches(split_part(href, '?', 1), '\\.pdf$') AND NOT regexp_matches(href, 'example/inicio(\\?|$)')),
  r AS (SELECT site, page, place, min(rank) AS rank FROM s JOIN {_WORDS} w(word, rank) ON contains(key, '-' || word || '-') GROUP BY ALL),
  f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site, page ORDER BY place) = 1)
  SELECT site, page AS href, rank::INTEGER AS rank FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY rank, place) <= 3""")
def contact_page_ranks(spark, sf_dir):
    """The three best contact pages of each site, by all keywords, in paths and labels."""
    links = rows(spark, sf_dir, _HREFS.replace("['", "array('").replace("']", "')").replace("ELEMENT(", "get("))
    return crawl.contact_pages(links).select("site", "href", "rank")


_CHATS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'https://wa.me/5562' || n WHEN 1 THEN 'https://api.whatsapp.com/send?phone=+5562' || n || '&text=a' WHEN 2 THEN 'whatsapp://send?text=a&phone=5562' || n WHEN 3 THEN 'https://wa.me/62' || substr(n, 1, 5) ELSE 'https://firm.example/' || n END AS link FROM (
  SELECT c_custkey, '9' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') AS n FROM customer)"""


@query(f"SELECT id, CASE WHEN id % 5 < 3 THEN '5562' || regexp_extract(link, '5562(9[0-9]{{8}})', 1) END AS number FROM ({_CHATS})")
def chat_numbers(spark, sf_dir):
    return rows(spark, sf_dir, _CHATS).select("id", phone.whatsapp_number(F.col("link")).alias("number"))


_LEADS = """SELECT c_custkey AS lead_id, 'Studio ' || c_name AS title, CASE c_custkey % 6 WHEN 0 THEN 'Rua ' || CAST(c_custkey AS STRING) || ', Centro, Recife - PE, 50000-000' WHEN 1 THEN CAST(c_custkey AS STRING) || ' High St, Leeds, LS1 4AB' WHEN 2 THEN '5 Road, Cork, Ireland' WHEN 3 THEN 'Recife - PE' WHEN 4 THEN 'Av 1, 12345-678, Brasil' END AS address,
  CASE WHEN c_custkey % 7 = 0 THEN 'pt' WHEN c_custkey % 7 = 1 THEN 'FR' ELSE '' END AS country, '' AS city, CASE WHEN c_custkey % 4 = 0 THEN '5581' || CAST(c_custkey AS STRING) ELSE '' END AS whatsapp, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.com.br' END AS email, CASE WHEN c_custkey % 5 = 0 THEN 'https://instagram.com/x' END AS instagram, CASE WHEN c_custkey % 2 = 0 THEN '+5581' END AS phone,
  CASE WHEN c_custkey % 8 < 5 THEN CAST(c_custkey % 8 AS DOUBLE) + 0.5 END AS rating, CAST(c_custkey % 3 AS INT) * 10 AS reviews, CASE WHEN c_custkey % 9 = 0 THEN 'Ana Lima' ELSE '' END AS person FROM customer"""
_CITY = "CASE lead_id % 6 WHEN 0 THEN 'Recife' WHEN 1 THEN 'Leeds' WHEN 2 THEN 'Cork' WHEN 3 THEN 'Recife' END"


@query(f"""SELECT lead_id, channel, destination, locale, CASE locale WHEN 'en' THEN 'Hi ' || who || ',' || e || 'I came across ' || title || coalesce(' in ' || place, '') || CASE WHEN rated THEN ' (' || rating || '★, ' || reviews || ' Google reviews)' ELSE '' END || '.' || e || 'I work on cleaner sites for dental businesses.' || e || 'Would a 10-minute call this week be useful?'
  ELSE 'Olá ' || who || ', tudo bem?' || e || 'Conheci a ' || title || coalesce(' em ' || place, '') || CASE WHEN rated THEN ' (nota ' || rating || '★, ' || reviews || ' avaliações no Google)' ELSE '' END || '.' || e || 'Trabalho com cleaner sites para negócios de dental.' || e || 'Faz sentido conversarmos 10 minutos esta semana?' END AS copy
  FROM (SELECT *, chr(10) || chr(10) AS e, {_CITY} AS place, coalesce(rating, 0) <> 0 AND reviews <> 0 AS rated, CASE WHEN person <> '' THEN person WHEN locale = 'en' THEN title || ' team' ELSE 'equipe da ' || title END AS who FROM (
    SELECT *, CASE WHEN whatsapp <> '' THEN 'WHATSAPP' WHEN email IS NOT NULL THEN 'EMAIL' WHEN instagram IS NOT NULL THEN 'INSTAGRAM_DM' ELSE 'PHONE' END AS channel, coalesce(nullif(whatsapp, ''), email, instagram, phone, '') AS destination,
      CASE WHEN country = 'pt' THEN 'pt' WHEN country = 'FR' THEN 'en' WHEN lead_id % 6 IN (1, 2) THEN 'en' ELSE 'pt' END AS locale FROM ({_LEADS})))""")
def outreach_drafts(spark, sf_dir):
    return leads.drafts(rows(spark, sf_dir, _LEADS), "dental", " cleaner sites ").select("lead_id", "channel", "destination", "locale", "copy")
