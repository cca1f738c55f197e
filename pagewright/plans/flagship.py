"""What does a page cost in tokens once it is cleaned? Pages to Markdown, then totals by the language in the path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..operators import dom
from .registry import query, spread, table


#: DuckDB: the article's blocks by patterns; a block that opens in bold is bold to its end, as the pages never close it.
_DECODED = "regexp_replace(replace(x, '<br>', ' '), '<[^>]*(?:>|$)', '', 'g')"
for _ref, _sign in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")]:
    _DECODED = f"replace({_DECODED}, '{_ref}', '{_sign}')"
_MARKDOWN = f"""SELECT page_id, url, length(html) AS before, '# ' || array_to_string(list_transform(list_filter(b, lambda p: p.t <> ''), lambda p: CASE WHEN p.b THEN '**' || p.t || '**' ELSE p.t END), chr(10) || chr(10)) AS markdown FROM (
  SELECT page_id, url, html, list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)[^>]*>'),
    lambda x: {{'t': trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')), 'b': contains(x, '<b>')}}) AS b FROM pages)"""
_COSTS = f"""SELECT *, length(markdown) AS char_count, ceil(before / 4.0)::BIGINT AS html_tokens, ceil(length(markdown) / 4.0)::BIGINT AS estimated_tokens FROM ({_MARKDOWN})"""
_REDUCTION = "CASE WHEN {b} > 0 THEN round((1 - {a}::DOUBLE / {b}) * 100, 2) END"
_COSTS = f"SELECT *, {_REDUCTION.format(a='estimated_tokens', b='html_tokens')} AS reduction FROM ({_COSTS})"


@query(f"SELECT page_id, url, markdown, char_count, html_tokens, estimated_tokens, reduction FROM ({_COSTS})")
def html_to_markdown(spark, sf_dir):
    return dom.markdown_pages(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "markdown", "char_count", "html_tokens", "estimated_tokens", "reduction")


@query(f"""SELECT *, {_REDUCTION.format(a='tokens', b='html_tokens')} AS reduction FROM (SELECT regexp_extract(url, '://[^/]+/([a-z]{{2}})/', 1) AS lang, count(*) AS pages, sum(char_count)::BIGINT AS chars,
  sum(html_tokens)::BIGINT AS html_tokens, sum(estimated_tokens)::BIGINT AS tokens, median(reduction) AS median_reduction FROM ({_COSTS}) GROUP BY 1)""")
def page_token_costs(spark, sf_dir):
    made = dom.markdown_pages(spread(table(spark, sf_dir, "pages")))
    lang = F.regexp_extract(urls.part(F.col("url"), "PATH"), "^/([a-z]{2})/", 1)
    out = made.groupBy(lang.alias("lang")).agg(F.count("*").alias("pages"), F.sum("char_count").alias("chars"), F.sum("html_tokens").alias("html_tokens"), F.sum("estimated_tokens").alias("tokens"), F.median("reduction").alias("median_reduction"))
    return out.withColumn("reduction", numbers.reduction_percent(F.col("html_tokens"), F.col("tokens")))


#: DuckDB: pages by patterns. What isn't read goes, inline tags go, other tags part words, and the references that stand in the pages are replaced.
_READ = "html"
for _gone in ("(?is)<head.*?</head>", "(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", r"(?i)</?(?:b|i|em|strong|span|a|u|small|code|sup|sub)(?:\s[^>]*)?>"):
    _READ = f"regexp_replace({_READ}, '{_gone}', '', 'g')"
_READ = f"regexp_replace({_READ}, '<[^>]*>', ' ', 'g')"
_REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")]
for _ref, _sign in _REFERENCES:
    _READ = f"replace({_READ}, '{_ref}', '{_sign}')"
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _ref, _sign in _REFERENCES:
    _TITLE = f"replace({_TITLE}, '{_ref}', '{_sign}')"


@query(f"""SELECT page_id, length(trim(regexp_replace({_READ}, '\\s+', ' ', 'g')))::INTEGER AS visible_chars, len(regexp_extract_all(html, '<a [^>]*href="[^"]'))::INTEGER AS links, t AS title,
  100 - 10 - 5 - 10 - 5 - 10 - 10 - CASE WHEN good THEN 0 ELSE 5 END - CASE WHEN secure THEN 0 ELSE 10 END AS seo_score,
  CASE WHEN good THEN [] ELSE ['title length ' || length(t) || ' (aim for 20-65)'] END || ['missing meta description', 'no <h2> headings', 'missing Open Graph tags', 'missing canonical link', 'missing viewport meta (not mobile-ready)', 'no JSON-LD structured data']
    || CASE WHEN secure THEN [] ELSE ['not served over https'] END AS seo_issues
  FROM (SELECT page_id, html, t, length(t) BETWEEN 20 AND 65 AS good, starts_with(url, 'https://') AS secure FROM (SELECT page_id, url, html, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS t FROM pages))""")
def page_products(spark, sf_dir):
    """Visible text, links, metadata and audit of every page, by one parse. Lengths of the text are without repeated white space."""
    p = spread(table(spark, sf_dir, "pages"))
    made = p.select("page_id", dom.products(F.col("html"), F.col("url"), ["visible", "links", "metadata", "audit", "fields"], schema={"head": "article h1", "menu": "nav a@href"}).alias("p"))
    visible = F.length(F.trim(F.regexp_replace("p.visible", r"\s+", " ")))
    return made.select("page_id", visible.alias("visible_chars"), F.size("p.links").alias("links"), F.col("p.metadata.title").alias("title"), F.col("p.audit.seo_score").alias("seo_score"), F.col("p.audit.seo_issues").alias("seo_issues"))


@query("""SELECT page_id, 100 - 10 - 5 - 10 - 5 - 10 - 10 - CASE WHEN length(t) BETWEEN 20 AND 65 THEN 0 ELSE 5 END - CASE WHEN starts_with(url, 'https://') THEN 0 ELSE 10 END AS seo_score FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '"'), '&amp', '&'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def site_audit(spark, sf_dir):
    """SEO points of every page. Titles hold no references but these three and cut-off ones."""
    p = spread(table(spark, sf_dir, "pages"))
    made = p.select("page_id", dom.products(F.col("html"), F.col("url"), ["audit"]).alias("p"))
    return made.select("page_id", F.col("p.audit.seo_score").alias("seo_score"))
