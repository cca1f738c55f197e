"""Queries over bodies that are composed from the given tables: PDF files, pages without an article."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rx
from ..operators import dom
from ..sources import pdf
from .flagship import _MARKDOWN, _TITLE
from .registry import query, spread, table

_A_PAGE = 3  #: lines
_BREAK = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _pdf_of(text):
    """A PDF file of a text: three lines a page, each shown as UTF-16 codes of a font whose map to Unicode is the identity."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rx.let(lines, _pdf_of_lines).cast("binary")


def _pdf_of_lines(lines):
    count = F.ceil(F.size(lines) / _A_PAGE).cast("int")
    each = lambda f: F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), f), "")).otherwise("")
    number = lambda i, k: (i * 2 + k).cast("string")
    shown = lambda i: F.array_join(F.transform(F.slice(lines, i * _A_PAGE + 1, _A_PAGE), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T* "))), "")
    page = lambda i: F.concat(number(i, 5), F.lit(" 0 obj<</Type/Page/Parent 2 0 R/Contents "), number(i, 6), F.lit(" 0 R>>endobj\n"), number(i, 6), F.lit(" 0 obj<<>>stream\nBT /F1 10 Tf 12 TL 50 700 Td "), shown(i), F.lit("ET\nendstream endobj\n"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n3 0 obj<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>endobj\n4 0 obj<<>>stream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange\nendstream endobj\n"
    kids = F.concat(F.lit("2 0 obj<</Type/Pages/Resources<</Font<</F1 3 0 R>>>>/Kids["), each(lambda i: F.concat(number(i, 5), F.lit(" 0 R "))), F.lit("]>>endobj\n"))
    return F.concat(F.lit(head), kids, each(page), F.lit("trailer<</Root 1 0 R>>\n%%EOF"))


@query(rf"""SELECT doc_id, CASE WHEN len(pages) > 0 THEN len(pages) END AS pages, CASE WHEN len(pages) > 0 THEN array_to_string(pages[1:50], {_BREAK}) || CASE WHEN len(pages) > 50 THEN {_BREAK} || '[truncated: first 50 of ' || len(pages) || ' pages]' ELSE '' END END AS text FROM (
  SELECT doc_id, list_transform(range(0, ceil(len(lines) / 3.0)::BIGINT), lambda i: regexp_replace(array_to_string(lines[i * 3 + 1 : i * 3 + 3], chr(10)), '^\s+|\s+$', '', 'g')) AS pages FROM (
    SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents))""")
def pdf_text(spark, sf_dir):
    """Every document as a PDF file, read back."""
    files = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("url"), _pdf_of(F.col("text")).alias("content"))
    return pdf.pdf_text(files).select(F.col("url").cast("long").alias("doc_id"), "pages", "text")


@query(f"SELECT page_id, CASE WHEN length(markdown) >= 600 THEN markdown END AS markdown, CASE WHEN length(markdown) >= 100 THEN TRUE END AS holds FROM ({_MARKDOWN})")
def readable_pages(spark, sf_dir):
    """Pages whose article is a plain block: scores must find the text that the tag marks; a short page's may bring others along, and one
    without any paragraph has no points."""
    pages = dom.markdown_pages(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "html", F.col("markdown").alias("own"))
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    found = dom.markdown_pages(pages.withColumn("html", html))
    return found.select("page_id", F.when(F.length("own") >= 600, F.col("markdown")).alias("markdown"), F.when(F.length("own") >= 100, F.col("markdown").contains(F.col("own"))).alias("holds"))


_FIELDS = '{"title": "title", "menu": "nav a", "items": "nav ul > li", "ad": "div.ad", "none": "h6@id"}'


@query(f"""SELECT page_id, trim(t) AS title, list_transform(regexp_extract_all(nav, 'href="([^"]*)"', 1), lambda h: regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || h) AS menu, len(regexp_extract_all(nav, '<li>'))::INTEGER AS items, 1 AS ads, 0 AS missing
  FROM (SELECT page_id, url, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, {_TITLE} AS t FROM pages)""")
def select_fields(spark, sf_dir):
    """Fields of every page by a caller's schema, whose keys are columns, in SQL."""
    dom.register_functions(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(f"SELECT page_id, title[0] AS title, menu, size(items) AS items, size(ad) AS ads, size(none) AS missing FROM pages, LATERAL select_fields(html, url, '{_FIELDS}')")
