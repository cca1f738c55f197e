"""Queries over joins that need a structure of their own: robots rules by heads, places by cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, leads
from .registry import query, rows

#: Most pages on one host, the rest on their own; and rules that are made of the pages' own paths.
_PAGES = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://one.example' || regexp_extract(url, '://[^/]+(.*)', 1) END AS url FROM pages"
_RULES = f"""SELECT DISTINCT host, page_id % 3 <> 1 AS allow, CASE page_id % 5 WHEN 0 THEN substr(path, 1, 4) WHEN 1 THEN '/*' || substr(path, greatest(length(path) - 1, 1)) || '$' WHEN 2 THEN path WHEN 3 THEN substr(path, 1, 3) || '*' || substr(path, length(path)) ELSE '*' || substr(path, 2, 3) || '/*' END AS pattern
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) AS path FROM ({_PAGES})) WHERE path <> '' AND (page_id % 11 < 4 OR host <> 'one.example')"""


@query(f"""SELECT page_id, coalesce(allow, TRUE) AS allowed, coalesce(rank, 0)::INTEGER AS rank FROM (SELECT page_id, arg_max(allow, length(pattern) * 2 + allow::INTEGER) AS allow, max(length(pattern)) AS rank FROM (
  SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS h, regexp_extract(url, '://[^/?#]+(/[^#]*)', 1) AS path FROM ({_PAGES})) LEFT JOIN ({_RULES}) ON h = host AND regexp_matches(path, '^' || replace(replace(pattern, '.', '\\.'), '*', '.*')) GROUP BY page_id)""")
def robots_heads(spark, sf_dir):
    """Verdict on every page under rules of its host, and the length of the longest rule that matches."""
    pages, rules = rows(spark, sf_dir, _PAGES), rows(spark, sf_dir, _RULES)
    told = crawl.allowed(pages, rules)
    ranks = crawl.matching_rules(pages, rules).groupBy("url").agg(F.max("rank").alias("rank"))
    return told.join(ranks, "url", "left").select("page_id", "allowed", F.coalesce("rank", F.lit(0)).alias("rank"))


_POINTS = "SELECT c_custkey AS point, CAST(c_custkey * 13 % 1801 AS DOUBLE) / 10 - 90 AS latitude, CAST(c_custkey * 71 % 3601 AS DOUBLE) / 10 - 180 AS longitude FROM customer"
_CENTRES = "SELECT s_suppkey AS centre, CAST(s_suppkey * 37 % 181 AS DOUBLE) - 90 AS centre_latitude, CAST(s_suppkey * 101 % 361 AS DOUBLE) - 180 AS centre_longitude FROM supplier"


@query(f"""SELECT point, centre, round(d, 3) AS metres FROM (SELECT *, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (
  SELECT *, pow(sin(radians(latitude - centre_latitude) / 2), 2) + cos(radians(centre_latitude)) * cos(radians(latitude)) * pow(sin(radians(longitude - centre_longitude) / 2), 2) AS h FROM ({_POINTS}), ({_CENTRES}))) WHERE d <= 250000.123""")
def near_centres(spark, sf_dir):
    """Customers within 250 km of suppliers, poles and date line included."""
    return leads.near(rows(spark, sf_dir, _POINTS), rows(spark, sf_dir, _CENTRES), 250_000.123).select("point", "centre", F.round("distance", 3).alias("metres"))
