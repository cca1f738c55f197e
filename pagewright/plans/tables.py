"""Queries over relations: places, leads, crawl, jobs, metrics, benchmarks.

Customers with their nation stand in for places and leads, events for jobs, requests and benchmark runs. They check the
operators, not the realism of the domain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..operators import crawl, jobs, leads, places, social
from ..sources import readers, sinks
from .registry import query, rows, table

_PLACES = """SELECT c_custkey AS id, c_name AS title, CASE c_custkey % 4 WHEN 0 THEN '["' || c_mktsegment || '", "Shop"]' WHEN 1 THEN '' ELSE c_mktsegment || ', Store' END AS categories, CASE WHEN c_custkey % 4 = 1 THEN 'Bar' ELSE '' END AS category,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+55 62 9' || CAST(c_custkey AS STRING) END AS phone, CASE c_custkey % 5 WHEN 0 THEN 'https://instagram.com/c' || CAST(c_custkey AS STRING) WHEN 1 THEN '' ELSE 'https://www.c' || CAST(c_custkey AS STRING) || '.com' END AS website,
  CASE WHEN c_custkey % 7 = 0 THEN 'a@b.com' ELSE '' END AS emails, CASE c_custkey % 6 WHEN 0 THEN '4,8' WHEN 1 THEN 'n/a' ELSE '3.' || CAST(c_custkey % 10 AS STRING) END AS review_rating, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_INSTAGRAM = "contains(website, 'instagram.com')"


@query(f"SELECT id, title FROM ({_PLACES}) WHERE contains(lower(title), 'customer#00000') AND (contains(lower(categories), 'build')) AND coalesce(TRY_CAST(regexp_extract(review_rating, '^[0-9]*\\.?[0-9]+') AS DOUBLE), 0) >= 3.5 AND phone <> '' AND website <> '' AND NOT {_INSTAGRAM}")
def result_filter(spark, sf_dir):
    return leads.filtered(rows(spark, sf_dir, _PLACES), search="Customer#00000", category="build", min_rating=3.5, has_phone=True, has_website=True).select("id", "title")


@query(f"SELECT id, title FROM ({_PLACES}) WHERE {_INSTAGRAM} AND emails = '' ORDER BY id DESC LIMIT 20 OFFSET 10")
def result_page(spark, sf_dir):
    own = leads.filtered(rows(spark, sf_dir, _PLACES), has_instagram=True, has_email=False)
    return leads.page_of(own, [F.col("id").desc()], 20, 10).select("id", "title")


@query(f"""SELECT count(*) AS total, count(*) FILTER (phone <> '') AS with_phone, count(*) FILTER (website <> '' AND NOT {_INSTAGRAM}) AS with_website, count(*) FILTER ({_INSTAGRAM}) AS with_instagram,
  count(*) FILTER (emails <> '') AS with_email, avg(TRY_CAST(replace(review_rating, ',', '.') AS DOUBLE)) AS average_rating FROM ({_PLACES})""")
def result_stats(spark, sf_dir):
    return leads.statistics(rows(spark, sf_dir, _PLACES))


@query(f"SELECT CASE id % 4 WHEN 1 THEN 'Bar' WHEN 0 THEN regexp_extract(categories, '\"([^\"]+)\"', 1) ELSE split_part(categories, ', ', 1) END AS primary, count(*) AS n FROM ({_PLACES}) GROUP BY 1")
def category_counts(spark, sf_dir):
    return leads.category_counts(rows(spark, sf_dir, _PLACES))


_POINTS = "SELECT c_custkey AS id, CAST(c_custkey % 1201 AS DOUBLE) / 10 - 60 AS latitude, CAST(c_custkey * 7 % 3601 AS DOUBLE) / 10 - 180 AS longitude FROM customer"


@query(f"""SELECT id, round(d, 3) AS metres FROM (SELECT id, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (
  SELECT id, pow(sin(radians(latitude - (-16.68)) / 2), 2) + cos(radians(-16.68)) * cos(radians(latitude)) * pow(sin(radians(longitude - (-49.25)) / 2), 2) AS h FROM ({_POINTS}))) WHERE d <= 3000000""")
def haversine_radius(spark, sf_dir):
    return leads.within_radius(rows(spark, sf_dir, _POINTS), -16.68, -49.25, 3e6).select("id", F.round("distance", 3).alias("metres"))


_BOXES = "SELECT n_nationkey AS box_id, CAST(n_nationkey AS DOUBLE) AS min_lat, CASE WHEN n_nationkey % 2 = 0 THEN 179.0 ELSE CAST(n_nationkey AS DOUBLE) END AS min_lon, n_nationkey + 1.0 AS max_lat, CASE WHEN n_nationkey % 2 = 0 THEN -179.0 ELSE n_nationkey + 1.5 END AS max_lon, 40.0 AS cell_km FROM nation"
_CELLS = f"""SELECT box_id, y, x, CASE WHEN min_lat + (y + 0.5) * (40.0 / 111.32) > max_lat THEN (min_lat + max_lat) / 2 ELSE min_lat + (y + 0.5) * (40.0 / 111.32) END AS lat,
  CASE WHEN min_lon + (x + 0.5) * s > 180 THEN min_lon + (x + 0.5) * s - 360 ELSE min_lon + (x + 0.5) * s END AS lon FROM (
  SELECT *, unnest(range(0, ceil(w / s)::BIGINT)) AS x FROM (SELECT *, unnest(range(0, ceil((max_lat - min_lat) / (40.0 / 111.32))::BIGINT)) AS y FROM (
    SELECT *, 40.0 / (111.32 * cos(radians((min_lat + max_lat) / 2))) AS s, CASE WHEN max_lon > min_lon THEN max_lon - min_lon ELSE 360 + max_lon - min_lon END AS w FROM (
      SELECT box_id, min_lat::DOUBLE AS min_lat, min_lon::DOUBLE AS min_lon, max_lat::DOUBLE AS max_lat, max_lon::DOUBLE AS max_lon FROM ({_BOXES})))))"""


def _boxes(spark, sf_dir):
    b = rows(spark, sf_dir, _BOXES)
    return b.select("box_id", *[F.col(c).cast("double").alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon", "cell_km")])


@query(f"SELECT box_id, y, x, round(lat, 9) AS lat, round(lon, 9) AS lon FROM ({_CELLS})")
def grid_cells(spark, sf_dir):
    return leads.grid_cells(_boxes(spark, sf_dir), 1000).select("box_id", "y", "x", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"SELECT r_name AS query, box_id, y, x FROM region, ({_CELLS})")
def query_cell_cross(spark, sf_dir):
    cells = leads.grid_cells(_boxes(spark, sf_dir), 1000).select("box_id", "y", "x")
    return leads.seed_jobs(table(spark, sf_dir, "region").select(F.col("r_name").alias("query")), cells, 10_000)


@query("SELECT c_custkey AS lead_id, o_orderkey AS page_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def lead_page_left_join(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").alias("page_id"))
    return leads.lead_pages(sites, stored, "lead_id")


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"SELECT user_id AS key, event_id, cached_at IS NOT NULL AS hit FROM events LEFT JOIN (SELECT user_id AS k, max(ts) AS cached_at FROM events WHERE event_type = 'view' GROUP BY 1) ON k = user_id AND cached_at > {_NOW} - INTERVAL 24 HOUR WHERE event_type = 'click'")
def ttl_cache_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    writes = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), F.col("event_id").alias("content"))
    stored = crawl.cache_merged(writes.limit(0), writes)
    wanted = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), "event_id")
    return crawl.cached(wanted, stored, F.expr(_NOW)).select("key", "event_id", "hit")


@query("SELECT DISTINCT user_id AS url FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def visited_anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "url")
    return crawl.unvisited(e.where("event_type = 'click'").select("url").distinct(), e.where("event_type = 'purchase' and value > 90"))


_LEADS = "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'Cid' || CAST(user_id AS STRING) ELSE '' END AS cid, 'Shop ' || upper(event_type) AS title, 'Street ' || CAST(user_id AS STRING) AS address FROM events"


@query(f"SELECT min(event_id) AS event_id, CASE WHEN cid <> '' THEN cid ELSE lower(title || '_' || address) END AS lead_key FROM ({_LEADS}) GROUP BY 2")
def lead_dedupe(spark, sf_dir):
    return leads.deduplicated(rows(spark, sf_dir, _LEADS), ["event_id"]).select("event_id", "lead_key")


@query("SELECT url, min(page_id) AS page_id FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages) GROUP BY url")
def strip_query_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.without_query(F.col("url")).alias("url"))
    return crawl.first_wins(p, ["url"], ["page_id"])


@query("SELECT page_id, url FROM pages ORDER BY contains(lower(url), 'utm') DESC, page_id LIMIT 40")
def relevance_sort(spark, sf_dir):
    return crawl.relevance(table(spark, sf_dir, "pages").withColumn("place", F.col("page_id")), "UTM").limit(40).select("page_id", "url")


_ROBOTS = [("a.example", "User-agent: *\nDisallow: /\n\nUser-agent: OurBot\nUser-agent: other\nDisallow: /*/secret\nAllow: /en/secret$\nDisallow: /%70rivate # x\nSitemap: https://a.example/map.xml")]


@query("""SELECT page_id, CASE WHEN p = '/en/secret' THEN TRUE WHEN contains(p, '/secret') THEN FALSE WHEN starts_with(p, '/private') THEN FALSE ELSE TRUE END AS allowed FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/en/secret' WHEN 1 THEN '/en/secret/' || page_id WHEN 2 THEN '/private/' || page_id ELSE '/open/' || page_id END AS p FROM pages)""")
def robots_allow(spark, sf_dir):
    rules = crawl.robots_rules(spark.createDataFrame(_ROBOTS, "host string, body string"), "OurBot")
    k = F.col("page_id")
    path = F.when(k % 4 == 0, "/en/secret").when(k % 4 == 1, F.concat(F.lit("/en/secret/"), k)).when(k % 4 == 2, F.concat(F.lit("/private/"), k)).otherwise(F.concat(F.lit("/open/"), k))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://a.example"), path).alias("url"))
    return crawl.allowed(p, rules).select("page_id", "allowed")


@query("SELECT n_nationkey AS source, unnest([0, 1]) AS place, unnest(['https://n.example/' || n_nationkey, 'https://n.example/x' || n_nationkey]) AS url, unnest(['2026-01-0' || (n_nationkey % 9 + 1), NULL]) AS lastmod FROM nation")
def sitemap_entries(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    xml = F.concat(F.lit("<urlset><url><loc> https://n.example/"), k, F.lit(" </loc><lastmod>2026-01-0"), (F.col("n_nationkey") % 9 + 1).cast("string"), F.lit("</lastmod></url><url><loc>https://n.example/x"), k, F.lit("</loc></url><broken"))
    return crawl.sitemap_entries(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), xml.alias("xml"))).select("source", "place", "url", "lastmod")


_EDGES = "SELECT o_custkey AS src, o_orderkey * 13 % (SELECT max(c_custkey) FROM customer) + 1 AS dst FROM orders"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), walk(url, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = url WHERE depth < 3)
SELECT url::BIGINT AS url, min(depth)::INTEGER AS depth FROM walk GROUP BY 1""")
def bfs_depth(spark, sf_dir):
    edges = rows(spark, sf_dir, _EDGES).select(F.col("src").cast("long"), F.col("dst").cast("long"))
    return crawl.crawl(edges, spark.createDataFrame([(1,)], "url long"), 3)


_EVIDENCE = """SELECT c_nationkey AS site, CAST(c_custkey % 3 AS INT) AS page_rank, CAST(c_custkey AS INT) AS ord, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'whatsapp' ELSE 'cnpj' END AS type,
  CASE WHEN c_custkey % 4 IN (1, 2) THEN '+55' || CAST(c_custkey % 11 AS STRING) ELSE 'v' || CAST(c_custkey % 13 AS STRING) END AS value, CASE WHEN c_custkey % 8 = 1 THEN 'tel' ELSE 'text' END AS origin FROM customer"""


@query(f"""WITH e AS ({_EVIDENCE}), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY site, type, value ORDER BY CASE WHEN type = 'phone' THEN (origin <> 'tel')::INT ELSE 0 END, page_rank, ord) = 1)
SELECT site, list(value ORDER BY value) FILTER (type = 'email') AS emails, list(value ORDER BY value) FILTER (type = 'phone') AS phones,
  (len(list(value) FILTER (type = 'phone' AND origin = 'tel')))::INTEGER AS tel, list(value ORDER BY value) FILTER (type = 'cnpj') AS cnpjs FROM f GROUP BY site""")
def contact_merge(spark, sf_dir):
    m = leads.merged_contacts(rows(spark, sf_dir, _EVIDENCE))
    return m.select("site", "emails", F.transform("phones", lambda p: p["value"]).alias("phones"), F.nullif(F.size(F.filter("phones", lambda p: p["origin"] == "tel")), F.lit(0)).alias("tel"), "cnpjs")


@query("SELECT c_custkey AS lead_id, list_distinct_in_order AS all_emails FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['m@x.com', 's' || (c_custkey % 25) || '@x.com'] ELSE ['s' || (c_custkey % 25) || '@x.com', 'm@x.com'] END AS list_distinct_in_order FROM customer)")
def enrich_merge(spark, sf_dir):
    k = F.col("c_custkey")
    own = F.concat(F.lit("s"), (k % 25).cast("string"), F.lit("@x.com"))
    lead = table(spark, sf_dir, "customer").select(k.alias("lead_id"), F.col("c_name").alias("title"), F.concat(F.lit("https://www.d"), (k % 25).cast("string"), F.lit(".com")).alias("website"), F.array(F.when(k % 3 == 0, "m@x.com").otherwise(own)).alias("emails"), F.lit("+551").alias("phone_e164"))
    site = spark.range(25).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".com")).alias("domain"), F.array(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("@x.com")), F.lit("m@x.com")).alias("emails"), F.array(F.lit("+551"), F.lit("+552")).alias("phones"))
    return leads.enriched(lead, site).select("lead_id", "all_emails")


_JOBS = f"""SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status, CAST(user_id % 4 AS INT) AS attempts, 3 AS max_attempts,
  CAST(user_id % 5 AS INT) AS priority, ts AS created_at, ts AS updated_at, '' AS worker_id, CASE WHEN event_type = 'view' THEN ts END AS lease_expires_at FROM events"""


@query(f"SELECT s AS status, count(job_id) AS n FROM (SELECT unnest(['queued', 'running', 'succeeded', 'failed', 'timed_out', 'canceled', 'interrupted', 'worker_lost']) AS s) LEFT JOIN ({_JOBS}) ON s = status GROUP BY s")
def jobs_by_status(spark, sf_dir):
    return jobs.by_status(rows(spark, sf_dir, _JOBS))


@query(f"""SELECT job_id, attempts + 1 AS attempts FROM ({_JOBS}) WHERE status = 'queued' OR (status = 'running' AND lease_expires_at < {_NOW} AND attempts < max_attempts) ORDER BY priority, created_at, job_id LIMIT 50""")
def queue_claim(spark, sf_dir):
    _, mine = jobs.claim(rows(spark, sf_dir, _JOBS), F.expr(_NOW), "w1", 50, 30)
    return mine.select("job_id", "attempts")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE status = 'running' AND lease_expires_at < {_NOW} AND attempts >= max_attempts")
def queue_dead(spark, sf_dir):
    dead, _ = jobs.claim(rows(spark, sf_dir, _JOBS), F.expr(_NOW), "w1", 50, 30)
    return dead.select("job_id")


@query(f"SELECT job_id, CASE WHEN lost AND attempts < 3 THEN 'queued' WHEN lost THEN 'worker_lost' ELSE status END AS status, CASE WHEN lost AND attempts >= 3 THEN 'worker_lost' END AS error FROM (SELECT *, coalesce(status = 'running' AND lease_expires_at < {_NOW}, FALSE) AS lost FROM ({_JOBS}))")
def lease_recovery(spark, sf_dir):
    return jobs.recovered(rows(spark, sf_dir, _JOBS), F.expr(_NOW)).select("job_id", "status", "error")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE NOT (status IN ('succeeded', 'failed', 'canceled') AND updated_at < {_NOW})")
def retention_purge(spark, sf_dir):
    return jobs.purged(rows(spark, sf_dir, _JOBS), F.expr(_NOW)).select("job_id")


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS events FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return jobs.latest_state(e)


@query("""WITH RECURSIVE q AS (SELECT c_nationkey AS k, c_custkey AS id, c_custkey % 9 + 1 AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), w(k, i, id, used, taken) AS (
  SELECT k, i, id, CASE WHEN n <= 40 THEN n ELSE 0 END, n <= 40 FROM q WHERE i = 1 UNION ALL SELECT q.k, q.i, q.id, w.used + CASE WHEN w.used + n <= 40 THEN n ELSE 0 END, w.used + n <= 40 FROM w JOIN q ON q.k = w.k AND q.i = w.i + 1)
SELECT id, taken FROM w""")
def budget_running(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9 + 1).alias("n"))
    return jobs.within_budget(items, "n", 40, ["id"], "k").select("id", "taken")


@query("""WITH RECURSIVE q AS (SELECT user_id % 40 AS d, event_id AS id, (epoch_ms(ts) // 1000 % 4000) AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch_ms(ts) // 1000 % 4000, event_id) AS i FROM events),
w(d, i, id, s) AS (SELECT d, i, id, t FROM q WHERE i = 1 UNION ALL SELECT q.d, q.i, q.id, greatest(q.t, w.s + 300) FROM w JOIN q ON q.d = w.d AND q.i = w.i + 1) SELECT id AS request_id, s AS start_ms FROM w""")
def domain_throttle(spark, sf_dir):
    """A time in whole milliseconds is the nearest one, as in the SQL."""
    at = F.expr("round(unix_micros(cast(ts AS timestamp)), -3) DIV 1000000 % 4000")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("domain"), F.col("event_id").alias("request_id"), at.alias("at_ms"))
    return jobs.throttled(e).select("request_id", "start_ms")


@query("SELECT run::BIGINT AS run, count(*) AS n, avg((phone = '')::INT::DOUBLE) AS phone_missing, avg((website = '')::INT::DOUBLE) AS website_missing, avg((phone = '')::INT::DOUBLE) > 0.95 OR avg((website = '')::INT::DOUBLE) > 0.95 AS warns FROM (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS run FROM (SELECT c_custkey, CASE WHEN c_custkey // 100 % 2 = 0 THEN '' ELSE 'p' END AS phone, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'w' END AS website FROM customer)) GROUP BY 1 HAVING count(*) = 50")
def drift_windows(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.floor(k / 100) % 2 == 0, "").otherwise("p").alias("phone"), F.when(k % 3 == 0, "").otherwise("w").alias("website"))
    return jobs.drift(c, ["c_custkey"], ["phone", "website"])


@query("SELECT event_type AS metric, sum(value) AS total FROM events GROUP BY 1")
def metrics_rollup(spark, sf_dir):
    return jobs.metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value"))


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, coalesce(sum(value) / count(*), 0) AS average_ms FROM events")
def service_snapshot(spark, sf_dir):
    return jobs.service_snapshot(table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("failed"), F.col("value").alias("ms")))


_BENCH = "SELECT 'tool' || CAST(user_id % 3 AS STRING) AS tool, event_type AS country, user_id % 7 <> 0 AS ok, CAST(value * 100 AS INT) AS ms, CAST(event_id % 977 AS INT) AS tokens, CAST(user_id % 2 AS INT) AS emails FROM events"


@query(f"""SELECT tool, CASE WHEN grouping(country) = 1 THEN 'all' ELSE country END AS scope, count(*) AS n, round(100.0 * count(*) FILTER (ok) / count(*), 4)::DOUBLE AS ok_percent,
  quantile_disc(tokens, 0.5) FILTER (ok)::BIGINT AS p50, quantile_disc(tokens, 0.5) FILTER (ok)::DOUBLE AS median_tokens, sum(emails) / count(*) AS emails_per_site, count(*) FILTER (emails > 0) AS sites_with_email FROM ({_BENCH}) GROUP BY GROUPING SETS ((tool), (tool, country))""")
def bench_summary(spark, sf_dir):
    b = rows(spark, sf_dir, _BENCH).withColumn("ms", F.col("tokens"))
    out = jobs.bench_summary(b)
    return out.select("tool", "scope", "n", F.col("ok_percent").cast("double").alias("ok_percent"), F.col("p50").cast("long").alias("p50"), F.col("median_tokens").cast("double").alias("median_tokens"), "emails_per_site", "sites_with_email")


@query("SELECT user_id, quantile_disc(event_id, 0.5) AS p50, quantile_disc(event_id, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_nearest_rank(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(jobs.nearest_rank("event_id", 0.5).alias("p50"), jobs.nearest_rank("event_id", 0.95).alias("p95"))


@query("SELECT user_id AS handle, 0 AS place, 'v' || user_id AS id, 'https://www.tiktok.com/@' || user_id || '/video/v' || user_id AS url, user_id AS views, 'caption ' || user_id AS description FROM events")
def playlist_videos(spark, sf_dir):
    u = F.col("user_id").cast("string")
    raw = F.concat(F.lit('{"entries":[{"id":"v'), u, F.lit('","title":"caption '), u, F.lit('","view_count":'), u, F.lit(',"duration":0},null]}'))
    e = table(spark, sf_dir, "events").select(u.alias("handle"), raw.alias("raw"))
    return social.playlist_videos(e).select(F.col("handle").cast("long").alias("handle"), "place", "id", "url", "views", "description")


@query("SELECT p_partkey AS page, unnest([1, 7]) AS rank, unnest(['a b', 'x' || p_partkey]) AS name, unnest(['https://www.tiktok.com/tag/a%20b', 'https://www.tiktok.com/tag/x' || p_partkey]) AS url, unnest([p_partkey, NULL]) AS views FROM part")
def hashtag_rank(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit('{"items":[{"hashtagID":"1","hashtagName":"a b","vv":"'), k, F.lit('"},{"rankIndex":"7","hashtagID":2,"hashtagName":"x'), k, F.lit('","vv":"?"}]}'))
    return social.hashtags(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), raw.alias("raw"))).select("page", "rank", "name", "url", "views")


@query("SELECT user_id AS post_id, CASE WHEN user_id % 2 = 0 THEN 1200 END::BIGINT AS likes, CASE user_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 12 END::BIGINT AS shares FROM (SELECT DISTINCT user_id FROM events)")
def social_metrics_sum(spark, sf_dir):
    k = F.col("post_id")
    base = table(spark, sf_dir, "events").select(F.col("user_id").alias("post_id")).distinct()
    a = base.select("post_id", F.explode(F.array(F.struct(F.lit("Like").alias("label"), F.when(k % 2 == 0, "1.2K").otherwise("").alias("text")), F.struct(F.lit("Repost").alias("label"), F.when(k % 3 == 0, "5").when(k % 3 == 1, "10").alias("text")), F.struct(F.lit("Share").alias("label"), F.when(k % 3 == 1, "2 x").alias("text")))).alias("a")).select("post_id", "a.label", "a.text")
    return social.action_metrics(a).select("post_id", "likes", "shares")


def _place(title, lat):
    """A place payload with the fields that the check reads, at their positions."""
    d = [F.lit("null")] * 184
    d[11], d[9], d[13] = F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("[null,null,"), lat, F.lit(",2.5]")), F.lit('["Cafe","Bar"]')
    d[4] = F.lit('[null,null,"$$",null,null,null,null,4.5,120]')
    d[18] = F.concat(F.lit('"'), title, F.lit(', Main St 1"'))
    d[7] = F.lit('["/url?q=https://cafe.example/%3Fa&sa=U"]')
    d[57] = F.lit('[null,"Ann","42"]')
    return F.concat(F.lit("[null,null,null,null,null,null,["), F.concat_ws(",", *d), F.lit("]]"))


@query("""SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 10 = 9 THEN 95.5 ELSE (s_suppkey % 80) + 0.5 END::DOUBLE AS latitude, 120 AS review_count, 'Cafe' AS category, 'Main St 1' AS address, 'https://cafe.example/?a' AS website,
  'https://www.google.com/maps/contrib/42' AS owner_link, CASE WHEN s_suppkey % 10 = 9 THEN 'coordinate' END AS drift FROM supplier""")
def place_decode(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lat = F.when(F.col("s_suppkey") % 10 == 9, "95.5").otherwise(F.concat((F.col("s_suppkey") % 80).cast("string"), F.lit(".5")))
    made = places.decode_places(s.select(F.col("s_suppkey").alias("id"), _place(F.col("s_name"), lat).alias("raw")))
    return made.select("id", "title", "latitude", "review_count", "category", "address", "website", "owner_link", "drift")


@query("SELECT s_suppkey AS id, 0 AS place, 'r' || s_suppkey AS review_id, 'Ann' AS name, 'unknown' AS source, 4 AS rating, 5 AS rating_scale, 'good' AS text_original FROM supplier")
def reviews_decode(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    one = F.concat(F.lit('[["r'), k, F.lit('",[null,null,1700000000000000,1700000000000000,["x","y",["u"],null,null,["Ann"]]],[[4],null,null,null,null,null,null,null,null,null,null,null,null,null,["en"],[["good"]]]]]'))
    raw = F.concat(F.lit(")]}'\n["), one, F.lit(',[["n",[null,null,0,0,[]]]]]'))
    return places.decode_reviews(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw"))).select("id", "place", "review_id", "name", "source", "rating", "rating_scale", "text_original")


@query("SELECT c_custkey AS lead_id, CASE WHEN c_custkey % 2 = 0 THEN 'WHATSAPP' WHEN c_custkey % 3 = 0 THEN 'EMAIL' WHEN c_custkey % 5 = 0 THEN 'PHONE' END AS channel FROM customer")
def outreach_channel(spark, sf_dir):
    k = F.col("c_custkey")
    lead = table(spark, sf_dir, "customer").select(k.alias("lead_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("city"), F.when(k % 2 == 0, "+551").alias("whatsapp"), F.when(k % 3 == 0, "a@b.com").otherwise("").alias("email"), F.lit("").alias("instagram"), F.when(k % 5 == 0, "1").alias("phone"))
    return leads.outreach(lead).select("lead_id", "channel")


_REVIEWED = "SELECT c_custkey, c_nationkey, CAST(c_custkey % 20 AS DOUBLE) / 10 + 3 AS rating, CAST(c_custkey % 60 AS INT) AS reviews, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://w.example' END AS website, c_custkey % 4 = 0 AS audited, CAST(c_custkey % 101 AS INT) AS seo FROM customer"


@query(f"""SELECT nation, count(*) AS judged, count(*) FILTER (website = '') AS no_website, count(*) FILTER (audited AND c_custkey % 8 <> 0) AS no_booking, count(*) FILTER (rating < 4.5) AS low_rating FROM (SELECT *, c_nationkey AS nation FROM ({_REVIEWED})) WHERE audited OR website = '' GROUP BY nation""")
def market_gaps(spark, sf_dir):
    r = rows(spark, sf_dir, _REVIEWED)
    lead = r.select(F.col("c_custkey").alias("lead_id"), F.col("c_custkey").cast("string").alias("domain"), F.col("c_nationkey").alias("nation"), F.col("rating").alias("review_rating"), F.col("reviews").alias("review_count"), "website", F.lit("listing").alias("whatsapp_source"))
    audit = r.where("audited").select(F.col("c_custkey").cast("string").alias("domain"), F.col("seo").alias("seo_score"), F.when(F.col("c_custkey") % 8 == 0, "https://b.example").alias("booking_url"), F.lit(True).alias("contact_form"), F.lit(False).alias("whatsapp"))
    return leads.market_gaps(leads.competitor_review(lead, audit), ["nation"]).select("nation", "judged", "no_website", "no_booking", "low_rating")


@query("SELECT c_custkey AS lead_id, c_custkey % 3 = 1 AS skipped FROM customer")
def niche_gate(spark, sf_dir):
    lead = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"))
    verdicts = lead.where("lead_id % 3 <> 0").select("lead_id", F.when(F.col("lead_id") % 3 == 1, 0.2).otherwise(0.5).alias("niche_score"))
    return leads.niche_gate(lead, verdicts).select("lead_id", "skipped")


@query("SELECT c_custkey::VARCHAR || ',\"' || c_name || ', \"\"x\"\"\",''=1' AS value FROM customer")
def safe_csv_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("name"), F.lit("=1").alias("f"))
    return sinks.safe_lines(c)


@query("SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1 ORDER BY q DESC, k LIMIT 100")
def top_orders(spark, sf_dir):
    """Ours, not one of the inventory: a top-k over the largest table, as a yardstick of plain relational work."""
    d = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return d.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).orderBy(F.col("q").desc(), "k").limit(100)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Event-time windows are an extension of ours."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT r_name || ' shops' AS query, CASE WHEN r_regionkey % 2 = 0 THEN 'id' || r_regionkey END AS id FROM region")
def query_lines(spark, sf_dir):
    k = F.col("r_regionkey")
    lines = table(spark, sf_dir, "region").select(F.concat(F.lit("  "), F.col("r_name"), F.lit(" shops "), F.when(k % 2 == 0, F.concat(F.lit("#!#id"), k.cast("string"))).otherwise("")).alias("value"))
    return readers.query_lines(lines.unionByName(spark.createDataFrame([("   ",)], "value string")))


@query("SELECT c_name AS title, ['a', 'b'] AS categories, c_custkey::INTEGER AS review_count FROM customer WHERE c_custkey % 3 <> 0")
def lead_lines(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, F.lit("log: started")).otherwise(F.concat(F.lit('{"title":"'), F.col("c_name"), F.lit('","categories":["a","b"],"review_count":'), k.cast("string"), F.lit("}")))
    return readers.lead_lines(table(spark, sf_dir, "customer").select(line.alias("value"))).select("title", "categories", "review_count")


@query("SELECT s_suppkey, lat, lon, CASE WHEN s_suppkey % 2 = 0 THEN '6PH57VP3+PR' ELSE '849VCWC8+R9' END AS code FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1.286785 ELSE 37.422062 END::DOUBLE AS lat, CASE WHEN s_suppkey % 2 = 0 THEN 103.854503 ELSE -122.084062 END::DOUBLE AS lon FROM supplier)")
def plus_code(spark, sf_dir):
    even = F.col("s_suppkey") % 2 == 0
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(even, 1.286785).otherwise(37.422062).alias("lat"), F.when(even, 103.854503).otherwise(-122.084062).alias("lon"))
    return s.withColumn("code", places.plus_code(F.col("lat"), F.col("lon")))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'instagram' END AS platform, CASE c_custkey % 3 WHEN 0 THEN 'u' || c_custkey WHEN 1 THEN 'shop.' || c_custkey END AS handle, CASE c_custkey % 3 WHEN 0 THEN 'https://www.tiktok.com/@u' || c_custkey WHEN 1 THEN 'https://www.instagram.com/shop.' || c_custkey || '/' END AS url FROM customer")
def watch_targets(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("https://m.tiktok.com/@u"), k.cast("string"), F.lit("/video/1?x=2"))).when(k % 3 == 1, F.concat(F.lit(" @shop."), k.cast("string"))).otherwise("https://www.instagram.com/reel/abc")
    t = social.watch_target(raw, F.when(k % 3 == 1, "Instagram"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), t.alias("t")).select("id", "t.platform", "t.handle", "t.url")


@query("SELECT c_custkey AS id, 'Segunda-feira: 9-12 / 13-' || (c_custkey % 5 + 15) || ' | Terça-feira: closed' AS hours FROM customer")
def hours_text(spark, sf_dir):
    late = F.concat(F.lit("13-"), (F.col("c_custkey") % 5 + 15).cast("string"))
    hours = F.create_map(F.lit("terça-feira"), F.array(F.lit("closed")), F.lit(" Monday "), F.array(F.lit("9-12"), F.lit(" "), late, late))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), numbers.hours_text(hours).alias("hours"))


@query("SELECT s_suppkey AS id, ['11-13', '15-' || s_suppkey % 9] AS monday, s_suppkey % 100 AS noon, ['https://i.example/' || s_suppkey] AS images, ['https://r.example'] AS reservations FROM supplier")
def place_lists(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    d = [F.lit("null")] * 204
    d[11], d[9] = F.lit('"Shop"'), F.lit("[null,null,1.5,2.5]")
    d[203] = F.concat(F.lit('[[["Monday",null,null,[["11-13"],["15-'), (F.col("s_suppkey") % 9).cast("string"), F.lit('"]]],["Sunday",null,null,[]]]]'))
    d[84] = F.concat(F.lit("[[[1,[[12,"), (F.col("s_suppkey") % 100).cast("string"), F.lit(",null]]]]]"))
    d[171] = F.concat(F.lit('[[[null,null,"All",[[null,null,null,null,null,null,["https://i.example/'), k, F.lit('"]]]],[null,null,"None"]]]'))
    d[46] = F.lit('[["https://r.example","book"],["",""]]')
    raw = F.concat(F.lit("[null,null,null,null,null,null,["), F.concat_ws(",", *d), F.lit("]]"))
    p = places.place_lists(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw")))
    return p.select("id", F.col("open_hours")["Monday"].alias("monday"), F.col("popular_times")["Monday"][12].cast("long").alias("noon"), F.transform("images", lambda i: i["link"]).alias("images"), F.transform("reservations", lambda r: r["link"]).alias("reservations"))
