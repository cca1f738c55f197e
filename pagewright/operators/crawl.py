"""Traversals over stored pages: robots rules, site maps, breadth-first crawl, contact pages, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import urls



def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """files (host, body) -> host, line, allow, pattern of the rules that hold for the agent.

    Consecutive user-agent lines open a group; groups that name the agent replace those for `*`.
    """
    lines = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    text = F.trim(F.substring_index("raw", "#", 1))
    keyed = lines.where(text.contains(":")).select("host", "line", F.lower(F.trim(F.substring_index(text, ":", 1))).alias("key"), F.trim(F.regexp_replace(text, "^[^:]*:", "")).alias("value"))
    keyed = keyed.where(F.col("key").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("host").orderBy("line")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    grouped = keyed.withColumn("group", F.sum(opens.cast("int")).over(w))
    agents = grouped.where("key = 'user-agent'").groupBy("host", "group").agg(F.collect_set(F.lower("value")).alias("agents"))
    own = F.array_contains("agents", agent.lower())
    named = agents.withColumn("own", own).withColumn("any", F.array_contains("agents", "*")).withColumn("has_own", F.max("own").over(W.partitionBy("host")))
    chosen = named.where(F.when(F.col("has_own"), F.col("own")).otherwise(F.col("any"))).select("host", "group")
    rules = grouped.where((F.col("key") != "user-agent") & F.col("value").rlike("^[/*]")).join(chosen, ["host", "group"])
    return rules.select("host", "line", (F.col("key") == "allow").alias("allow"), urls.robots_path(F.col("value")).alias("pattern"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    lines = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    url = F.trim(F.regexp_extract(F.substring_index("raw", "#", 1), r"(?i)^\s*sitemap\s*:\s*(https?://.*)$", 1))
    return lines.withColumn("url", url).where("url <> ''").groupBy("host", "url").agg(F.min("line").alias("line"))


FEW_HOSTS = 200_000  #: with rules, that a broadcast may hold; more meet their pages by shuffle
A_SHARE = 200_000  #: pages of one host that meet its rules in one task, about


def _placed(pages: DataFrame, key: str) -> DataFrame:
    """Adds _host and _path, as rules see them."""
    path = F.concat(F.coalesce(F.nullif(urls.part(F.col(key), "PATH"), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), urls.part(F.col(key), "QUERY")), F.lit("")))
    return pages.withColumn("_host", urls.host(F.col(key))).withColumn("_path", urls.robots_path(path))


def matching_rules(pages: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """key, allow and rank (the pattern's length) of the rules of its host that match a URL.

    The rules of a host are a tree of heads, the literal starts of their patterns. A path meets a rule only where it has the
    head: it is cut at each length that heads of its host have, and those cuts are equal to heads or not, so this is a join on
    (host, head). Only what comes after a wildcard is tested by pattern. Pages of a large host are dealt out in shares, and
    the host's rules are repeated for each.
    """
    asked = _placed(pages, key).select(F.col(key).alias("_key"), "_host", "_path").distinct()
    plain = ~F.col("pattern").contains("*") & ~F.col("pattern").endswith("$")
    head = F.substring_index(F.regexp_replace("pattern", r"\$$", ""), "*", 1)
    tests = rules.select(F.col("host").alias("_host"), "allow", F.length("pattern").alias("rank"), head.alias("head"), F.when(~plain, urls.robots_regex(F.col("pattern"))).alias("regex")).distinct()
    shares = asked.groupBy("_host").agg(F.ceil(F.count("*") / A_SHARE).cast("int").alias("shares"))
    hosts = tests.groupBy("_host").agg(F.collect_set(F.length("head")).alias("lengths")).join(shares, "_host")
    near = F.broadcast(hosts) if tests.select("_host").distinct().limit(FEW_HOSTS + 1).count() <= FEW_HOSTS else hosts
    cuts = asked.join(near, "_host").withColumn("share", F.pmod(F.xxhash64("_key"), F.col("shares")).cast("int"))
    cuts = cuts.withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("_path")))).withColumn("head", F.left("_path", F.col("length")))
    dealt = tests.join(shares, "_host").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    hits = cuts.select("_key", "_host", "_path", "share", "head").join(dealt, ["_host", "share", "head"]).where(F.expr("regex is null or _path rlike regex"))
    return hits.select(F.col("_key").alias(key), "allow", "rank")


def allowed(pages: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """Adds `allowed`: the longest matching rule of the host decides, allow wins a tie, no rule allows."""
    best = matching_rules(pages, rules, key).groupBy(F.col(key).alias("_key")).agg(F.max_by("allow", F.struct("rank", "allow")).alias("verdict"))
    found = _placed(pages, key).join(best, F.col(key) == F.col("_key"), "left")
    return found.withColumn("allowed", (F.col("_path") == "/robots.txt") | F.coalesce("verdict", F.lit(True))).drop("_host", "_path", "_key", "verdict")


def sitemap_entries(files: DataFrame, limit: int | None = None) -> DataFrame:
    """files (source, xml) -> source, place, url, lastmod: read by pattern, so that broken XML still gives its entries."""
    entry = r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>(.{0,300})"
    found = files.select("source", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>.*?</loc>.{0,300}?(?=<loc>|</urlset|\z|.{300})"), F.lit(0))).alias("place", "raw"))
    rows = found.select("source", "place", F.regexp_extract("raw", entry, 1).alias("url"), F.nullif(F.regexp_extract("raw", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod")).where("url <> ''")
    rows = first_wins(rows, ["url"], ["source", "place"])
    return rows.orderBy("source", "place").limit(limit) if limit else rows


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in the order given."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def site_map(sitemap: DataFrame, links: DataFrame, enough: int = 10) -> DataFrame:
    """Union of sitemap entries and home-page links (host, url, place): links only for hosts with fewer than `enough` entries."""
    counts = sitemap.groupBy("host").agg(F.count("*").alias("n"))
    extra = links.join(counts, "host", "left").where(F.coalesce("n", F.lit(0)) < enough).drop("n")
    both = sitemap.withColumn("source", F.lit("sitemap")).withColumn("rank", F.lit(0)).unionByName(extra.withColumn("source", F.lit("html_link")).withColumn("rank", F.lit(1)))
    return first_wins(both, ["host", "url"], ["rank", "place"]).drop("rank")


def crawl(edges: DataFrame, starts: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """Breadth-first depths over edges (src, dst) from starts (url): url, depth, in order of depth and then name.

    A round joins the last frontier with the edges and drops what was seen; its result is checkpointed, so that the plan
    doesn't grow with the depth.
    """
    spark = edges.sparkSession
    shared_checkpoints(spark)
    seen = starts.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = nxt.withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if max_pages:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    return seen


def shared_folder(spark) -> str:
    """The shared folder named in spark.checkpoint.dir; a local master without one gets a folder of its own."""
    import os
    import re
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {spark.sparkContext.master}")
    return named or os.path.join(tempfile.gettempdir(), f"pagewright-crawl-{os.getpid()}")


def shared_checkpoints(spark) -> None:
    """Points checkpoint() at the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def crawl_site(pages: DataFrame, links: DataFrame, start: str, rules: DataFrame | None = None, max_depth: int = 2, max_pages: int = 20) -> DataFrame:
    """Crawls stored pages (url, error) over links (src, dst) from `start`: url, depth, error of at most max_pages, nearest first.

    Only URLs of the start's host that robots rules allow are followed, and each once; pages that failed or aren't stored
    count, but lead nowhere. A depth is followed on only while pages and queue stay below twice max_pages. Order within a
    depth is that of the URLs, where the first to answer would come first.
    """
    spark = pages.sparkSession
    shared_checkpoints(spark)
    own = links.where(urls.host(F.col("dst")) == urls.host(F.lit(start))).select("src", F.substring_index("dst", "#", 1).alias("dst"))
    may = lambda df: df if rules is None else allowed(df, rules).where("allowed").select("url")
    seen = may(spark.createDataFrame([(start,)], "url string")).withColumn("depth", F.lit(0)).join(pages.select("url", "error", F.lit(True).alias("stored")), "url", "left")
    seen = seen.select("url", "depth", F.when(F.col("stored").isNull(), "not stored").otherwise(F.col("error")).alias("error")).checkpoint()
    frontier, known = seen, seen.count()
    for depth in range(1, max_depth + 1):
        if known >= 2 * max_pages:
            break
        nxt = frontier.where("error is null").join(own, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        found = may(nxt).withColumn("depth", F.lit(depth)).join(pages.select("url", "error", F.lit(True).alias("stored")), "url", "left")
        frontier = found.select("url", "depth", F.when(F.col("stored").isNull(), "not stored").otherwise(F.col("error")).alias("error")).checkpoint()
        n = frontier.count()
        if not n:
            break
        seen, known = seen.unionByName(frontier), known + n
    return seen.orderBy("depth", "url").limit(max_pages)


def batch_totals(pages: DataFrame) -> DataFrame:
    """Totals of a batch (url, error, char_count, estimated_tokens): URLs, successes, failures, characters, tokens."""
    ok = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    return pages.agg(F.count("*").alias("urls"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), total("char_count").alias("chars"), total("estimated_tokens").alias("tokens"))


def merged_rounds(reads: DataFrame, limit: int) -> DataFrame:
    """reads (page, round, place, url, pinned) of a page that grows: posts by URL up to the first round that added none, pinned ones last."""
    first = first_wins(reads, ["page", "url"], ["round", "place"])
    grew = first.select("page", "round").distinct()
    rounds = reads.select("page", "round").distinct().join(grew.withColumn("grew", F.lit(True)), ["page", "round"], "left")
    end = rounds.where("grew is null").groupBy("page").agg(F.min("round").alias("end"))
    kept = first.join(end, "page", "left").where(F.col("end").isNull() | (F.col("round") < F.col("end"))).drop("end")
    w = W.partitionBy("page").orderBy(F.coalesce("pinned", F.lit(False)), "round", "place")
    return kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Totals of crawled pages (url, depth, char_count, estimated_tokens, error)."""
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.sum("char_count").alias("chars"), F.sum("estimated_tokens").alias("tokens"), F.max("depth").alias("deepest"))


def unvisited(candidates: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return candidates.join(visited.select(key).distinct(), key, "left_anti")


# Hours for which an entry of a kind holds.
TTL_HOURS = {"page": 24, "mail_server": 6, "email": 6, "place": 24, "crawl": 1}
MOST_EMAIL_ENTRIES = 2048  #: beyond, the whole table of emails is emptied


def fresh(entries: DataFrame, kind: str, now: Column) -> DataFrame:
    """Entries (cached_at) of a kind that still hold."""
    return entries.where(F.col("cached_at") > now - F.expr(f"interval {TTL_HOURS[kind]} hours"))


def cache_purged(cache: DataFrame, now: Column, kind: str = "page") -> DataFrame:
    """What stays when entries past their time go."""
    return fresh(cache, kind, now)


def cache_size(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"))


def cached(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """requests (key) with the cached content of the last hours, and whether it was a hit."""
    fresh = cache.where(F.col("cached_at") > now - F.expr(f"interval {hours} hours"))
    return requests.join(fresh, "key", "left").withColumn("hit", F.col("cached_at").isNotNull())


def cache_merged(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """The last write of each key."""
    both = cache.unionByName(writes)
    rest = [c for c in both.columns if c not in ("key", "cached_at")]
    return both.groupBy("key").agg(F.max("cached_at").alias("cached_at"), *[F.max_by(c, "cached_at").alias(c) for c in rest])


def relevance(pages: DataFrame, term: str) -> DataFrame:
    """URLs that hold the term first, else in their order."""
    return pages.withColumn("hit", F.lower("url").contains(term.lower())).orderBy(F.col("hit").desc(), "place")


#: Keywords of contact pages by rank, whole words of a path segment or of a label of 60 characters at most.
CONTACT_WORDS = {
    0: ["contato", "contatos", "contact", "contacts", "contact-us", "contactus", "fale-conosco", "faleconosco", "atendimento"],
    1: ["sobre", "sobre-nos", "about", "about-us", "quem-somos", "quemsomos", "a-empresa", "institucional"],
    2: ["equipe", "nossa-equipe", "team", "our-team", "corpo-clinico"],
    3: ["trabalhe-conosco"],
}
#: Fixed value: endings of what is no page.
NO_PAGE = r"(?i)\.(?:pdf|jpe?g|png|gif|webp|svg|zip|rar|docx?|xlsx?|mp4|mp3)$"
MOST_CONTACT_PAGES = 3


def contact_rank(href: Column, text: Column) -> Column:
    """Rank of a link by the words of its path and its label; null if it names no contact page."""
    path = F.regexp_replace(F.coalesce(urls.part(href, "PATH"), F.lit("")), "/+$", "")
    decoded = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    keys = F.transform(F.split(path, "/"), lambda s: urls.slug(F.regexp_replace(decoded(s), r"(?i)\.(?:html?|php|aspx?)$", "")))
    label = F.when(F.length(F.trim(text)) <= 60, urls.slug(F.trim(text)))
    words = F.concat(F.lit("-"), F.array_join(F.concat(keys, F.array(F.coalesce(label, F.lit("")))), "--"), F.lit("-"))
    out = F.when(F.lit(False), 0)
    for rank, own in CONTACT_WORDS.items():
        out = out.when(words.rlike("-(?:" + "|".join(own) + ")-"), rank)
    return out


def contact_pages(links: DataFrame) -> DataFrame:
    """links (site, href, text, place) on the site's own host -> the three most promising contact pages by rank, then place.

    site is the URL of the start page, which is none itself. Links that differ in query or fragment are one.
    """
    trimmed = lambda u: F.regexp_replace(F.coalesce(urls.part(F.col(u), "PATH"), F.lit("")), "/+$", "")
    here = (urls.host(F.col("href")) == urls.host(F.col("site"))) & F.lower(urls.part(F.col("href"), "PROTOCOL")).isin("http", "https")
    own = links.where(here & (trimmed("href") != trimmed("site")) & ~trimmed("href").rlike(NO_PAGE)).withColumn("rank", contact_rank(F.col("href"), F.col("text"))).where("rank is not null")
    once = first_wins(own.withColumn("href", urls.without_query(F.substring_index("href", "#", 1))), ["site", "href"], ["place"])
    return once.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("rank", "place"))).where(F.col("n") <= MOST_CONTACT_PAGES).drop("n")


