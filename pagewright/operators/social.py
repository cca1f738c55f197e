"""Captured social payloads: videos, trends, forum posts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers, pages, urls
from ..functions.rx import let, trimmed
from .crawl import first_wins

FOLLOWERS, FOLLOWING, POSTS = ["followers", "seguidores"], ["following", "seguindo"], ["posts", "publicações", "publicacoes", "threads"]
PLAYLIST = "entries array<struct<id:string,url:string,uploader:string,description:string,title:string,timestamp:bigint,view_count:bigint,like_count:bigint,comment_count:bigint,repost_count:bigint,duration:double>>"
STATS = "struct<playCount:string,diggCount:string,commentCount:string,shareCount:string>"
ITEM = f"id:string,desc:string,createTime:string,author:struct<uniqueId:string>,video:struct<duration:string>,stats:{STATS},statsV2:{STATS}"
VIDEO = "https://www.tiktok.com/@%s/video/%s"


def iso(seconds: Column) -> Column:
    at = F.timestamp_seconds(F.nullif(seconds.cast("long"), F.lit(0).cast("long")))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def playlist_videos(rows: DataFrame) -> DataFrame:
    """rows (handle, raw) -> a video for each entry."""
    e = rows.select("handle", F.posexplode(F.from_json("raw", PLAYLIST)["entries"]).alias("place", "e")).where("e is not null")
    c = lambda n: F.col(f"e.{n}")
    return e.select(
        "handle", "place", c("id").alias("id"), F.coalesce(F.nullif(c("url"), F.lit("")), F.format_string(VIDEO, "handle", "e.id")).alias("url"), F.coalesce(F.nullif(c("uploader"), F.lit("")), "handle").alias("author"),
        F.coalesce(c("description"), c("title"), F.lit("")).alias("description"), iso(c("timestamp")).alias("created"), c("view_count").alias("views"), c("like_count").alias("likes"), c("comment_count").alias("comments"),
        c("repost_count").alias("shares"), F.nullif(c("duration"), F.lit(0.0)).alias("seconds"),
    )


def item_videos(rows: DataFrame) -> DataFrame:
    """rows (source_rank, place, raw: one item) -> videos, the first of each id; stats go before statsV2."""
    i = rows.select("source_rank", "place", F.from_json("raw", f"struct<{ITEM}>").alias("i")).where("i.id is not null and i.id <> ''")
    stat = lambda n: F.coalesce(F.col(f"i.stats.{n}"), F.col(f"i.statsV2.{n}")).try_cast("long")
    author = F.coalesce(F.col("i.author.uniqueId"), F.lit(""))
    made = i.select(
        "source_rank", "place", F.col("i.id").alias("id"), F.format_string(VIDEO, author, "i.id").alias("url"), author.alias("author"), F.coalesce("i.desc", F.lit("")).alias("description"), iso(F.col("i.createTime").try_cast("long")).alias("created"),
        stat("playCount").alias("views"), stat("diggCount").alias("likes"), stat("commentCount").alias("comments"), stat("shareCount").alias("shares"), F.nullif(F.col("i.video.duration").try_cast("double"), F.lit(0.0)).alias("seconds"),
    )
    return first_wins(made, ["id"], ["source_rank", "place"])


def page_data_videos(pages_: DataFrame) -> DataFrame:
    """pages (page_rank, bodies: the list answers that a page loaded, rehydration: its own data) -> videos, the first of each id.

    Answers go before the page's own data, in their order; what is no JSON gives nothing.
    """
    items = lambda text, path: F.from_json(F.get_json_object(text, path), "array<string>")
    lists = F.concat(F.transform("bodies", lambda b: items(b, "$.itemList")), F.array(items(F.col("rehydration"), "$.__DEFAULT_SCOPE__['webapp.user-detail'].userInfo.itemList")))
    each = pages_.select("page_rank", F.posexplode(lists).alias("list", "items")).select("page_rank", "list", F.posexplode("items").alias("place", "raw"))
    return item_videos(each.select(F.struct("page_rank", "list").alias("source_rank"), "place", "raw")).drop("source_rank", "place")


_POST = "url string, author string, text string, publishedAt string, views string, likes string, replies string, reposts string, actions array<struct<label:string,text:string>>"


def read_posts(rows: DataFrame) -> DataFrame:
    """rows (platform, handle, place, raw: what a page reader gave for a post) -> posts; a count that isn't shown is null.

    Grids of two networks show no author, date or counts but views; the others' counts stand in the post, or in its actions.
    """
    p = rows.withColumn("p", F.from_json("raw", _POST)).where("p.url is not null")
    shown = F.col("platform").isin("threads", "x")
    count = lambda n: numbers.leading_count(F.col(f"p.{n}"))
    of = lambda *labels: F.array_max(F.transform(F.filter("p.actions", lambda a: F.lower(a["label"]).isin(*labels)), lambda a: numbers.leading_count(a["text"])))
    threads, x = F.col("platform") == "threads", F.col("platform") == "x"
    text = F.coalesce("p.text", F.lit(""))
    return p.select(
        "platform", "handle", "place", F.col("p.url").alias("url"), F.when(shown, F.col("p.author")).otherwise(F.col("handle")).alias("author"),
        F.when(threads, post_text(text)).when(F.col("platform") == "tiktok", video_caption(text)).otherwise(text).alias("text"), F.when(shown, F.nullif("p.publishedAt", F.lit(""))).alias("published"),
        F.when(x | (F.col("platform") == "tiktok"), count("views")).alias("views"), F.when(threads, of("curtir", "like")).when(x, count("likes")).alias("likes"),
        F.when(threads, of("responder", "reply")).when(x, count("replies")).alias("comments"),
        F.when(threads, numbers.sum_known(of("repostar", "repost"), of("compartilhar", "share"))).when(x, count("reposts")).alias("shares"),
    )


def hashtags(rows: DataFrame) -> DataFrame:
    """rows (page, raw) -> trends; rank is the list's own index, else the position."""
    kind = "items array<struct<rankIndex:string,hashtagID:string,hashtagName:string,vv:string,publishCnt:string>>"
    e = rows.select("page", F.posexplode(F.from_json("raw", kind)["items"]).alias("place", "e"))
    return e.select("page", F.coalesce(F.col("e.rankIndex").try_cast("int"), F.col("place") + 1).alias("rank"), F.col("e.hashtagID").alias("id"), F.col("e.hashtagName").alias("name"), F.concat(F.lit("https://www.tiktok.com/tag/"), F.replace(F.url_encode("e.hashtagName"), F.lit("+"), F.lit("%20"))).alias("url"), F.col("e.vv").try_cast("long").alias("views"), F.col("e.publishCnt").try_cast("long").alias("posts"))


def top_videos(rows: DataFrame) -> DataFrame:
    kind = "entityInfos array<struct<itemAuthorInfo:struct<handlerName:string>,itemInfo:struct<itemID:string,title:string,createTime:string>,itemMetrics:struct<videoViews:string>>>"
    e = rows.select("page", F.posexplode(F.from_json("raw", kind)["entityInfos"]).alias("place", "e"))
    handle, id_ = F.nullif(F.col("e.itemAuthorInfo.handlerName"), F.lit("")), F.col("e.itemInfo.itemID")
    return e.select("page", (F.col("place") + 1).alias("rank"), id_.alias("id"), F.trim(F.coalesce("e.itemInfo.title", F.lit(""))).alias("name"), F.when(handle.isNotNull(), F.format_string(VIDEO, handle, id_)).otherwise(F.concat(F.lit("https://www.tiktok.com/video/"), id_)).alias("url"), F.col("e.itemMetrics.videoViews").try_cast("long").alias("views"), handle.alias("author"), iso(F.col("e.itemInfo.createTime").try_cast("long")).alias("created"))


def forum_posts(rows: DataFrame, now: Column) -> DataFrame:
    """rows (query, raw) -> posts with a title, their category and a snippet of 200 characters."""
    kind = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,subreddit:string,author:string,url:string,permalink:string,score:bigint,num_comments:bigint,created_utc:double>>>>"
    e = rows.select("query", F.posexplode(F.from_json("raw", kind)["data"]["children"]).alias("place", "c")).select("query", "place", "c.data.*").where("title is not null and title <> ''")
    link = F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit("")))
    body = F.coalesce(F.nullif(F.col("selftext"), F.lit("")), "title")
    return e.select(
        "query", "place", "id", "title", F.coalesce(F.nullif(F.col("subreddit"), F.lit("")), F.lit("unknown")).alias("subreddit"), F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("anonymous")).alias("author"),
        F.coalesce(F.nullif(F.col("url"), F.lit("")), link).alias("url"), link.alias("permalink"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("comments"),
        F.coalesce(iso(F.col("created_utc")), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("created"), trimmed(F.regexp_replace(F.substring(body, 1, 200), r"\s+", " ")).alias("snippet"),
        pages.forum_category(F.col("title"), F.col("selftext")).alias("category"),
    )


def profile_from_header(header: Column) -> Column:
    return F.struct(numbers.count_before(header, FOLLOWERS).alias("followers"), numbers.count_before(header, FOLLOWING).alias("following"), numbers.count_before(header, POSTS).alias("posts"))


# Words and marks of public profile pages.
_COUNT = r"([\d.,]+\s*[KkMm]?)"
_COUNTS = rf"(?i){_COUNT}\s*(?:Followers|seguidores)[,\s]+{_COUNT}\s*(?:Following|seguindo)[,\s]+{_COUNT}\s*(?:Posts|publicações)"
_BUSINESS = r"(?i)(?:contato|agendamentos|consultas|crm|cro|oab|cnpj|direct|linktr\.ee)"
_NO_HANDLES = {"instagram": ["p", "reel", "explore", "stories"], "twitter": ["home", "explore", "search"]}


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _handle(url: Column, pattern: str, network: str) -> Column:
    found = _found(url, pattern)
    return F.when(~F.lower(found).isin(_NO_HANDLES[network]), found)


def _grouped(n: Column) -> Column:
    """A number as Brazilian readers see it."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def instagram_profile(html: Column, url: Column) -> Column:
    """Struct of a stored public profile page by its meta tags and marks, with a short summary."""
    title, about = F.coalesce(pages.meta_tag(html, "og:title"), F.lit("")), F.coalesce(pages.meta_tag(html, "og:description"), F.lit(""))
    seen = F.struct(title.alias("title"), about.alias("about"), _found(html, r"(?is)<script type=\"application/ld\+json\">(.*?)</script>").alias("ld"))

    def parts(s: Column) -> Column:
        counted = s["about"].rlike(_COUNTS)
        count = lambda k: numbers.shorthand(_found(s["about"], _COUNTS, k))
        alone = numbers.shorthand(_found(s["about"], rf"(?i){_COUNT}\s*(?:Followers|seguidores)"))
        after = trimmed(F.regexp_replace(s["about"], r"^.*?[–-]\s*", ""))
        bio = F.when(counted & (after != "") & ~F.lower(after).startswith("see instagram"), after)
        own = trimmed(F.regexp_replace(F.regexp_extract(s["title"], r"^([^(@]+)", 1), "•.*", ""))
        handle = F.coalesce(_handle(url, r"(?i)instagram\.com/([a-zA-Z0-9._-]+)", "instagram"), _found(s["title"], r"^[^(@]+\(@([a-zA-Z0-9._-]+)\)"))
        return F.struct(
            handle.alias("handle"), F.coalesce(F.nullif(own, F.lit("")), F.get_json_object(s["ld"], "$.name")).alias("name"), F.coalesce(bio, F.get_json_object(s["ld"], "$.description")).alias("bio"),
            F.when(counted, count(1)).otherwise(alone).alias("followers"), F.when(counted, count(2)).alias("following"), F.when(counted, count(3)).alias("posts"),
            (html.contains('"is_verified":true') | html.contains('"verified":true') | s["about"].contains("Verified")).alias("verified"),
        )

    def summed(p: Column) -> Column:
        business = html.contains('"is_business_account":true') | html.contains('"is_professional_account":true') | F.coalesce(p["bio"].rlike(_BUSINESS), F.lit(False))
        who = F.coalesce(F.concat(F.lit("@"), p["handle"]), p["name"], F.lit("Instagram Profile"))
        followers = F.coalesce(F.concat(_grouped(p["followers"]), F.lit(" seguidores")), F.lit("Seguidores N/D"))
        bio = F.coalesce(F.concat(F.lit(' | Bio: "'), trimmed(F.regexp_replace(F.substring(p["bio"], 1, 100), r"\s+", " ")), F.lit('"')), F.lit(""))
        marks = F.concat(F.when(p["verified"], " [Verificado]").otherwise(""), F.when(business, " [Comercial]").otherwise(""))
        summary = F.concat(F.lit("[Instagram "), who, marks, F.lit("] "), followers, bio)
        return F.struct(*[p[n].alias(n) for n in ("handle", "name", "bio", "followers", "following", "posts", "verified")], business.alias("business"), _found(p["bio"], r"(?i)(https?://\S+)").alias("external_url"), summary.alias("summary"))

    return let(let(seen, parts), summed)


def linkedin_profile(html: Column, url: Column) -> Column:
    """Struct of a stored public page of a company or a person by its meta tags, with a short summary."""
    title, about = F.coalesce(pages.meta_tag(html, "og:title"), F.lit("")), F.coalesce(pages.meta_tag(html, "og:description"), F.lit(""))
    company = F.lower(url).contains("/company/")
    handle = _found(url, r"(?i)linkedin\.com/(?:company|in)/([a-zA-Z0-9._-]+)")

    def parts(s: Column) -> Column:
        name = F.coalesce(F.nullif(trimmed(F.regexp_replace(s["title"], r"(?i)\s*\|\s*LinkedIn.*$", "")), F.lit("")), handle)
        pieces = F.transform(F.split(s["about"], r"\|"), trimmed)
        kept = F.filter(pieces, lambda x: ~x.eqNullSafe(name) & ~x.rlike("(?i)funcionários|employees|seguidores|followers") & (x != ""))
        return F.struct(
            name.alias("name"), F.when(~company, F.coalesce(F.nullif(s["about"], F.lit("")), s["title"])).alias("headline"),
            F.when(company, trimmed(_found(s["about"], r"(?i)(\d+[\d\s–-]*\+?\s*funcionários|\d+[\d\s–-]*\+?\s*employees)"))).alias("company_size"), F.when(company, F.try_element_at(kept, F.lit(1))).alias("industry"),
            F.when(company, numbers.shorthand(_found(s["about"], rf"(?i){_COUNT}\s*(?:followers|seguidores)"))).alias("followers"),
        )

    def summed(p: Column) -> Column:
        said = lambda before, value, after="": F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))
        label = F.when(company, "[LinkedIn Empresa ").otherwise("[LinkedIn Perfil ")
        tail = F.concat(said(" | ", _grouped(p["followers"]), " seguidores"), said(" | Porte: ", p["company_size"]), said(" | Setor: ", p["industry"]), said(' | Headline: "', F.substring(F.nullif(p["headline"], F.lit("")), 1, 80), '"'))
        return F.struct(handle.alias("handle"), *[p[n].alias(n) for n in ("name", "headline", "company_size", "industry", "followers")], F.concat(label, F.coalesce(p["name"], F.lit("")), F.lit("]"), tail).alias("summary"))

    return let(let(F.struct(title.alias("title"), about.alias("about")), parts), summed)


def twitter_profile(html: Column, url: Column) -> Column:
    """Struct of a stored public profile page by its meta tags, with a short summary."""
    title, bio = F.coalesce(pages.meta_tag(html, "og:title"), F.lit("")), F.coalesce(pages.meta_tag(html, "og:description"), F.lit(""))
    handle = _handle(url, r"(?i)(?:twitter|x)\.com/([a-zA-Z0-9_]+)", "twitter")

    def summed(p: Column) -> Column:
        who = F.coalesce(F.concat(F.lit("@"), p["handle"]), p["name"], F.lit("Twitter Profile"))
        about = F.when(p["bio"] != "", F.concat(F.lit(' | Bio: "'), F.substring(p["bio"], 1, 80), F.lit('"'))).otherwise("")
        return F.struct(p["handle"].alias("handle"), p["name"].alias("name"), p["bio"].alias("bio"), F.concat(F.lit("[Twitter/X "), who, F.lit("]"), about).alias("summary"))

    name = F.coalesce(F.nullif(trimmed(F.regexp_replace(title, r"(?i)\s*\(@[a-zA-Z0-9_]+\)\s*/.*$", "")), F.lit("")), handle)
    return let(F.struct(handle.alias("handle"), name.alias("name"), bio.alias("bio")), summed)


def profile_of_page(html: Column, url: Column) -> Column:
    """Platform, name, description and counts of a stored profile page of any network, from its meta tags."""
    title, about = pages.meta_tag(html, "og:title"), pages.meta_tag(html, "og:description")
    return F.struct(urls.platform(url).alias("platform"), F.coalesce(title, pages.html_title(html)).alias("name"), F.coalesce(about, pages.meta_tag(html, "description")).alias("about"), numbers.count_before(F.coalesce(about, F.lit("")), FOLLOWERS).alias("followers"))


def action_metrics(actions: DataFrame) -> DataFrame:
    """actions (post_id, label, text) -> likes, comments, shares: reposts and shares add up, none known is null."""
    value = numbers.leading_count(F.col("text"))
    pick = lambda *labels: F.max(F.when(F.lower("label").isin(*labels), value))
    out = actions.groupBy("post_id").agg(pick("curtir", "like").alias("likes"), pick("responder", "reply").alias("comments"), pick("repostar", "repost").alias("reposts"), pick("compartilhar", "share").alias("sends"))
    return out.select("post_id", "likes", "comments", numbers.sum_known(F.col("reposts"), F.col("sends")).alias("shares"))


def post_text(text: Column) -> Column:
    """Without the translate button and the carousel counter."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.trim(x)).isin("traduzir", "translate", "ver tradução", "see translation"))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\s*\n\d+\n/\n\d+\s*$", ""))


def video_caption(alt: Column) -> Column:
    made = F.regexp_extract(alt, r"(?s)^(.*?)\s+(?:criado por \S.* com a música|created by \S.* with) .*$", 1)
    return trimmed(F.when(made != "", made).otherwise(alt))


# Hosts of the networks that are watched, and first path segments that are no profiles.
WATCHED = {"tiktok": ["tiktok.com"], "instagram": ["instagram.com"], "threads": ["threads.com", "threads.net"], "facebook": ["facebook.com"], "x": ["x.com", "twitter.com"]}
NOT_PROFILES = ["p", "reel", "reels", "explore", "stories", "search", "home", "i", "hashtag", "groups", "watch", "settings", "messages", "post", "status", "intent", "share"]
PROFILE = {"tiktok": "https://www.tiktok.com/@%s", "instagram": "https://www.instagram.com/%s/", "threads": "https://www.threads.com/@%s", "facebook": "https://www.facebook.com/%s", "x": "https://x.com/%s"}


def watch_target(raw: Column, platform: Column) -> Column:
    """Struct platform, handle, url of a profile URL, or of a handle with its platform; all null where it is neither."""
    v = trimmed(raw)
    is_url = v.rlike("(?i)^https?://")
    h = urls.host(v)
    found = F.when(F.lit(False), "")
    for name, domains in WATCHED.items():
        found = found.when(urls.host_in(h, domains), name)
    found = F.when(is_url, found).when(F.lower(platform).isin(*WATCHED), F.lower(platform))
    path = F.coalesce(urls.part(v, "PATH"), F.lit(""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    first = F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))
    name = F.regexp_replace(F.when(is_url, first).otherwise(v), "^@", "")
    route = F.lower(name).isin(NOT_PROFILES) & ~(is_url & first.startswith("@"))
    plain = name.rlike("^[A-Za-z0-9._-]{1,64}$") & ~route
    face = is_url & (found == "facebook")
    number = F.regexp_extract(F.coalesce(urls.part(v, "QUERY"), F.lit("")), r"(?:^|&)id=(\d+)(?:&|$)", 1)
    numbered = face & (first == "profile.php") & (number != "")
    feed = face & F.when(first == "groups", F.size(segments) == 2).otherwise((F.size(segments) == 1) & ~F.lower(first).isin(NOT_PROFILES) & (first != "profile.php"))
    good = found.isNotNull() & F.when(face, numbered | feed).otherwise(plain)
    handle = F.when(numbered, F.concat(F.lit("profile.php?id="), number)).when(face, F.regexp_replace(path, "/+$", "")).otherwise(name)
    link = F.when(numbered, F.concat(F.lit("https://www.facebook.com/"), handle)).when(face, F.concat(F.lit("https://www.facebook.com"), path))
    for p, form in PROFILE.items():
        link = link.when(found == p, F.format_string(form, handle))
    return F.struct(F.when(good, found).alias("platform"), F.when(good, handle).alias("handle"), F.when(good, link).alias("url"), F.when(~F.coalesce(good, F.lit(False)), "not a profile").alias("reason"))


_COUNTED = rf"(?iu)^\d[\d.,\s]*(?:milh(?:ão|ões)|million|bilh(?:ão|ões)|billion|mil|mi|bi|k|m|b)?\s+(?:{'|'.join([*FOLLOWERS, *FOLLOWING, *POSTS])})$"
_BIO_END = r"(?iu)^(mais|more|seguir|follow|enviar mensagem|message)$|^(seguido\(a\) por|followed by) |^[\w.-]+\.[a-z]{2,}(/|$)"


def header_name_bio(header: Column) -> Column:
    """Name and bio of a profile header's lines: handle, name, counts, then the bio up to a button or link."""
    lines = F.filter(F.transform(F.split(header, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    second = F.try_element_at(lines, F.lit(2))
    marks = F.transform(lines, lambda x: x.rlike(r"(?iu)(?:^|[^\p{L}])(seguindo|following)$"))
    after = F.when(F.array_position(marks, True) > 0, F.slice(lines, F.array_position(marks, True).cast("int") + 1, 1000)).otherwise(F.array().cast("array<string>"))
    stops = F.array_position(F.transform(after, lambda x: x.rlike(_BIO_END)), True).cast("int")
    bio = F.when(stops > 0, F.slice(after, 1, stops - 1)).otherwise(after)
    return F.struct(F.when(~second.rlike(_COUNTED), second).alias("name"), F.nullif(F.array_join(bio, "\n"), F.lit("")).alias("bio"))


def description_bio(og: Column) -> Column:
    """The bio within a description: without counts and the closing sentence."""
    parts = F.filter(F.split(og, " • "), lambda x: ~F.trim(x).rlike(_COUNTED))
    bare = F.regexp_replace(F.array_join(parts, " • "), r"(?iu)\s*(?:Veja as conversas mais recentes com|See the latest conversations with) @\S+$", "")
    return F.nullif(F.trim(bare), F.lit(""))
