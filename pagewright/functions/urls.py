"""URLs: canonical form, cache key, domain key, patterns, robots patterns, coordinates, handles, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .rx import fold_accents

# Fixed values.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
MAX_PATTERNS, MAX_PATTERN_LENGTH = 10, 200
SOCIAL_HOSTS = {"instagram": ["instagram.com"], "linkedin": ["linkedin.com"], "reddit": ["reddit.com"], "twitter": ["twitter.com", "x.com"]}


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def host_in(h: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def canonical(url: Column) -> Column:
    """Without fragment and tracking keys, parameters sorted by name (equal names keep their order)."""
    bare = F.substring_index(url, "#", 1)
    head, query = F.substring_index(bare, "?", 1), F.when(bare.contains("?"), F.substring(bare, F.instr(bare, "?") + 1, 1 << 20))
    pieces = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING_KEYS))
    keyed = F.array_sort(F.transform(pieces, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), p.alias("p"))))
    joined = F.array_join(F.transform(keyed, lambda x: F.when(x["p"].contains("="), x["p"]).otherwise(F.concat(x["p"], F.lit("=")))), "&")
    whole = F.when(head.rlike(r"^[a-zA-Z]+://[^/]+$"), F.concat(head, F.lit("/"))).otherwise(head)
    lower = F.regexp_replace(F.concat(F.lower(F.regexp_extract(whole, r"^[a-zA-Z]+://[^/]*", 0)), F.regexp_replace(whole, r"^[a-zA-Z]+://[^/]*", "")), r"^(http://[^/:]*):80/|^(https://[^/:]*):443/", "$1$2/")
    return F.when(part(url, "HOST").isNull(), url).otherwise(F.concat(lower, F.when(F.coalesce(joined, F.lit("")) != "", F.concat(F.lit("?"), joined)).otherwise("")))


def cache_key(url: Column, mode: str = "fast", selector: str = "", version: str = "1", link_format: str | None = None, image_mode: str | None = None) -> Column:
    """SHA-256 of the canonical request as JSON, keys in a fixed order, nulls written out."""
    quoted = lambda s: F.to_json(F.array(s if isinstance(s, Column) else F.lit(s)))
    text = lambda s: F.lit("null") if s is None else F.regexp_replace(quoted(s), r"^\[|\]$", "")
    body = F.concat(
        F.lit('{"url":'), text(canonical(url)), F.lit(',"mode":'), text(mode), F.lit(',"cssSelector":'), text(selector),
        F.lit(',"pipelineVersion":'), text(version), F.lit(',"variant":null,"linkFormat":'), text(link_format), F.lit(',"imageMode":'), text(image_mode), F.lit("}"),
    )
    return F.sha2(body, 256)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def domain_key(website: Column, title: Column) -> Column:
    """Host without www.; where there is no usable one, a slug of the title."""
    full = F.when(website.rlike("(?i)^https?://"), website).otherwise(F.concat(F.lit("https://"), website))
    h = F.regexp_replace(host(full), r"^www\.", "")
    name = slug(F.coalesce(title, F.lit("lead")))
    return F.when((website != "") & h.contains("."), h).otherwise(F.concat(F.when(name == "", "lead").otherwise(name), F.lit(".surrogate")))


def pattern_regex(pattern: str) -> str:
    """A substring pattern with * as its only wildcard, as a regular expression; refuses what looks like one already."""
    if len(pattern) > MAX_PATTERN_LENGTH:
        raise ValueError(f"pattern is longer than {MAX_PATTERN_LENGTH} characters")
    if re.search(r"[\\^$()\[\]{}|]|\.\*", pattern):
        raise ValueError(f"invalid pattern {pattern!r}: * is the only wildcard")
    return "(?s)" + ".*?".join(re.escape(p) for p in pattern.split("*") if p)


def passes(url: Column, own_host: str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Same host, no exclude pattern in path or whole URL, and an include pattern if there are any."""
    for kind in (include, exclude):
        if len(kind) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} patterns")
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    hit = lambda p: path.rlike(pattern_regex(p)) | url.rlike(pattern_regex(p))
    out = host(url) == own_host
    for p in exclude:
        out = out & ~hit(p)
    if include:
        any_ = F.lit(False)
        for p in include:
            any_ = any_ | hit(p)
        out = out & any_
    return F.coalesce(out, F.lit(False))


def robots_regex(pattern: Column) -> Column:
    """A robots pattern (* any run, a last $ anchors) as a regular expression from the path's start."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_path(path: Column) -> Column:
    """Escapes of unreserved characters decoded, other escapes in upper case, other than ASCII escaped."""
    raw = F.regexp_extract_all(path, F.lit(r"(%[0-9A-Fa-f]{2}|[\x00-\x7f]|[^\x00-\x7f])"), F.lit(1))

    def one(x):
        char = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))
        escaped = F.when(char.rlike(r"^[A-Za-z0-9\-._~]$"), char).otherwise(F.upper(x))
        return F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), escaped).when(x.rlike(r"^[^\x00-\x7f]$"), F.url_encode(x)).otherwise(x)

    return F.array_join(F.transform(raw, one), "")


def coordinates(url: Column) -> Column:
    """Latitude and longitude of a map URL: of its !3d..!4d part, else after the @."""
    number = r"(-?\d+(?:\.\d+)?)"
    a, b = rf"!3d{number}!4d{number}", rf"@{number},{number}"
    pick = lambda g: F.when(url.rlike(a), F.regexp_extract(url, a, g)).when(url.rlike(b), F.regexp_extract(url, b, g)).cast("double")
    return F.struct(pick(1).alias("lat"), pick(2).alias("lon"))


def place_id(url: Column) -> Column:
    """In this order: after !1s, of place_id=, a pair of hex numbers."""
    out = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"!1s([^!&?]+)", r"[?&]place_id=([^&]+)", r"(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)")]
    return F.coalesce(*out)


def unwrap_redirect(url: Column) -> Column:
    """Target of a /url?q= link; other URLs as they are."""
    q = F.regexp_extract(url, r"^(?:https?://[^/]+)?/url\?(?:.*&)?q=([^&]+)", 1)
    return F.when(q != "", F.coalesce(F.try_url_decode(q), q)).otherwise(url)


def platform(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, domains in SOCIAL_HOSTS.items():
        out = out.when(host_in(host(url), domains), name)
    return out.otherwise("unknown")


# What the path of a profile must or must not hold, by network; a link to a post or a share button is no profile.
PROFILE_PATHS = {
    "instagram": (None, ["/p/", "/stories/", "/explore/"]), "linkedin": (["/company/", "/in/"], []), "facebook": (None, ["/sharer", "/share.php"]),
    "twitter": (None, ["/intent/", "/share"]), "youtube": (["/@", "/channel/", "/c/"], []), "github": (None, []), "tiktok": (["/@"], []),
}
PROFILE_HOSTS = {"instagram": ["instagram.com"], "linkedin": ["linkedin.com"], "facebook": ["facebook.com"], "twitter": ["twitter.com", "x.com"], "youtube": ["youtube.com"], "github": ["github.com"], "tiktok": ["tiktok.com"]}
# Hosts of profiles, which are no websites of their own.
SOCIAL_DOMAINS = ["instagram.com", "facebook.com", "fb.com", "tiktok.com", "twitter.com", "x.com", "linkedin.com", "wa.me", "whatsapp.com", "linktr.ee"]


def network(url: Column) -> Column:
    """The network of which a URL is a profile, by its host and path; null for other links."""
    low, out = F.lower(url), F.when(F.lit(False), "")
    any_of = lambda parts: F.array_contains(F.array(*[low.contains(p) for p in parts]), True)
    for name, domains in PROFILE_HOSTS.items():
        wanted, barred = PROFILE_PATHS[name]
        ok = F.lit(True) if wanted is None else any_of(wanted)
        out = out.when(host_in(host(url), domains), F.when(ok & ~any_of(barred) if barred else ok, name))
    return out


def normalised_url(raw: Column) -> Column:
    """An http(s) URL, with https:// where there is no scheme; null for any other text."""
    v = F.trim(raw)
    whole = F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v))
    return F.when((v != "") & part(whole, "PROTOCOL").isin("http", "https") & (F.coalesce(part(whole, "HOST"), F.lit("")) != ""), whole)


def social_domain(raw: Column) -> Column:
    """The network's domain of a profile URL, else null."""
    h = F.regexp_replace(host(normalised_url(raw)), r"^www\.", "")
    out = F.when(F.lit(False), "")
    for d in SOCIAL_DOMAINS:
        out = out.when((h == d) | h.endswith("." + d), d)
    return out


def site_and_instagram(website: Column, instagram: Column) -> Column:
    """Struct website, instagram of a row's two cells: a profile in the website's place is no website, but may be the profile."""
    site, profile = normalised_url(website), F.when(social_domain(instagram) == "instagram.com", normalised_url(instagram))
    where = social_domain(website)
    return F.struct(F.when(where.isNull(), site).alias("website"), F.coalesce(profile, F.when(where == "instagram.com", site)).alias("instagram"))


def email_site(website: Column) -> Column:
    """Whether a website may hold addresses: there is one, and it is no profile."""
    return (F.coalesce(website, F.lit("")) != "") & social_domain(website).isNull()


def without_query(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def video_handle(raw: Column) -> Column:
    """Handle of 2 to 24 letters, digits, dots or underscores, from an @name or a profile URL; null if it is none."""
    bare = F.regexp_replace(F.trim(raw), r"^(?i)(?:https?://)?(?:www\.|m\.)?tiktok\.com/", "")
    name = F.lower(F.regexp_replace(F.substring_index(F.substring_index(bare, "?", 1), "/", 1), "^@", ""))
    return F.when(name.rlike(r"^[a-z0-9._]{2,24}$") & ~name.endswith("."), name)


def shortcode_to_pk(code: Column) -> Column:
    """A base-64 short code as its decimal number; 11 characters are 66 bits, so decimals carry it."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    zero = F.lit(0).cast("decimal(38,0)")
    places = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.instr(F.lit(digits), F.substr(code, i, F.lit(1))) - 1)
    total = F.aggregate(places, zero, lambda acc, d: (acc * F.lit(64).cast("decimal(3,0)") + d.cast("decimal(3,0)")).cast("decimal(38,0)"))
    return F.when(code.rlike("^[A-Za-z0-9_-]{1,20}$"), total.cast("string"))


def ipv4_private(ip: Column) -> Column:
    """Whether an IPv4 address is local, reserved or not routed; null if it is no such address."""
    octet = [F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i) for i in (1, 2, 3, 4)]
    a, b, c, d = (F.when(o != "", o.cast("int")) for o in octet)
    local = (
        a.isin(0, 10, 127) | (a >= 224) | (a == 100) & b.between(64, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31)
        | (a == 192) & (b == 168) | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & b.isin(18, 19) | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
    )
    return F.when(a.isNotNull() & (F.greatest(a, b, c, d) <= 255), local)


def _private(text: str | None) -> bool | None:
    import ipaddress

    if text is None:
        return None
    try:
        ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
    except ValueError:
        return True  # what can't be read isn't let out
    if ip.version == 6:
        inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo[1] if ip.teredo else None)
        if inner is None and (int(ip) >> 96 in (0, 0x64FF9B << 64) or int(ip) >> 32 == 0x64FF9B << 64):
            inner = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
        if inner is not None:
            return bool(not inner.is_global or inner.is_multicast)
    return bool(not ip.is_global or ip.is_multicast)


@F.pandas_udf(T.BooleanType())
def ip_private(ips):
    """Either version, embedded IPv4 addresses included; unreadable counts as private."""
    import pandas as pd

    return pd.Series([_private(x) for x in ips], dtype=object)


def target_problem(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may."""
    h = host(url)
    scheme = F.lower(part(url, "PROTOCOL"))
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "missing URL")
        .when(h.isNull() | scheme.isNull(), "invalid URL")
        .when(~scheme.isin("http", "https"), "only http and https")
        .when(part(url, "USERINFO").isNotNull(), "credentials in URL")
        .when((h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal") | F.coalesce(ipv4_private(h), F.lit(False)), "private or local host")
    )
