"""Leads: dedupe, filters, statistics, contacts, enrichment, competitors, plans, outreach, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rx import let
from ..functions import email, numbers, pages, phone, urls
from .crawl import first_wins


def lead_key(cid: Column, title: Column, address: Column) -> Column:
    """The map id as it is, else title and address in lower case."""
    return F.coalesce(F.nullif(cid, F.lit("")), F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("_"), F.coalesce(address, F.lit("")))))


def deduplicated(leads: DataFrame, order: list) -> DataFrame:
    return first_wins(leads.withColumn("lead_key", lead_key(F.col("cid"), F.col("title"), F.col("address"))), ["lead_key"], order)


def is_instagram(url: Column) -> Column:
    return urls.host_in(urls.host(F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))), ["instagram.com"])


def category_list(raw: Column, single: Column) -> Column:
    """Categories of a row: its list, else its single one."""
    got = numbers.parse_list(raw)
    return F.when(F.size(got) > 0, got).otherwise(F.filter(F.array(F.trim(single)), lambda c: c != ""))


def filtered(rows: DataFrame, search: str = "", category: str = "", min_rating: float = 0, has_phone: bool | None = None, has_email: bool | None = None, has_website: bool | None = None, has_instagram: bool | None = None) -> DataFrame:
    """Result rows (all text: title, category, phone, website, emails, review_rating, ...) that pass; None asks nothing."""
    out = rows
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    if search:
        out = out.where(F.lower(F.concat_ws(" ", *text)).contains(search.lower()))
    if category:
        out = out.where(F.lower(F.array_join(category_list(F.col("categories"), F.col("category")), " ")).contains(category.lower()))
    if min_rating > 0:
        rating = F.coalesce(F.nullif(F.regexp_extract(F.col("review_rating").cast("string"), r"^\s*([+-]?\d*\.?\d+)", 1), F.lit("")).cast("double"), F.lit(0.0))
        out = out.where(rating >= min_rating)
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    instagram = filled("website") & F.coalesce(is_instagram(F.col("website")), F.lit(False))
    for want, have in ((has_phone, filled("phone")), (has_email, filled("emails")), (has_website, filled("website") & ~instagram), (has_instagram, instagram)):
        if want is not None:
            out = out.where(have == want)
    return out


def page_of(rows: DataFrame, order: list, limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of the rows in order; the limit is kept between 1 and `most`."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(most, limit if limit > 0 else 100))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: totals, shares and the mean of the ratings that can be read (commas allowed)."""
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    instagram = filled("website") & F.coalesce(is_instagram(F.col("website")), F.lit(False))
    rating = F.replace(F.trim(F.col("review_rating").cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(filled("phone")).alias("with_phone"), F.count_if(filled("website") & ~instagram).alias("with_website"),
        F.count_if(instagram).alias("with_instagram"), F.count_if(filled("emails")).alias("with_email"), F.avg(rating).alias("average_rating"),
    )


def category_counts(rows: DataFrame) -> DataFrame:
    first = F.try_element_at(category_list(F.col("categories"), F.col("category")), F.lit(1))
    return rows.withColumn("primary", first).where("primary is not null").groupBy("primary").agg(F.count("*").alias("n"))


def within_radius(places: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Places within a radius, nearest first. A box test on the raw columns reaches the scan before the distance."""
    from math import cos, radians

    high = metres / 111_000 + 1e-6
    wide = 180 if abs(lat) + high >= 89.9 else min(180, high / cos(radians(abs(lat) + high)))
    near = places.where(F.col("latitude").between(lat - high, lat + high))
    if wide < 180 and -180 < lon - wide and lon + wide < 180:
        near = near.where(F.col("longitude").between(lon - wide, lon + wide))
    d = numbers.haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return near.withColumn("distance", d).where(F.col("distance") <= metres).orderBy("distance")


PAIRS_A_SHARE = 4_000_000  #: of points and centres that a task compares at once


def near(points: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """Pairs of points (latitude, longitude, ..) and centres (centre_latitude, centre_longitude, ..) within a radius, with their distance.

    The sphere is cut into bands about as high as the radius, and each band into cells about as wide, fewer towards the
    poles. A point has one cell; a centre goes to all cells that its circle may touch, across the date line and around poles.
    So pairs come from a join on cells, and the distance is worked out for those only; pairs of full cells are dealt out
    over tasks, so that the longest takes its share of all pairs. Other columns must not share names.
    Places without coordinates, or with such as no place has, are in no pair.
    """
    from math import cos, degrees, sin

    angle = metres / numbers.EARTH_METRES
    step = min(180.0, max(1e-4, degrees(angle) * (1 + 1e-9) + 1e-9))
    bands = int(180 / step) + 1
    real = lambda lat, lon: F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    band_of = lambda lat: F.least(F.floor((lat + 90) / step), F.lit(bands - 1)).cast("int")
    # the least cosine of a band is at its edge away from the equator
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("band") * step - 90), F.abs((F.col("band") + 1) * step - 90)))
    cosine = F.greatest(F.cos(F.radians(edge)), F.lit(0.0))
    cells = F.greatest(F.lit(1), F.floor(360 * cosine / step)).cast("int")
    width = 360.0 / cells
    place = lambda lon: F.floor((lon + 180) / width).cast("int")
    dealt = points.where(real("latitude", "longitude")).withColumn("band", band_of(F.col("latitude"))).withColumn("cell", F.pmod(place(F.col("longitude")), cells))
    own = centres.where(real("centre_latitude", "centre_longitude"))
    touched = F.sequence(F.greatest(F.lit(0), band_of(F.col("centre_latitude") - step)), F.least(F.lit(bands - 1), band_of(F.col("centre_latitude") + step)))
    own = own.withColumn("band", F.explode(touched))
    reach = sin(min(angle, 3.141592653589793) / 2) / F.sqrt(F.cos(F.radians("centre_latitude")) * cosine)
    wide = F.when(reach < 1, F.degrees(2 * F.asin(F.least(reach, F.lit(1.0)))) * (1 + 1e-9) + 1e-9).otherwise(180.0)
    first, last = place(F.col("centre_longitude") - wide), place(F.col("centre_longitude") + wide)
    around = F.when(F.isnan(wide) | wide.isNull() | (last - first + 1 >= cells), F.sequence(F.lit(0), cells - 1)).otherwise(F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.pmod(c, cells)))
    own = own.withColumn("cell", F.explode(F.array_distinct(around)))
    # A cell may hold any share of all places, those at the poles above all: what it compares is dealt out in equal shares.
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    named = [f"`{f.name}`" for f in points.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    sizes = dealt.groupBy("band", "cell").agg(F.count("*").alias("n")).join(own.groupBy("band", "cell").agg(F.count("*").alias("m")), ["band", "cell"])
    sizes = sizes.select("band", "cell", F.ceil(F.col("n") * F.col("m") / PAIRS_A_SHARE).cast("int").alias("shares"))
    dealt = dealt.join(sizes, ["band", "cell"]).withColumn("share", F.pmod(F.xxhash64(*named), F.col("shares")).cast("int")).drop("shares")
    own = own.join(sizes, ["band", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # Directions as unit vectors rule most pairs out by their product, with a margin far above its rounding.
    unit = lambda lat, lon: [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]
    dealt = dealt.withColumns(dict(zip(("_px", "_py", "_pz"), unit("latitude", "longitude"))))
    own = own.withColumns(dict(zip(("_cx", "_cy", "_cz"), unit("centre_latitude", "centre_longitude"))))
    close = F.col("_px") * F.col("_cx") + F.col("_py") * F.col("_cy") + F.col("_pz") * F.col("_cz") >= cos(min(angle, 3.141592653589793)) - 1e-9
    key = ["band", "cell", "share"]
    d = numbers.haversine(F.col("centre_latitude"), F.col("centre_longitude"), F.col("latitude"), F.col("longitude"))
    met = dealt.repartition(tasks, *key).join(own.repartition(tasks, *key).hint("shuffle_hash"), key).where(close)
    return met.drop(*key, "_px", "_py", "_pz", "_cx", "_cy", "_cz").withColumn("distance", d).where(F.col("distance") <= metres)


def grid_cells(boxes: DataFrame, most: int | None = None) -> DataFrame:
    """boxes (box_id, min_lat, min_lon, max_lat, max_lon, cell_km) -> box_id, y, x, lat, lon of each cell's middle.

    A box across the date line has min_lon > max_lon. More than `most` cells raise an error.
    """
    km = F.when((F.col("cell_km") <= 0) | F.isnan("cell_km"), 1.0).otherwise(F.col("cell_km"))
    cosine = F.greatest(F.abs(F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))), F.lit(numbers.LEAST_COSINE))
    span = F.when(F.col("max_lon") > F.col("min_lon"), F.col("max_lon") - F.col("min_lon")).otherwise(180 - F.col("min_lon") + F.col("max_lon") + 180)
    sized = boxes.withColumns({"lat_step": km / numbers.KM_PER_DEGREE, "lon_step": F.least(F.lit(360.0), km / (numbers.KM_PER_DEGREE * cosine)), "span": span})
    sized = sized.withColumns({"rows": F.ceil((F.col("max_lat") - F.col("min_lat")) / F.col("lat_step")), "cols": F.ceil(F.col("span") / F.col("lon_step"))})
    if most:
        many = F.col("rows") * F.col("cols")
        sized = sized.withColumn("rows", F.when(many > most, F.raise_error(F.concat(F.lit("too many cells: "), many.cast("string"))).cast("long")).otherwise(F.col("rows")))
    cells = sized.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    lat = F.col("min_lat") + (F.col("y") + 0.5) * F.col("lat_step")
    lon = F.col("min_lon") + (F.col("x") + 0.5) * F.col("lon_step")
    return cells.select("box_id", "y", "x", F.when(lat > F.col("max_lat"), (F.col("min_lat") + F.col("max_lat")) / 2).otherwise(lat).alias("lat"), F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon).alias("lon"))


def seed_jobs(queries: DataFrame, cells: DataFrame, budget: int) -> DataFrame:
    """Every query with every cell, refused beyond a budget. Both sides are request lists, bounded by the budget."""
    n = queries.limit(budget + 1).count() * cells.limit(budget + 1).count()  # neither is read beyond the budget
    if n > budget:
        raise ValueError(f"{n} seed jobs exceed the budget of {budget}")
    return queries.crossJoin(F.broadcast(cells))


# Contacts.


def merged_contacts(evidence: DataFrame) -> DataFrame:
    """evidence (site, page_rank, ord, type, value, origin) -> one row a site.

    Emails sorted; a phone once, a tel link beating text, in the order of their formatted text; chat numbers (digits alone)
    flag their phone; the first profile of each network; ids as a sorted set.
    """
    first = lambda t, keys, order: first_wins(evidence.where(F.col("type") == t), ["site", *keys], order)
    place = ["page_rank", "ord"]
    emails = evidence.where("type = 'email'").groupBy("site").agg(F.array_sort(F.collect_set("value")).alias("emails"))
    chats = evidence.where("type = 'whatsapp'").groupBy("site").agg(F.array_sort(F.collect_set("value")).alias("whatsapps"))
    phones = first("phone", ["value"], [(F.col("origin") == "tel").desc(), *place]).join(chats, "site", "left")
    shown = let(phone.normalise(F.col("value"), "BR", "tel"), lambda p: F.when(p["country"] == "BR", p["national"]).otherwise(p["international"]))
    flagged = phones.withColumn("_shown", F.coalesce(shown, F.col("value"))).withColumn("_chat", F.coalesce(F.array_contains("whatsapps", F.regexp_replace("value", r"^\+", "")), F.lit(False)))
    phones = flagged.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("_shown", "value", "origin", "_chat"))).alias("l"))
    phones = phones.select("site", F.transform("l", lambda x: F.struct(x["value"].alias("value"), x["origin"].alias("origin"), x["_chat"].alias("whatsapp"))).alias("phones"))
    socials = first("social", ["origin"], place).groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin", "value")))).alias("socials"))
    ids = evidence.where("type = 'cnpj'").groupBy("site").agg(F.array_sort(F.collect_set("value")).alias("cnpjs"))
    sites = evidence.select("site").distinct()
    for part in (emails, phones, chats, socials, ids):
        sites = sites.join(part, "site", "left")
    return sites


def contacts(page_rows: DataFrame, region: str = "BR") -> DataFrame:
    """pages (site, url, page_rank, html) -> evidence rows (site, page_rank, ord, value, type, origin) by one parse a page.

    Emails of mailto: and protected links and of the visible text; phones of tel: links, which need only be possible, and valid
    ones of the text; company ids of the text; chat numbers of links and raw html; profiles of social networks.
    """
    from .dom import products

    made = page_rows.withColumn("p", products(F.col("html"), F.col("url"), ["visible", "links", "hrefs"]))
    base = made.select("site", "page_rank", F.col("p.visible").alias("text"), F.col("p.links").alias("links"), F.col("p.hrefs").alias("hrefs"), "html")

    def evidence(values: Column, type_: str, origin: str) -> DataFrame:
        return base.select("site", "page_rank", F.posexplode(values).alias("ord", "value"), F.lit(type_).alias("type"), F.lit(origin).alias("origin"))

    numbers = lambda found: F.transform(F.filter(found, lambda p: p["valid"]), lambda p: p["e164"])
    starts = lambda h, *schemes: F.lower(F.substring(h, 1, 8)).rlike("^(?:" + "|".join(schemes) + "):")
    some = lambda values: F.filter(values, lambda v: v.isNotNull())
    protected = F.filter("hrefs", lambda h: h.contains("/cdn-cgi/l/email-protection"))
    protected = some(F.transform(protected, lambda h: email.clean(email.decode_protected(F.coalesce(F.try_element_at(F.split(h, "#"), F.lit(2)), F.lit(""))))))
    written = some(F.transform(F.filter("hrefs", lambda h: starts(h, "mailto")), lambda h: email.clean(h)))
    mails = evidence(protected, "email", "protected").unionByName(evidence(written, "email", "mailto")).unionByName(evidence(email.find(F.col("text")), "email", "text"))
    called = evidence(some(F.transform(F.filter("hrefs", lambda h: starts(h, "tel")), lambda h: phone.normalise(h, region, "tel")["e164"])), "phone", "tel")
    read = evidence(numbers(phone.find_phones(F.col("text"), region)), "phone", "text")
    ids = evidence(phone.extract_cnpjs(F.col("text")), "cnpj", "text")
    chat = lambda h: h.contains("wa.me/") | h.contains("api.whatsapp.com/send") | h.startswith("whatsapp:")
    chats = evidence(some(F.transform(F.filter("hrefs", chat), lambda h: phone.whatsapp_number(h, region))), "whatsapp", "link").unionByName(evidence(phone.whatsapp_in_html(F.col("html")), "whatsapp", "html"))
    nets = base.select("site", "page_rank", F.explode("links").alias("l")).select("site", "page_rank", F.col("l.place").alias("ord"), urls.without_query(F.col("l.href")).alias("value"), F.lit("social").alias("type"), urls.network(F.col("l.href")).alias("origin")).where("origin is not null")
    return mails.unionByName(called).unionByName(read).unionByName(ids).unionByName(chats).unionByName(nets)


def enriched(leads: DataFrame, sites: DataFrame) -> DataFrame:
    """Leads (lead_id, website, emails, phone_e164) with what their site gave (domain, emails, phones): listing first, distinct."""
    own = leads.withColumn("domain", urls.domain_key(F.col("website"), F.col("title")))
    found = own.join(sites.select("domain", F.col("emails").alias("site_emails"), F.col("phones").alias("site_phones")), "domain", "left")
    none = F.array().cast("array<string>")
    return found.withColumn("all_emails", F.array_union(F.coalesce("emails", none), F.coalesce("site_emails", none))).withColumn("additional_phones", F.filter(F.array_distinct(F.coalesce("site_phones", none)), lambda p: ~F.coalesce(p.eqNullSafe(F.col("phone_e164")), F.lit(False)))).drop("site_emails", "site_phones")


PERSON_TITLES = r"(?:[Dd]r|[Dd]ra|[Ss]ócio|[Ss]ócia|CEO|[Ff]ounder|[Oo]wner|[Dd]iretor|[Dd]iretora|[Dd]irector)\.?"


def person_candidates(text: Column) -> Column:
    """At most eight distinct names after a title word."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{PERSON_TITLES}\s+(\p{{Lu}}\p{{Ll}}+(?:\s+(?:d[aeo]s?\s+)?\p{{Lu}}\p{{Ll}}+){{0,3}})"), F.lit(1))), 1, 8)


def picked_first(candidates: Column, pick: Column) -> Column:
    """An answer of `none` empties the list, a candidate goes to the front, no answer leaves it."""
    return F.when(F.lower(pick) == "none", F.array().cast("array<string>")).when(F.array_contains(candidates, pick), F.concat(F.array(pick), F.array_remove(candidates, pick))).otherwise(candidates)


# Competitors, plans, outreach.


def competitor_review(leads: DataFrame, audits: DataFrame) -> DataFrame:
    """Strengths and weaknesses of leads (lead_id, domain, review_rating, review_count, website, whatsapp_source) by their audit."""
    both = leads.join(audits.select("domain", "seo_score", "booking_url", "contact_form", F.col("whatsapp").alias("site_whatsapp")), "domain", "left")
    has_site, seen = F.coalesce(F.col("website"), F.lit("")) != "", F.col("seo_score").isNotNull()
    chat = F.coalesce((F.col("whatsapp_source") == "google") | F.col("site_whatsapp"), F.lit(False))
    strong = F.array_compact(F.array(F.when((F.col("review_rating") >= 4.7) & (F.col("review_count") > 30), "strong reputation"), F.when(F.col("booking_url").isNotNull(), "online booking"), F.when(chat, "whatsapp"), F.when(F.col("seo_score") >= 80, "solid seo")))
    weak = F.array_compact(F.array(F.when(F.col("review_rating") < 4.5, "rating below 4.5"), F.when(~has_site, "no website"), F.when(seen & F.col("booking_url").isNull(), "no online booking"), F.when(seen & ~chat, "no whatsapp"), F.when(F.col("seo_score") < 50, "weak seo")))
    return both.withColumns({"strengths": strong, "weaknesses": weak, "judged": seen | ~has_site, "has_whatsapp": chat})


def market_gaps(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Over judged competitors: how many lack a website, booking, chat or a good rating."""
    lacks = lambda w: F.count_if(F.array_contains("weaknesses", w))
    return reviews.where("judged").groupBy(*by).agg(F.count("*").alias("judged"), lacks("no website").alias("no_website"), lacks("no online booking").alias("no_booking"), lacks("no whatsapp").alias("no_whatsapp"), lacks("rating below 4.5").alias("low_rating"))


def without_own(competitors: DataFrame, own_domain: str) -> DataFrame:
    return competitors.where(~F.col("domain").eqNullSafe(F.lit(own_domain)))


GTM_CHANNELS = [("WHATSAPP", "whatsapp"), ("EMAIL", "email"), ("INSTAGRAM_DM", "instagram"), ("PHONE", "phone")]


def outreach(leads: DataFrame) -> DataFrame:
    """The best channel a lead (title, city, whatsapp, email, instagram, phone) has, and a draft. Nothing is sent."""
    channel, target = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, column in GTM_CHANNELS:
        has = F.coalesce(F.col(column), F.lit("")) != ""
        channel, target = channel.when(has, name), target.when(has, F.col(column))
    draft = F.format_string("Hello %s, we help businesses in %s. May I share an idea?", F.col("title"), F.coalesce(F.col("city"), F.lit("your city")))
    return leads.withColumns({"channel": channel, "destination": target, "draft": F.when(channel.isNotNull(), draft)})


def niche_gate(leads: DataFrame, judgments: DataFrame, least: float = 0.3) -> DataFrame:
    """Skips leads that a judgment puts below the least score; those without a judgment pass."""
    return leads.join(judgments, "lead_id", "left").withColumn("skipped", F.coalesce(F.col("niche_score") < least, F.lit(False)))


#: Words and the postcode of addresses where English is spoken.
ENGLISH = r"\b(uk|united kingdom|england|scotland|wales|ireland|usa|united states|australia|canada)\b"
UK_POSTCODE = r"\b[a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2}\b"


def locale_of(country: Column, address: Column | None = None, location: Column | None = None) -> Column:
    """pt or en: by the country's code if it is known, else en if address or location name a place where that is spoken."""
    text = F.lower(F.concat_ws(" ", *[c for c in (address, location) if c is not None], F.lit("")))
    by_country = F.when(F.upper(country).isin("BR", "PT"), "pt").otherwise("en")
    return F.when(F.coalesce(country, F.lit("")) != "", by_country).when(text.rlike(ENGLISH) | text.rlike(UK_POSTCODE), "en").otherwise("pt")


def city_of(address: Column) -> Column:
    """What stands before the region's code in `Rua A, 10, Goiânia - GO, 74000-000`, else the second last part if it has no digit."""
    city = F.trim(F.element_at(F.split(F.regexp_extract(address, r"([A-Za-zÀ-ÖØ-öø-ÿ ]{3,})\s*-\s*[A-Z]{2}\b", 1), ","), -1))
    parts = F.filter(F.transform(F.split(address, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    other = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return F.coalesce(F.nullif(city, F.lit("")), F.when(~other.rlike(r"\d"), other))


#: What is offered where the caller says nothing, and the texts of drafts.
OFFER = {"pt": "automações de resposta e agendamento para reduzir contatos perdidos", "en": "reply and booking automation that cuts missed enquiries"}


def drafts(leads: DataFrame, niche: str, offer: str | None = None, location: str | None = None, locale: str = "auto") -> DataFrame:
    """leads (title, address, country, city, whatsapp, email, instagram, phone, rating, reviews, person) -> channel, destination, locale, copy.

    A draft says only what is known: the person or the team, the place unless the title holds it, the rating where there are
    reviews. Nothing is sent.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    channel = F.when(filled("whatsapp"), "WHATSAPP").when(filled("email"), "EMAIL").when(filled("instagram"), "INSTAGRAM_DM").otherwise("PHONE")
    target = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("whatsapp", "email", "instagram", "phone")], F.lit(""))
    spoken = F.lit(locale) if locale != "auto" else locale_of(F.col("country"), F.col("address"), F.lit(location))
    found = F.coalesce(F.nullif(F.col("city"), F.lit("")), city_of(F.col("address")))
    city = F.when(~F.lower("title").contains(F.lower(found)), found)
    en = F.col("locale") == "en"
    rated = (F.coalesce("rating", F.lit(0.0)) != 0) & (F.coalesce("reviews", F.lit(0)) != 0)
    stars = F.regexp_replace(F.col("rating").cast("string"), r"\.0$", "")
    rating = F.when(rated & en, F.concat(F.lit(" ("), stars, F.lit("★, "), F.col("reviews"), F.lit(" Google reviews)"))).when(rated, F.concat(F.lit(" (nota "), stars, F.lit("★, "), F.col("reviews"), F.lit(" avaliações no Google)"))).otherwise("")
    known = leads.withColumns({"channel": channel, "destination": target, "locale": spoken}).withColumns({"_city": city, "_rating": rating, "_person": F.nullif(F.col("person"), F.lit(""))})
    offered = F.lit(offer.strip()) if offer and offer.strip() else F.when(en, OFFER["en"]).otherwise(OFFER["pt"])
    place = lambda word: F.coalesce(F.concat(F.lit(f" {word} "), F.col("_city")), F.lit(""))
    english = F.concat(F.lit("Hi "), F.coalesce("_person", F.concat("title", F.lit(" team"))), F.lit(",\n\nI came across "), F.col("title"), place("in"), F.col("_rating"), F.lit(".\n\nI work on "), offered, F.lit(f" for {niche} businesses.\n\nWould a 10-minute call this week be useful?"))
    portuguese = F.concat(F.lit("Olá "), F.coalesce("_person", F.concat(F.lit("equipe da "), F.col("title"))), F.lit(", tudo bem?\n\nConheci a "), F.col("title"), place("em"), F.col("_rating"), F.lit(".\n\nTrabalho com "), offered, F.lit(f" para negócios de {niche}.\n\nFaz sentido conversarmos 10 minutos esta semana?"))
    return known.withColumn("copy", F.when(en, english).otherwise(portuguese)).drop("_city", "_rating", "_person")



GROWTH_TEMPLATES = {
    "no online booking": "Add online booking for %s: visitors who can book at night don't call in the morning.",
    "no website": "Publish a one-page site for %s with hours, prices and a map.",
    "no whatsapp": "Put a chat button on the pages of %s.",
    "weak seo": "Give the pages of %s a title, a description and one heading each.",
    "rating below 4.5": "Ask the last 20 customers of %s for a review.",
}


def growth_plan(reviews: DataFrame) -> DataFrame:
    """A step for each weakness, linted; a lead's mean lint score and whether all its steps pass (below 25)."""
    from ..functions import slop

    step = F.when(F.lit(False), "")
    for weakness, template in GROWTH_TEMPLATES.items():
        step = step.when(F.col("weakness") == weakness, F.format_string(template, F.col("title")))
    steps = reviews.select("lead_id", "title", F.posexplode("weaknesses").alias("place", "weakness")).withColumn("step", step).where("step is not null")
    linted = steps.withColumn("slop", slop.lint(F.col("step"))["score"])
    return linted.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"]).alias("steps"), F.avg("slop").alias("average_slop"), F.bool_and(F.col("slop") < 25).alias("all_passed"))


# Rows for export.


def stringified(c: Column, kind: str) -> Column:
    """A value of an export cell: lists joined, nested values as JSON, decimals with six places, null empty."""
    if kind == "array<string>":
        return F.coalesce(F.array_join(c, ", "), F.lit(""))
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(c), F.lit(""))
    if kind in ("double", "float"):
        return F.coalesce(F.format_string("%.6f", c.cast("double")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


# Columns of an export, in order.
EXPORT_COLUMNS = [
    "input_id", "link", "title", "category", "categories", "address", "open_hours", "popular_times", "website", "instagram", "phone", "plus_code", "review_count",
    "review_rating", "reviews_per_rating", "latitude", "longitude", "cid", "status", "descriptions", "reviews_link", "thumbnail", "timezone", "price_range", "data_id",
    "street_view_url", "place_id", "images", "reservations", "order_online", "menu", "owner", "complete_address", "credit_cards_accepted", "about", "user_reviews",
    "user_reviews_extended", "emails",
]
# Header of the spreadsheet for local readers, in order.
FRIENDLY_HEADER = [
    "Nome", "Categoria principal", "Outras categorias", "Endereço", "Bairro", "Cidade", "Estado", "CEP", "País", "Telefone", "Site", "Instagram", "E-mails", "Avaliação",
    "Quantidade de avaliações", "Horário de funcionamento", "Descrição", "Faixa de preço", "Responsável", "Google Maps", "Latitude", "Longitude",
]


def export_rows(leads: DataFrame) -> DataFrame:
    """The 38 columns of an export as text; a column that leads lack is empty. A profile in the website's place is no website."""
    kinds = {f.name: f.dataType.simpleString() for f in leads.schema}
    cell = lambda c: stringified(F.col(c), kinds[c]) if c in kinds else F.lit("")
    out = {c: cell(c) for c in EXPORT_COLUMNS}
    if "website" in kinds:
        site = F.coalesce(F.trim("website"), F.lit(""))
        where = urls.social_domain(site)
        out["website"] = F.when(where.isNull(), site).otherwise("")
        out["instagram"] = F.when(where == "instagram.com", site).otherwise("")
    return leads.select(*[out[c].alias(c) for c in EXPORT_COLUMNS])


def friendly_rows(rows: DataFrame) -> DataFrame:
    """Result rows (all text, as export_rows() writes them) under the local header: cells made safe, decimals with a comma, hours and lists as text."""
    have = set(rows.columns)

    def get(*names: str) -> Column:
        own = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have]
        return F.coalesce(*own, F.lit(""))

    categories = category_list(get("categories"), get("category"))
    address = F.from_json(get("complete_address"), "street string, borough string, city string, state string, postal_code string, country string")
    inside = lambda n: F.coalesce(address[n], F.lit(""))
    parts = F.filter(F.array(*[F.trim(inside(n)) for n in ("street", "borough", "city", "state", "postal_code", "country")]), lambda x: x != "")
    hours = F.coalesce(numbers.hours_text(F.from_json(get("open_hours"), "map<string,array<string>>")), F.lit(""))
    sites = urls.site_and_instagram(get("website", "web_site"), get("instagram"))
    cells = [
        get("title", "name"), F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit("")), F.array_join(F.slice(categories, 2, F.greatest(F.size(categories), F.lit(1))), " | "),
        F.coalesce(F.nullif(get("address"), F.lit("")), F.array_join(F.array_distinct(parts), ", ")), inside("borough"), inside("city"), inside("state"), inside("postal_code"), inside("country"),
        get("phone", "phone_number"), sites["website"], sites["instagram"], numbers.mail_list(get("emails", "email")), numbers.localised_decimal(get("review_rating", "rating")), get("review_count"),
        hours, get("descriptions", "description"), get("price_range"), numbers.owner_name(get("owner")), get("link"), numbers.localised_decimal(get("latitude")), numbers.localised_decimal(get("longitude")),
    ]
    return rows.select(*[pages.strict_cell(F.coalesce(c, F.lit(""))).alias(n) for n, c in zip(FRIENDLY_HEADER, cells)])


def plan_totals(plans: DataFrame) -> DataFrame:
    """One row over growth_plan(): leads, the mean of their lint scores and whether all pass."""
    return plans.agg(F.count("*").alias("leads"), F.avg("average_slop").alias("average_slop"), F.coalesce(F.bool_and("all_passed"), F.lit(True)).alias("all_passed"))


def lead_pages(leads: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Leads with the stored pages of their key; leads without one stay."""
    return leads.join(stored, key, "left")


def nul_free(df: DataFrame) -> DataFrame:
    """Every string of every column, nested ones too, without NUL characters."""
    from pyspark.sql import types as T

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, T.StringType):
            return F.replace(c, F.lit("\x00"), F.lit(""))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(F.transform_keys(c, lambda k, v: clean(k, kind.keyType)), lambda k, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def crm_split(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows for a CRM: first email and the others, rejected rows with their reason)."""
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing title").when(F.coalesce(F.trim("category"), F.lit("")) == "", "missing category")
    marked = leads.withColumn("reason", reason)
    good = marked.where("reason is null").select("title", "category", F.try_element_at("emails", F.lit(1)).alias("email"), F.when(F.size("emails") > 1, F.slice(F.col("emails"), F.lit(2), F.size("emails"))).alias("other_emails"), "phone", "website")
    return good, marked.where("reason is not null")
