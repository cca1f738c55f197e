"""Place payloads: positional JSON decoded by a table of paths over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pages

# Column -> (path in the place array, type).
PATHS = {
    "link": ("[27]", "string"), "title": ("[11]", "string"), "raw_address": ("[18]", "string"), "raw_website": ("[7][0]", "string"), "phone": ("[178][0][0]", "string"),
    "plus_code": ("[183][2][2][0]", "string"), "review_count": ("[4][8]", "double"), "review_rating": ("[4][7]", "double"), "latitude": ("[9][2]", "double"), "longitude": ("[9][3]", "double"),
    "status": ("[34][4][4]", "string"), "description": ("[32][1][1]", "string"), "reviews_link": ("[4][3][0]", "string"), "thumbnail": ("[72][0][1][6][0]", "string"), "timezone": ("[30]", "string"),
    "price_range": ("[4][2]", "string"), "data_id": ("[10]", "string"), "place_id": ("[78]", "string"), "menu_link": ("[38][0]", "string"), "menu_source": ("[38][1]", "string"),
    "owner_id": ("[57][2]", "string"), "owner_name": ("[57][1]", "string"), "borough": ("[183][1][0]", "string"), "street": ("[183][1][1]", "string"), "city": ("[183][1][3]", "string"),
    "postal_code": ("[183][1][4]", "string"), "state": ("[183][1][5]", "string"), "country": ("[183][1][6]", "string"),
}
LIST_PATHS = {k: PATHS[k] for k in ("title", "raw_website", "review_rating", "review_count", "latitude", "longitude", "phone", "status", "timezone", "data_id")} | {"id": ("[0]", "string")}
LEAST_PLACE, PLACE_AT = 20, 6


def at(value: Column, path: str, kind: str) -> Column:
    """The value at a path if it is of the type: a number or a list doesn't become text."""
    got = F.try_variant_get(value, f"${path}", "variant")
    shape = F.schema_of_variant(got)
    good = shape == "STRING" if kind == "string" else shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")
    return F.when(good, F.try_variant_get(value, f"${path}", kind))


def _array(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"${path}", "array<variant>")


def place_array(root: Column) -> Column:
    """Element 6, else the first array of 20 or more with a title and two coordinates."""
    fits = lambda v: (F.size(_array(v, "")) >= LEAST_PLACE) & at(v, "[11]", "string").isNotNull() & at(v, "[9][2]", "double").isNotNull() & at(v, "[9][3]", "double").isNotNull()
    usual = F.try_variant_get(root, f"$[{PLACE_AT}]", "variant")
    other = F.try_element_at(F.filter(_array(root, ""), fits), F.lit(1))
    return F.when(F.size(_array(usual, "")) > 0, usual).otherwise(other)


def decode_places(rows: DataFrame) -> DataFrame:
    """rows (id, raw) -> a place a row, and `drift`: why it can't be one."""
    from ..functions.urls import unwrap_redirect

    parsed = rows.select("id", F.try_parse_json("raw").alias("root")).withColumn("d", place_array(F.col("root")))
    d = F.col("d")
    out = parsed.select("id", "root", "d", *[at(d, p, k).alias(n) for n, (p, k) in PATHS.items()])
    title = F.coalesce("title", F.lit(""))
    address = F.trim(F.when(F.col("raw_address").startswith(F.concat(title, F.lit(","))), F.substr("raw_address", F.length(title) + 2)).otherwise(F.col("raw_address")))
    rating = F.create_map(*[x for i in range(5) for x in (F.lit(i + 1), F.coalesce(at(d, f"[175][3][{i}]", "double"), F.lit(0.0)).cast("int"))])
    drift = (
        F.when(F.col("root").isNull(), "decode").when(d.isNull(), "place-data").when((title == "") | F.col("latitude").isNull() | F.col("longitude").isNull(), "required-field")
        .when(~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180), "coordinate")
    )
    extra = {
        "cid": at(F.col("root"), "[25][3][0][13][0][0][1]", "string"), "categories": F.filter(F.transform(_array(d, "[13]"), lambda v: at(v, "", "string")), lambda c: c.isNotNull()), "address": address,
        "website": unwrap_redirect(F.col("raw_website")), "reviews_per_rating": rating, "drift": drift, "review_count": F.col("review_count").cast("int"),
        "owner_link": F.when(F.col("owner_id").isNotNull(), F.concat(F.lit("https://www.google.com/maps/contrib/"), "owner_id")),
    }
    return out.withColumns(extra).withColumn("category", F.try_element_at("categories", F.lit(1))).drop("root", "d", "raw_address", "raw_website")


def decode_search(rows: DataFrame) -> DataFrame:
    """rows (id, body) -> a place for each listed business; the first line of the body is dropped."""
    root = F.try_parse_json(pages.guard_stripped(pages.first_line_stripped(F.col("body"))))
    listed = rows.select("id", F.posexplode(_array(root, "[0][1]")).alias("place", "v")).where("place > 0")
    b = F.try_variant_get("v", "$[14]", "variant")
    out = listed.withColumn("b", b)
    b = F.col("b")
    made = out.select(F.col("id").alias("search_id"), "place", *[at(b, p, k).alias(n) for n, (p, k) in LIST_PATHS.items()], F.array_join(F.transform(_array(b, "[2]"), lambda v: at(v, "", "string")), ", ").alias("address"))
    made = made.withColumns({"phone": F.replace("phone", F.lit(" "), F.lit("")), "review_count": F.col("review_count").cast("int")}).withColumnRenamed("raw_website", "website")
    return made.withColumn("plus_code", plus_code(F.col("latitude"), F.col("longitude")))


def plus_code(lat: Column, lon: Column) -> Column:
    """Open Location Code of ten digits: five pairs in base 20, from 8000ths of a degree."""
    alphabet = F.lit("23456789CFGHJMPQRVWX")
    y = F.floor((F.least(F.greatest(lat, F.lit(-90.0)), F.lit(89.999875)) + 90) * 8000 + 1e-9)
    x = F.floor((F.pmod(lon + 180, F.lit(360.0))) * 8000 + 1e-9)
    out = []
    for k in range(5):
        unit = 20 ** (4 - k)
        for v in (y, x):
            out.append(F.substr(alphabet, F.pmod(F.floor(v / unit), F.lit(20)).cast("int") + 1, F.lit(1)))
        if k == 3:
            out.append(F.lit("+"))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*out))


def decode_reviews(rows: DataFrame, column: str = "raw") -> DataFrame:
    """rows (id, raw: a JSON array of reviews) -> a review a row; those without an author are dropped."""
    root = F.try_parse_json(pages.guard_stripped(F.col(column)))
    el = rows.select("id", F.posexplode(_array(root, "")).alias("place", "v"))
    inner = F.try_variant_get("v", "$[0]", "variant")
    el = el.withColumn("e", F.when(F.size(_array(inner, "")) > 0, inner).otherwise(F.col("v")))
    e = F.col("e")
    name = F.coalesce(at(e, "[1][4][5][0]", "string"), at(e, "[1][4][0][4]", "string"))
    rating = F.coalesce(at(e, "[2][0][0]", "double"), F.lit(0.0)).cast("int")
    aggregate = F.try_variant_get(e, "$[2][0]", "string").isNull() & F.try_variant_get(e, "$[2][0][0]", "double").isNull()
    out = el.select(
        "id", "place", at(e, "[0]", "string").alias("review_id"), name.alias("name"), at(e, "[1][4][2][0]", "string").alias("author_url"), at(e, "[1][2]", "double").cast("long").alias("posted_at_micros"),
        at(e, "[1][3]", "double").cast("long").alias("updated_at_micros"), F.coalesce(at(e, "[1][13][0]", "string"), F.lit("unknown")).alias("source"), rating.alias("rating"),
        F.coalesce(F.nullif(at(e, "[1][13][4]", "double").cast("int"), F.lit(0)), F.lit(5)).alias("rating_scale"), F.when(aggregate, at(e, "[2][8][1]", "double")).otherwise(rating.cast("double")).alias("rating_float"),
        at(e, "[2][14][0]", "string").alias("language"), at(e, "[2][14][1]", "string").alias("translated_language"), at(e, "[2][15][0][0]", "string").alias("text_original"), at(e, "[2][15][1][0]", "string").alias("text_translated"),
        F.when(F.size(_array(e, "[3]")) >= 15, at(e, "[3][14][0][0]", "string")).alias("reply_original"), F.when(F.size(_array(e, "[3]")) >= 15, at(e, "[3][14][1][0]", "string")).alias("reply_translated"),
        F.filter(F.transform(_array(e, "[2][2]"), lambda i: at(i, "[1][6][0]", "string")), lambda u: u.isNotNull()).alias("images"),
    )
    return out.where("name is not null and name <> ''")


def next_page_token(body: Column) -> Column:
    return at(F.try_parse_json(pages.guard_stripped(body)), "[1]", "string")


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """reviews (place_id, ord, author, text): drops one that a kept earlier review of its author at the place equals, or shares
    20 leading bytes with if both are longer. Which are kept depends on the order, so an author's reviews go in one group."""
    schema = reviews.schema

    def run(pdf):
        kept: list[bytes] = []
        rows = []
        for i, text in zip(pdf.index, pdf.sort_values("ord", kind="stable")["text"]):
            raw = (text or "").encode()
            rows.append(not any(raw == k or len(raw) > 20 and len(k) > 20 and raw[:20] == k[:20] for k in kept))
            if rows[-1]:
                kept.append(raw)
        return pdf.sort_values("ord", kind="stable")[rows]

    return reviews.where("author <> ''").groupBy("place_id", "author").applyInPandas(run, schema)


def options_merged(options: DataFrame) -> DataFrame:
    """options (entry_id, about_id, name, enabled, values) -> one row a name: enabled if any is, values distinct."""
    return options.where("name <> ''").groupBy("entry_id", "about_id", "name").agg(F.bool_or("enabled").alias("enabled"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))


def street_view(images: Column) -> Column:
    """Panorama URL of the first image that is called Street View."""
    named = F.try_element_at(F.filter(images, lambda i: i["source"].contains("Street View")), F.lit(1))["link"]
    pano = F.regexp_extract(named, r"panoid=([^&]+)", 1)
    return F.when(pano != "", F.concat(F.lit("https://www.google.com/maps/@?api=1&map_action=pano&pano="), pano))


def link_sources(value: Column, link: str, source: str) -> Column:
    """Links of an array of positional items, each with its source; items without either are dropped."""
    pairs = F.transform(F.coalesce(_array(value, ""), F.array().cast("array<variant>")), lambda v: F.struct(at(v, source, "string").alias("source"), at(v, link, "string").alias("link")))
    return F.filter(pairs, lambda p: (F.coalesce(p["source"], F.lit("")) != "") & (F.coalesce(p["link"], F.lit("")) != ""))


def opening_hours(d: Column) -> Column:
    """Day -> times of a place array: the newer list with formatted slots, else the older one."""
    new, old = _array(d, "[203][0]"), _array(d, "[34][1]")
    items = F.when(F.size(new) > 0, new).otherwise(old)
    texts = lambda a, path: F.filter(F.transform(a, lambda v: at(v, path, "string")), lambda t: F.coalesce(t, F.lit("")) != "")
    slots = lambda v: F.when(F.size(_array(v, "[3]")) > 0, texts(_array(v, "[3]"), "[0]")).otherwise(texts(_array(v, "[1]"), ""))
    days = F.transform(items, lambda v: F.struct(at(v, "[0]", "string").alias("day"), slots(v).alias("times")))
    return F.map_from_entries(F.filter(days, lambda x: (F.coalesce(x["day"], F.lit("")) != "") & (F.size(x["times"]) > 0)))


def popular_times(d: Column) -> Column:
    """Day -> hour -> share of a place array."""
    names = F.array(*[F.lit(n) for n in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    hours = lambda v: F.map_from_entries(F.transform(_array(v, "[1]"), lambda t: F.struct(at(t, "[0]", "double").cast("int").alias("hour"), at(t, "[1]", "double").cast("int").alias("share"))))
    days = F.transform(_array(d, "[84][0]"), lambda v: F.struct(F.try_element_at(names, at(v, "[0]", "double").cast("int")).alias("day"), hours(v).alias("hours")))
    return F.map_from_entries(F.filter(days, lambda x: x["day"].isNotNull() & x["hours"].isNotNull()))


def place_lists(rows: DataFrame) -> DataFrame:
    """rows (id, raw) -> hours, popular times, images, street view, reservations and order links of each place."""
    parsed = rows.select("id", place_array(F.try_parse_json("raw")).alias("d"))
    d = F.col("d")
    sub = lambda path: F.try_variant_get(d, f"${path}", "variant")
    order, other = link_sources(sub("[75][0][1][2]"), "[1][2][0]", "[0][0]"), link_sources(sub("[75][0][0][2]"), "[1][2][0]", "[0][0]")
    made = parsed.select(
        "id", opening_hours(d).alias("open_hours"), popular_times(d).alias("popular_times"), link_sources(sub("[171][0]"), "[3][0][6][0]", "[2]").alias("images"),
        link_sources(sub("[46]"), "[0]", "[1]").alias("reservations"), F.when(F.size(order) > 0, order).otherwise(other).alias("order_online"),
    )
    return made.withColumn("street_view_url", street_view(F.col("images")))
