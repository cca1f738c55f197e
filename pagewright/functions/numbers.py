"""Numbers in text, lists, distances, grids, dates, estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rx import js, trimmed

EARTH_METRES, KM_PER_DEGREE, LEAST_COSINE = 6371e3, 111.32, 1e-6
# Short names of months in Portuguese and English -> number.
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}
#: Day -> its Portuguese name, which exports show.
DAYS = {"monday": "segunda-feira", "tuesday": "terça-feira", "wednesday": "quarta-feira", "thursday": "quinta-feira", "friday": "sexta-feira", "saturday": "sábado", "sunday": "domingo"}


def rounded(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5)


def leading_float(c: Column) -> Column:
    """The number that a text starts with."""
    return F.nullif(F.regexp_extract(c, js(r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"), 1), F.lit("")).cast("double")


def shorthand(c: Column) -> Column:
    """12.5K, 5,2 mil, 3 mi, 10.000 as whole numbers; null where there is no number."""
    v = trimmed(c)
    out = F.when(F.coalesce(v, F.lit("")) == "", F.lit(None).cast("long"))
    for words, letter, factor in (("mil|k", "k", 10**3), ("mi|milh(?:ão|ões)|m", "m", 10**6), ("bi|bilh(?:ão|ões)|b", "b", 10**9)):
        has = v.rlike(js(rf"\b(?:{words})\b", True)) | v.rlike(js(rf"[0-9]{letter}\b", True))
        bare = F.regexp_replace(F.regexp_replace(v, js(rf"\b(?:{words})\b", True), ""), f"(?i){letter}$", "")
        out = out.when(has, rounded(leading_float(F.replace(bare, F.lit(","), F.lit("."))) * factor).cast("long"))
    out = out.when(v.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), F.regexp_replace(v, "[^0-9]", "").cast("long"))
    return out.otherwise(rounded(leading_float(F.replace(v, F.lit(","), F.lit(".")))).cast("long"))


_NUMBER = r"(\d[\d.,]*(?:[  ]\d{3})*[\s ]*(?:milh(?:ão|ões)|million|bilh(?:ão|ões)|billion|mil|mi|bi|k|m|b)?)(?![a-zà-ú])"


def _counted(text: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(text, r"(\d)[  ](?=\d)", "$1"), "(?i)million", "m")
    return shorthand(F.regexp_replace(v, "(?i)billion", "b"))


def count_before(text: Column, labels: list[str]) -> Column:
    pattern = rf"(?iu){_NUMBER}[\s ]+(?:{'|'.join(labels)})(?![A-Za-z0-9_])"
    return F.when(text.rlike(pattern), _counted(F.regexp_extract(text, pattern, 1)))


def leading_count(label: Column) -> Column:
    pattern = rf"(?iu)^{_NUMBER}"
    v = trimmed(label)
    return F.when(v.rlike(pattern), _counted(F.regexp_extract(v, pattern, 1)))


def parse_list(raw: Column) -> Column:
    """A JSON array of strings, or text split at commas: trimmed, without blanks, distinct in order."""
    got = F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, ","))
    return F.array_distinct(F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != ""))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_METRES * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def sum_known(*columns: Column) -> Column:
    """Sum of those that are known; null if none is."""
    total = columns[0].isNull()
    for c in columns[1:]:
        total = total & c.isNull()
    added = F.lit(0)
    for c in columns:
        added = added + F.coalesce(c, F.lit(0))
    return F.when(~total, added)


def long_date(c: Column) -> Column:
    """Dates such as `14 de março de 2026 às 09:05` or `March 14, 2026 at 9:05 AM`, as a timestamp."""
    v = F.lower(c)
    pt, en = r"(\d{1,2}) de ([a-zç]{3})[a-zç]* de (\d{4})(?: às (\d{1,2}):(\d{2}))?", r"([a-z]{3})[a-z]* (\d{1,2}), (\d{4})(?: at (\d{1,2}):(\d{2})\s*(am|pm)?)?"
    number = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    get = lambda p, i: F.regexp_extract(v, p, i)
    hour = lambda p: F.coalesce(F.nullif(get(p, 4), F.lit("")).cast("int"), F.lit(0))
    minute = lambda p: F.coalesce(F.nullif(get(p, 5), F.lit("")).cast("int"), F.lit(0))
    half = F.when((get(en, 6) == "pm") & (hour(en) < 12), hour(en) + 12).when((get(en, 6) == "am") & (hour(en) == 12), 0).otherwise(hour(en))
    make = lambda y, m, d, h, mi: F.try_make_timestamp(y.cast("int"), F.try_element_at(number, m), d.cast("int"), h, mi, F.lit(0))
    return F.when(v.rlike(pt), make(get(pt, 3), get(pt, 2), get(pt, 1), hour(pt), minute(pt))).when(v.rlike(en), make(get(en, 3), get(en, 1), get(en, 2), half, minute(en)))


def localised_decimal(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("."), F.lit(","))


def hours_text(hours: Column) -> Column:
    """A map of day (either language) to opening times, Monday first: `Segunda-feira: 9-12 / 13-18 | ...`."""
    known = F.transform_keys(hours, lambda k, v: F.lower(F.trim(k)))
    lines = []
    for english, local in DAYS.items():
        slots = F.coalesce(F.nullif(known[english], F.array().cast("array<string>")), known[local])
        own = F.array_distinct(F.filter(F.transform(slots, lambda x: F.trim(x)), lambda x: x != ""))
        lines.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{local.capitalize()}: "), F.array_join(own, " / "))))
    return F.concat_ws(" | ", *lines)


def owner_name(raw: Column) -> Column:
    return F.coalesce(F.trim(F.get_json_object(raw, "$.name")), F.lit(""))


def mail_list(raw: Column) -> Column:
    """Addresses of a cell, distinct, joined for a reader."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(raw, F.lit(r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"), F.lit(0))), " | ")


def valid_published_at(first: Column, second: Column, now: Column) -> Column:
    """The first non-zero of two times in microseconds, if it lies from 2007 to a day after now."""
    micros = F.coalesce(F.nullif(first, F.lit(0)), F.nullif(second, F.lit(0)))
    at = F.timestamp_micros(micros.cast("long"))
    return F.when(at.between(F.lit("2007-01-01").cast("timestamp"), now + F.expr("interval 24 hours")), at)


def work_estimate(seeds: Column, depth: Column, email: Column) -> Column:
    requests = seeds * F.greatest(F.lit(1), depth) * 3 + F.when(email, seeds).otherwise(0)
    return F.struct(requests.cast("long").alias("requests"), F.greatest(F.lit(1), F.ceil(requests / 30)).cast("long").alias("minutes"))


def tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((1 - after / before) * 100, 2))


def backoff_ms(attempt: Column, first: int = 500, factor: int = 2) -> Column:
    return (first * F.pow(F.lit(factor), attempt - 1)).cast("long")
