"""Readers of stored inputs. All go through Spark's sources, so that any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numbers

LEAD = "cid string, place_id string, title string, category string, categories array<string>, address string, web_site string, phone string, review_count int, review_rating double, latitude double, longitude double, emails array<string>"


def query_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) `text#!#id` -> query, id; blank lines are skipped, a line with an id but no text is an error."""
    parts = F.split(F.trim("value"), "#!#", 2)
    kept = lines.where(F.trim("value") != "").select(F.trim(parts[0]).alias("query"), F.trim(F.try_element_at(parts, F.lit(2))).alias("id"))
    return kept.withColumn("query", F.when(F.col("query") == "", F.raise_error(F.lit("a query line has no text")).cast("string")).otherwise(F.col("query")))


def lead_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """NDJSON lines (value) -> leads: lines that are no objects and rows without a title are dropped."""
    rows = lines.where(F.ltrim("value").startswith("{")).select(F.from_json("value", LEAD).alias("l")).select("l.*").where(F.trim(F.coalesce("title", F.lit(""))) != "")
    return rows.limit(limit) if limit else rows


def lead_list(documents: DataFrame) -> DataFrame:
    """JSON texts (value), each an array of leads or an object with `leads`."""
    array = F.from_json("value", f"array<struct<{_fields()}>>")
    inner = F.from_json("value", f"leads array<struct<{_fields()}>>")["leads"]
    return documents.select(F.explode(F.when(F.ltrim("value").startswith("["), array).otherwise(inner)).alias("l")).select("l.*")


def _fields() -> str:
    return ",".join(f"{n}:{k}" for n, k in (f.strip().split(" ", 1) for f in LEAD.split(",")))


def lead_grid(rows: DataFrame) -> DataFrame:
    """A CSV grid of texts with any header case -> leads: one quote off each end, JSON cells, emails split at commas."""
    by_name = {c.strip().lower(): c for c in rows.columns}

    def cell(*names: str) -> Column:
        own = [F.nullif(F.regexp_replace(F.col(f"`{by_name[n]}`"), "^\"|\"$", ""), F.lit("")) for n in names if n in by_name]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    return rows.select(
        cell("cid").alias("cid"), cell("title", "name").alias("title"), cell("category").alias("category"), numbers.parse_list(cell("categories")).alias("categories"),
        cell("address").alias("address"), cell("website", "web_site").alias("web_site"), cell("phone").alias("phone"), cell("review_count").try_cast("int").alias("review_count"),
        F.replace(cell("review_rating", "rating"), F.lit(","), F.lit(".")).try_cast("double").alias("review_rating"), cell("latitude").try_cast("double").alias("latitude"),
        cell("longitude", "longtitude").try_cast("double").alias("longitude"), F.filter(F.transform(F.split(F.coalesce(cell("emails", "email"), F.lit("")), ","), lambda x: F.trim(x)), lambda e: e != "").alias("emails"),
    ).where(F.coalesce("title", F.lit("")) != "")


def csv_grid(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with a header, all cells text; short rows give nulls."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=True, **options)


def csv_fields(line: Column, width: int) -> Column:
    """Cells of one RFC 4180 line."""
    kind = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(line, F.lit(kind), {"quote": '"', "escape": '"'})


def job_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored jobs; Parquet stands in for a database without a driver here."""
    return spark.read.parquet(path)


def place_card(text: Column) -> Column:
    """Struct rating, review_count, category, address of a result card's text lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    first = lambda p: F.try_element_at(F.filter(lines, lambda x: x.rlike(p)), F.lit(1))
    rated = r"^(\d[.,]\d)\s*(?:\(([\d.,]+\s*[KkMm]?)\))?"
    row = first(rated)
    middle = first(r"\S\s+·\s+\S")
    parts = F.transform(F.split(middle, "·"), lambda x: F.trim(x))
    return F.struct(
        F.replace(F.nullif(F.regexp_extract(row, rated, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double").alias("rating"), numbers.shorthand(F.nullif(F.regexp_extract(row, rated, 2), F.lit(""))).alias("review_count"),
        parts[0].alias("category"), F.try_element_at(parts, F.lit(-1)).alias("address"),
    )


def geocoded(rows: DataFrame) -> DataFrame:
    """Captured answers (query, place, name, city, state, country, lat, lon, kind) -> distinct places with a label."""
    shown = F.array_join(F.array_distinct(F.array_compact(F.array("name", "city", "state", "country"))), ", ")
    made = rows.select("query", "place", shown.alias("display"), F.format_string("%.6f", "lat").alias("lat"), F.format_string("%.6f", "lon").alias("lon"), F.when(F.col("kind").isin("city", "town", "village"), "city").when(F.col("kind").isin("state", "county"), "region").when(F.col("kind") == "country", "country").otherwise("place").alias("label"))
    from ..operators.crawl import first_wins

    return first_wins(made.withColumn("_key", F.lower(F.concat_ws("|", "display", "lat", "lon"))), ["query", "_key"], ["place"]).drop("_key")


def geocode_candidates(query: Column) -> Column:
    """The query, the part before its comma, and the query without a closing two-letter region."""
    return F.array_distinct(F.filter(F.array(F.trim(query), F.trim(F.substring_index(query, ",", 1)), F.trim(F.regexp_replace(query, r"[\s,-]+[A-Za-z]{2}$", ""))), lambda q: q != ""))
