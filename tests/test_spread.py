"""Work on small files and in crowded cells goes over all cores, with the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import dom, leads
from pagewright.plans import bodies, contacts, flagship, texts, vectors  # noqa: F401
from pagewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["find_phones", "extract_cnpjs", "markdown_vectors", "protected_email", "slop_score", "readable_pages", "page_products"])
def test_cases_of_a_small_table_are_many_tasks(spark, name):
    """F3, F5, F9 to F13: one small file was one task, whatever its rows cost."""
    df = QUERIES[name](spark, SF)
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_one_crowded_cell_is_many_tasks(spark, monkeypatch):
    """F8: places around a pole share a cell, whose pairs were one task."""
    monkeypatch.setattr(leads, "PAIRS_A_SHARE", 500, raising=False)
    points = spark.range(400).select(F.col("id").alias("point"), (F.lit(89.5) + F.col("id") % 5 / 10).alias("latitude"), (F.col("id") * 7 % 360 - 180.0).alias("longitude"))
    centres = spark.range(30).select(F.col("id").alias("centre"), F.lit(89.9).alias("centre_latitude"), (F.col("id") * 12 - 180.0).alias("centre_longitude"))
    found = leads.near(points, centres, 250_000.0)
    assert found.count() == found.distinct().count() == 400 * 30
    sizes = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert sizes <= 400 * 30 // 4


def test_pages_come_in_small_batches_and_equal_ones_once(spark, tmp_path):
    """a worker held 10,000 pages at once, and parsed each copy of one again."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        pages = spark.range(5000, numPartitions=1).select("id", F.concat(F.lit("<main><p>Page "), F.col("id") % 3, F.lit("</p></main>")).alias("html"), F.lit("https://a.example/").alias("url"))
        made = pages.select("id", dom.products(F.col("html"), F.col("url"), ["markdown"])["markdown"].alias("md"))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
        assert made.where(F.col("md") != F.concat(F.lit("Page "), F.col("id") % 3)).count() == 0 and made.count() == 5000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
