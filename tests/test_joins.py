import math
import random

from pagewright.functions import urls
from pagewright.operators import crawl, leads


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371e3 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def test_places_near_centres(spark):
    r = random.Random(1)
    places = [(r.choice([90.0, -90.0, 89.9, 0.0, 12.5, r.uniform(-90, 90)]), r.choice([180.0, -180.0, 179.9, -179.95, 0.0, r.uniform(-180, 180)])) for _ in range(150)]
    points = [(i, *p) for i, p in enumerate(places)] + [(900, None, 1.0), (901, 95.0, 1.0), (902, float("nan"), 0.0), (903, 12.5, 0.0), (903, 12.5, 0.0)]
    centres = [(i, *p) for i, p in enumerate(r.sample(places, 40))] + [(99, None, None)]
    a = spark.createDataFrame(points, "point int, latitude double, longitude double")
    b = spark.createDataFrame(centres, "centre int, centre_latitude double, centre_longitude double")
    for metres in (0.0, 1.0, 20_000.0, 900_000.0, 8_000_000.0, 30_000_000.0):
        got = sorted((x.point, x.centre) for x in leads.near(a, b, metres).collect())
        want = sorted((p, c) for p, y, x in points for c, v, u in centres if None not in (y, v) and abs(y) <= 90 and distance(v, u, y, x) <= metres)
        assert got == want, metres
    plan = leads.near(a, b, 5000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cartesian" not in plan and "(band" in plan


def test_rules_by_heads(spark, monkeypatch):
    """Equal to trying every rule; a host with all pages is dealt out in shares."""
    monkeypatch.setattr(crawl, "A_SHARE", 20)
    monkeypatch.setattr(crawl, "FEW_HOSTS", 1)
    r = random.Random(2)
    word = lambda: "".join(r.choice("ab/") for _ in range(r.randint(0, 5)))
    pages = spark.createDataFrame([(f"https://{r.choice(['one.example'] * 5 + ['two.example', 'none.example'])}/{word()}{r.choice(['', '?q=' + word()])}",) for _ in range(200)] + [("no url",), (None,)], "url string")
    rules = spark.createDataFrame([(h, r.random() < 0.5, r.choice(["/", "*", "/*"]) + word() + r.choice(["", "*", "$", "*" + word(), "*" + word() + "$"])) for h in ("one.example", "two.example") for _ in range(25)], "host string, allow boolean, pattern string")
    got = {x.url: x.allowed for x in crawl.allowed(pages, rules).collect()}
    from pyspark.sql import functions as F

    at = pages.distinct().withColumn("h", urls.host(F.col("url"))).withColumn("p", F.concat(F.coalesce(F.nullif(urls.part(F.col("url"), "PATH"), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), urls.part(F.col("url"), "QUERY")), F.lit(""))))
    tried = at.join(rules, at.h == rules.host, "left").withColumn("hit", F.expr("p").rlike("x") | F.expr("true"))
    every = {}
    import re

    for x in tried.collect():
        best = every.setdefault(x.url, (0, True))
        if x.pattern is not None:
            body = x.pattern.removesuffix("$")
            if re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + ("$" if body != x.pattern else ""), x.p):
                every[x.url] = max(best, (len(x.pattern), x.allow))
    assert got == {u: v[1] for u, v in every.items()}


def test_no_rules_at_all(spark):
    pages = spark.createDataFrame([("https://a.example/x",)], "url string")
    assert [x.allowed for x in crawl.allowed(pages, spark.createDataFrame([], "host string, allow boolean, pattern string")).collect()] == [True]
