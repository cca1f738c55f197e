"""Pages, crawls, leads, jobs, payloads, sinks and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import crawl, dom, jobs, leads, places, social
from pagewright.sources import readers, sinks
from pagewright.streaming import streams

PAGE = """<html><head><title>Doc</title><meta name="description" content=" D "><meta property="og:title" content="OG"><script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/menu">Menu</a></nav><article><h1>Head</h1><p>One <b>bold</b> and <a href="../api">link</a>.<br/>Next</p><p>Two <a href="../api">again</a></p>
<table><tr><th>Plan</th><th>Price</th></tr><tr><td>A</td><td>1</td></tr></table><ul><li>x</li><li>y</li></ul><img src="/i.png" alt="pic"></article><footer>F</footer></body></html>"""


def test_markdown():
    md = dom.to_markdown(PAGE, "https://s.com/v1/intro")
    assert md.startswith("# Head\n\nOne **bold** and [link](https://s.com/api).") and "| Plan | Price |\n| --- | --- |\n| A | 1 |" in md and "*   x\n*   y" in md
    assert "Menu" not in md and "\n\n\n" not in md and "F" not in md.split()
    assert dom.to_markdown(PAGE, "https://s.com/v1/", links="references").endswith("### Referências\n[1]: https://s.com/api")
    assert "[link]" not in dom.to_markdown(PAGE, links="strip") and "[Imagem: pic]" in dom.to_markdown(PAGE, images="alt_only")
    assert dom.to_markdown(PAGE, selector="li") == "x" and dom.to_markdown(PAGE, selector="#none").startswith("# Head")
    assert dom.to_markdown(None) == "" and dom.to_markdown("<table></table><p>x</p>") == "x"
    cards = "<div>" + "".join(f'<a href="/{i}">headline number {i}</a> ' for i in range(30)) + "</div>"
    assert "headline number 7" in dom.to_markdown(cards)


def test_selectors():
    root = dom.parse('<div id="a" class="x y"><p data-k="v1">1</p><section><p>2</p></section></div><p>3</p>')
    text = lambda s: [e.text() for e in dom.select(root, s)]
    assert text("#a p") == ["1", "2"] and text("div > p") == ["1"] and text(".x.y section p, body") == ["2"] and text('[data-k^="v"]') == ["1"] and text("p") == ["1", "2", "3"]
    with pytest.raises(ValueError):
        dom.compile_selector("p:hover")


def test_page_products(spark):
    df = spark.createDataFrame([(PAGE, "https://s.com/v1/"), (None, None)], "html string, url string")
    rows = df.select(dom.products(F.col("html"), F.col("url"), ["metadata", "links", "visible", "audit", "fields"], schema={"cells": "td", "first": "a@href", "none": "h6"}).alias("p")).collect()
    p = next(r.p for r in rows if r.p.metadata.title)
    assert (p.metadata.title, p.metadata.description, p.metadata.og_title, p.metadata.json_ld) == ("Doc", "D", "OG", ['{"a": 1}'])
    assert [x.href for x in p.links] == ["https://s.com/menu", "https://s.com/api", "https://s.com/api"]
    assert p.fields == {"cells": ["A", "1"], "first": ["/menu", "../api", "../api"], "none": []}
    assert "Two" in p.visible and "bad" not in p.visible and p.audit.seo_score == 65


def test_bodies(spark):
    rows = [("a", "é".encode("latin-1"), "text/html; charset=iso-8859-1"), ("b", "﻿é".encode(), ""), ("c", "<meta charset=latin1>é".encode("latin-1"), ""), ("d", b"%PDF-1.7", None), ("e", b"x\r\ny ", "text/plain; charset=nonsense"), ("f", None, None)]
    out = {r.url: r for r in dom.document_text(spark.createDataFrame(rows, "url string, content binary, content_type string")).collect()}
    assert [out[k].text for k in "abe"] == ["é", "é", "x\ny"] and out["c"].text == "é" and out["d"].kind == "pdf" and out["d"].parse_error == "PDF could not be parsed: it has no pages"


def test_robots(spark):
    files = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\n\nUser-agent: me\nUser-agent: you\nDisallow:\nDisallow: /mine\nSitemap: https://a.com/s.xml")], "host string, body string")
    pages = spark.createDataFrame([(f"https://a.com{p}",) for p in ("/p", "/p/ok/1", "/x.pdf", "/x.pdf?a", "/mine", "/robots.txt", "/%70")], "url string")
    view = lambda agent: {r.url[13:]: r.allowed for r in crawl.allowed(pages, crawl.robots_rules(files, agent)).collect()}
    assert view("other") == {"/p": False, "/p/ok/1": True, "/x.pdf": False, "/x.pdf?a": True, "/mine": True, "/robots.txt": True, "/%70": False}
    assert view("YOU") == {"/p": True, "/p/ok/1": True, "/x.pdf": True, "/x.pdf?a": True, "/mine": False, "/robots.txt": True, "/%70": True}
    assert [r.url for r in crawl.robots_sitemaps(files).collect()] == ["https://a.com/s.xml"]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in crawl.crawl(edges, starts, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.url for r in crawl.crawl(edges, starts, 9, 2).collect()] == ["a", "b"]
    links = spark.createDataFrame([("https://a.com", "https://a.com/fale-conosco", "x", 0), ("https://a.com", "https://b.com/contato", "Contato", 1), ("https://a.com", "https://a.com/q", "Equipe", 2), ("https://a.com", "https://a.com/contact.pdf", "y", 3)], "site string, href string, text string, place int")
    assert [(r.href, r.rank) for r in crawl.contact_pages(links).orderBy("rank").collect()] == [("https://a.com/fale-conosco", 0), ("https://a.com/q", 2)]


def test_sequential_operators(spark):
    obs = spark.createDataFrame([(1, 0.0, True, 100), (1, 1.0, True, 100), (1, 1.5, True, 100), (1, 3.0, False, 100), (1, 4.0, True, 9000)], "worker int, at_s double, success boolean, latency_ms int")
    assert [r.limit for r in jobs.adaptive_concurrency(obs, 1, 3).orderBy("at_s").collect()] == [2, 3, 3, 2, 2]
    reviews = spark.createDataFrame([("p", 0, "a", "x" * 25), ("p", 1, "a", "x" * 20 + "yyyyyy"), ("p", 2, "a", "short"), ("p", 3, "a", "short"), ("p", 4, "", "z"), ("p", 5, "b", "short")], "place_id string, ord int, author string, text string")
    assert sorted(r.ord for r in places.distinct_reviews(reviews).collect()) == [0, 2, 5]
    assert [r.delay_ms for r in jobs.backoff_schedule(500, 2, 3, spark).collect()] == [500, 1000, 2000]


def test_drifted_places(spark):
    d = ["null"] * 20
    d[11], d[9] = '"Shop"', "[null,null,1.5,2.5]"
    good = "[" + ",".join(d) + "]"
    rows = [(1, f"[null,null,{good}]"), (2, "[1]"), (3, "no json"), (4, "[null,null,null,null,null,null,[1,2]]")]
    out = {r.id: r for r in places.decode_places(spark.createDataFrame(rows, "id int, raw string")).collect()}
    assert (out[1].title, out[1].latitude, out[1].drift) == ("Shop", 1.5, None) and out[2].drift == "place-data" and out[3].drift == "decode" and out[4].drift == "required-field"
    assert out[1].reviews_per_rating == dict.fromkeys(range(1, 6), 0)


def test_search_list(spark):
    b = [None] * 179
    b[0], b[11], b[2], b[9], b[178], b[4] = "id1", "Shop", ["Main St", "Town"], [None, None, 1.286785, 103.854503], [["+1 2"]], [None] * 7 + [4.5, 10]
    body = "first line\n" + json.dumps([["", [None, [None] * 14 + [b]]]])
    r = places.decode_search(spark.createDataFrame([(1, body)], "id int, body string")).first()
    assert (r.id, r.title, r.address, r.phone, r.plus_code, r.review_count) == ("id1", "Shop", "Main St, Town", "+12", "6PH57VP3+PR", 10)


def test_items(spark):
    one = '{"id":"7","desc":"d","createTime":"1700000000","author":{"uniqueId":"me"},"video":{"duration":"0"},"stats":{"playCount":"5"},"statsV2":{"playCount":"9","diggCount":"3"}}'
    rows = spark.createDataFrame([(1, 0, one), (0, 0, one.replace('"5"', '"6"')), (1, 1, "broken")], "source_rank int, place int, raw string")
    r = social.item_videos(rows).collect()
    assert [(x.id, x.views, x.likes, x.seconds, x.created) for x in r] == [("7", 6, 3, None, "2023-11-14T22:13:20.000Z")]
    posts = spark.createDataFrame([("q", '{"data":{"children":[{"data":{"id":"1","title":"Recommend one","permalink":"/r/x","created_utc":0}},{"data":{"id":"2"}}]}}')], "query string, raw string")
    p = social.forum_posts(posts, F.lit("2026-01-01").cast("timestamp")).collect()
    assert [(x.id, x.category, x.subreddit, x.url, x.created) for x in p] == [("1", "recommendation_request", "unknown", "https://reddit.com/r/x", "2026-01-01T00:00:00.000Z")]
    assert [r[0] for r in spark.range(1).select(social.post_text(F.lit("hi\nTranslate\nthere\n1\n/\n2"))).collect()] == ["hi\nthere"]


def test_grids(spark):
    box = spark.createDataFrame([(1, -1.0, 179.0, 1.0, -179.0, 100.0)], "box_id int, min_lat double, min_lon double, max_lat double, max_lon double, cell_km double")
    cells = leads.grid_cells(box).collect()
    assert 1 <= len(cells) <= 20 and all(-180 <= c.lon <= 180 for c in cells)
    with pytest.raises(Exception, match="too many cells"):
        leads.grid_cells(box.withColumn("cell_km", F.lit(1.0)), 2).collect()
    pole = box.withColumn("min_lat", F.lit(89.0)).withColumn("max_lat", F.lit(90.0))
    assert 0 < leads.grid_cells(pole).count() < 100


def test_readers(spark):
    lines = spark.createDataFrame([('[{"title":"a"},{"title":"b"}]',), ('{"leads":[{"title":"c"}]}',)], "value string")
    assert [r.title for r in readers.lead_list(lines).collect()] == ["a", "b", "c"]
    grid = spark.createDataFrame([('"A"', "4,5", "x@y.com, z@y.com", '["p","q"]'), ("", "1", None, None)], "Title string, Rating string, EMAILS string, categories string")
    r = readers.lead_grid(grid).collect()
    assert len(r) == 1 and (r[0].title, r[0].review_rating, r[0].emails, r[0].categories) == ("A", 4.5, ["x@y.com", "z@y.com"], ["p", "q"])
    with pytest.raises(Exception, match="no text"):
        readers.query_lines(spark.createDataFrame([("#!#1",)], "value string")).collect()
    card = spark.range(1).select(readers.place_card(F.lit("Cafe X\n4,6(1.2K)\nCafe · Main St 1\nOpen")).alias("c")).first().c
    assert (card.rating, card.review_count, card.category, card.address) == (4.6, 1200, "Cafe", "Main St 1")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x", -1.5, ["a", "b"]), ("é;", 2.0, None)], "t string, n double, l array<string>")
    assert [r.value for r in sinks.safe_lines(df, ";", ",").collect()] == ["'=x;-1,5;\"a; b\"", '"é;";2,0;']
    sinks.write_safe_csv(df.coalesce(1), str(tmp_path / "out"), bom=True)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert raw.startswith("﻿t,n,l\r\n".encode()) and raw.count(b"\r\n") == 3
    a, b = sinks.export_manifest(df, "f").first(), sinks.export_manifest(df.orderBy("n"), "f").first()
    assert a == b and a.row_count == 2
    back = readers.csv_grid(spark, str(tmp_path / "out"))
    assert back.count() == 2
    nul = spark.createDataFrame([("a\x00b", ["\x00"], {"k\x00": "v"}, ("x\x00",))], "s string, a array<string>, m map<string,string>, t struct<u string>")
    r = leads.nul_free(nul).first()
    assert (r.s, r.a, r.m, r.t.u) == ("ab", [""], {"k": "v"}, "x")


def test_plans(spark):
    r = spark.createDataFrame([(1, "Cafe", ["no website", "no whatsapp"]), (2, "Bar", [])], "lead_id int, title string, weaknesses array<string>")
    plan = leads.growth_plan(r).collect()
    assert len(plan) == 1 and len(plan[0].steps) == 2 and plan[0].all_passed
    job = spark.createDataFrame([(1, "x")], "id int, q string").select(jobs.payload_envelope(F.struct("id", "q")).alias("e"))
    assert job.select(jobs.payload_intact(F.col("e")).alias("ok")).first().ok
    assert not job.select(F.struct(F.lit("{}").alias("data"), F.col("e.sha256").alias("sha256")).alias("e")).select(jobs.payload_intact(F.col("e")).alias("ok")).first().ok


def test_profiles(spark):
    one = lambda c: spark.range(1).select(c.alias("y")).first().y
    none = F.lit(None).cast("string")
    t = lambda raw, p=none: one(social.watch_target(F.lit(raw), p))
    assert (t("https://www.facebook.com/groups/12/").handle, t("https://facebook.com/profile.php?id=7").url) == ("/groups/12", "https://www.facebook.com/profile.php?id=7")
    assert t("https://facebook.com/watch").platform is None and t("https://x.com/home").reason == "not a profile" and t("@me").platform is None
    assert t("https://www.threads.net/@p").url == "https://www.threads.com/@p"
    got = one(social.header_name_bio(F.lit("shop\nThe Shop\n10 posts\n83,1 mil seguidores\n2 seguindo\nWe sell\nthings\nmais\nx")))
    assert (got.name, got.bio) == ("The Shop", "We sell\nthings")
    assert one(social.description_bio(F.lit("5,8 mi seguidores • 175 threads • Hello there. Veja as conversas mais recentes com @x"))) == "Hello there."


def test_job_parameters():
    assert jobs.validated({"keywords": [" a ", "A", ""], "depth": 0})["keywords"] == ["a"]
    assert jobs.validated({"keywords": ["a"]})["zoom"] == 15
    for bad in ({"keywords": []}, {"keywords": ["a"], "zoom": 99}, {"keywords": ["a" * 301]}, {"keywords": ["a"], "fast_mode": True}, {"keywords": ["a"], "lang": "x"}):
        with pytest.raises(ValueError):
            jobs.validated(bad)
    with pytest.raises(ValueError, match="formats"):
        jobs.checked_fields({"url": 1, "formats": 2}, {"url"})


def test_bench_table(spark):
    rows = [("a", "br", True, 1500, 10, 1), ("a", "us", False, 9, 9, 0)]
    made = jobs.bench_table(jobs.bench_summary(spark.createDataFrame(rows, "tool string, country string, ok boolean, ms int, tokens int, emails int")))
    lines = [r.line for r in made.orderBy("place").collect()]
    assert lines[0] == jobs.BENCH_HEADER and lines[2] == "| a | all | 2 | 1 (50%) | 1.50 | 1.50 | 10 | 0.50 | 1 |" and lines[4] == "| a | us | 1 | 0 (0%) | – | – | – | 0.00 | 0 |"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t), ("b", t + dt.timedelta(minutes=1)), ("a", t + dt.timedelta(minutes=2))]
    spark.createDataFrame(rows, "lead_key string, seen_at timestamp").coalesce(1).write.parquet(src)
    stream = streams.leads_once(spark.readStream.schema("lead_key string, seen_at timestamp").parquet(src))
    q = stream.writeStream.format("memory").queryName("leads_once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(r.lead_key for r in spark.table("leads_once").collect()) == ["a", "b"]
    jobs_in = str(tmp_path / "jobs")
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "succeeded"), (1, 4, "running"), (2, 1, "queued")], "job_id long, at_ms long, status string").coalesce(1).write.parquet(jobs_in)
    stream = streams.job_states(spark.readStream.schema("job_id long, at_ms long, status string").parquet(jobs_in))
    q = stream.writeStream.format("memory").queryName("job_states").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {(r.job_id, r.before, r.status) for r in spark.table("job_states").collect()} == {(1, None, "queued"), (1, "queued", "running"), (1, "running", "succeeded"), (2, None, "queued")}
    seen = []
    streams.drift_batches(lambda *x: seen.append(x), ["phone"])(spark.createDataFrame([("",), (None,)], "phone string"), 3)
    assert seen == [(3, 2, {"phone": 1.0}, True)]


def test_contacts_of_pages(spark):
    html = """<html><body><p>Ligue (62) 99999-9999. CNPJ 04.740.714/0001-97. vendas@loja.com.br</p><a href="tel:+556233334444">Telefone</a>
    <a href="https://instagram.com/loja">Instagram</a><a href="https://instagram.com/p/1">post</a><a href="https://wa.me/5562999999999">chat</a></body></html>"""
    made = leads.contacts(spark.createDataFrame([("loja", "https://loja.com.br/", 0, html)], "site string, url string, page_rank int, html string"))
    assert sorted((r.type, r.origin, r.value) for r in made.collect()) == [
        ("cnpj", "text", "04740714000197"), ("email", "text", "vendas@loja.com.br"), ("phone", "tel", "+556233334444"), ("phone", "text", "+5562999999999"),
        ("social", "instagram", "https://instagram.com/loja"), ("whatsapp", "html", "5562999999999"), ("whatsapp", "link", "5562999999999"),
    ]
    one = leads.merged_contacts(made).collect()[0]
    assert [(p.value, p.whatsapp) for p in one.phones] == [("+556233334444", False), ("+5562999999999", True)] and one.cnpjs == ["04740714000197"]


def test_links_give_contacts(spark):
    """Mail and protected links, and phone links whose number is only possible."""
    key = 0x5A
    hidden = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "oi@olaria.com.br")
    html = f"""<body><a href="MAILTO:Vendas@olaria.com.br?subject=x">mail</a><a href="/cdn-cgi/l/email-protection#{hidden}">x</a><a href="/cdn-cgi/l/email-protection">no code</a>
    <a href="tel:+55 81 1234-5678">desk</a><a href="tel:(81) 98123-4567">cell</a><a href="tel:1">short</a><a href="whatsapp://send?phone=5581981234567">chat</a></body>"""
    made = leads.contacts(spark.createDataFrame([("s", "https://olaria.com.br/", 0, html)], "site string, url string, page_rank int, html string"))
    one = leads.merged_contacts(made).collect()[0]
    assert one.emails == ["oi@olaria.com.br", "vendas@olaria.com.br"] and one.whatsapps == ["5581981234567"]
    assert [(p.value, p.origin, p.whatsapp) for p in one.phones] == [("+558112345678", "tel", False), ("+5581981234567", "tel", True)]


def test_contact_pages_by_whole_words(spark):
    root = "https://s.example/inicio/"
    paths = [("contato-e-localizacao", "", 0), ("sobremesas", "", None), ("steam", "", None), ("x", "Entre em Contato", 0), ("Fale%20Conosco.php", "", 0), ("inicio", "Contato", None), ("institucional", "", 1), ("a/nossa-equipe/b", "", 2), ("corpo-cl%C3%ADnico", "", 2), ("trabalhe-conosco?x=1", "", 3), ("contato.webp", "", None), ("y", "word " * 12 + "contato", None)]
    for path, text, rank in paths:
        links = spark.createDataFrame([(root, f"https://s.example/{path}", text, 0)], "site string, href string, text string, place int")
        assert [r.rank for r in crawl.contact_pages(links).collect()] == ([] if rank is None else [rank]), path


def test_locale_and_city(spark):
    rows = [("BR", "10 Main St, London", "pt", None), ("", "10 High St, Leeds LS1 4AB", "en", "10 High St"), (None, "Dublin, Ireland", "en", "Dublin"), (None, "Rua A, 10, Recife - PE, 50000-000", "pt", "Recife"), (None, "10 Main St, 74000-000, Brazil", "pt", None), (None, "Recife - PE", "pt", "Recife"), ("FR", None, "en", None)]
    df = spark.createDataFrame([(c, a) for c, a, _, _ in rows], "country string, address string")
    got = df.select(leads.locale_of(F.col("country"), F.col("address")).alias("l"), leads.city_of(F.col("address")).alias("c")).collect()
    cities = [c for *_, c in rows]
    assert [r.l for r in got] == [x for _, _, x, _ in rows] and [r.c for r in got][2:] == cities[2:]


def test_refused_rows_come_back(spark):
    rows = spark.createDataFrame([(i, "bad" if i in (7, 31) else "nul\x00" if i == 12 else f"t{i}") for i in range(40)], "id int, text string").coalesce(1)

    def write(batch):
        if any(r["text"] == "bad" or "\x00" in r["text"] for r in batch):
            raise ValueError("no such text")

    refused = sinks.written_in_batches(rows, write, size=10, retries=2)
    assert sorted((r.value, r.reason) for r in refused.collect()) == [('{"id": 31, "text": "bad"}', "no such text"), ('{"id": 7, "text": "bad"}', "no such text")]
    assert sinks.write_totals(rows, refused).collect()[0].asDict() == {"accepted": 38, "rejected": 2}


def test_publishing_is_whole_or_partial(spark, tmp_path):
    df = spark.createDataFrame([("=1", 1), ("b", 2)], "a string, n int")
    assert sinks.publish(df, str(tmp_path / "out")) == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]

    def broken(rows, path):
        rows.limit(1).write.csv(path)
        raise RuntimeError("the disk is gone")

    with pytest.raises(RuntimeError):
        sinks.publish(df, str(tmp_path / "late"), broken)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["late.partial", "out"]
    (tmp_path / "in.csv").write_text('h,v\n"=x",1\nplain,2\n')
    assert sinks.sanitised_copy(spark, str(tmp_path / "in.csv"), str(tmp_path / "safe")) == 2
    assert "'=x" in "".join(p.read_text() for p in (tmp_path / "safe").glob("part-*"))


def test_large_bodies_and_final_urls(spark):
    rows = [("https://a.example/x", "https://b.example/y/z", bytearray(b"<p><a href='../w'>link to a page</a> and words around it</p>"), "text/html"), ("https://a.example/big", "https://a.example/big", bytearray(b"x" * 5000), "text/plain")]
    out = {r.url: r for r in dom.document_text(spark.createDataFrame(rows, "url string, final_url string, content binary, content_type string"), most_bytes=1000).collect()}
    assert "(https://b.example/w)" in out["https://a.example/x"].text and out["https://a.example/x"].final_url == "https://b.example/y/z"
    assert out["https://a.example/big"].text is None and out["https://a.example/big"].parse_error == "the body is too large"


def test_states_are_checked(spark):
    own = spark.createDataFrame([(1, "running", "w", 1, "")], "job_id int, status string, worker_id string, attempts int, error string")
    with pytest.raises(ValueError):
        jobs.with_status(own, "sleeping")
    assert jobs.with_status(own).count() == 1
    with pytest.raises(Exception, match="terminal"):
        jobs.finished(own.selectExpr("*", "cast(null as timestamp) lease_expires_at", "cast(null as timestamp) updated_at"), spark.createDataFrame([(1, "queued", "")], "job_id int, status string, error string"), F.current_timestamp()).collect()


def test_each_rule_is_one_expression(spark):
    """Lint and intent: no rule stands twice in the optimised plan."""
    from pagewright.functions import intent, slop

    docs = spark.createDataFrame([("some text",)], "text string")
    for made, rules in ((slop.lint(F.col("text")), len(slop.rules())), (intent.score(F.col("text")), sum(map(len, (intent.LEXICONS["generic"].buyer, intent.LEXICONS["generic"].question, intent.LEXICONS["generic"].seller))))):
        plan = docs.select(made.alias("x")).select("x.*")._jdf.queryExecution().optimizedPlan().toString()
        uses = plan.count("regexp_extract_all(") + plan.count("regexp_extract(")
        assert rules <= uses <= rules + 8, uses


def test_select_fields_in_sql(spark):
    dom.register_functions(spark)
    spark.createDataFrame([(1, "<h1>A</h1><a href='/x'>l</a><p>b<p>c", "https://s.example/d/"), (2, None, None)], "id int, html string, url string").createOrReplaceTempView("bodies")
    got = spark.sql("""SELECT id, f.* FROM bodies, LATERAL select_fields(html, url, '{"Head line": "h1", "to": "a@href", "p": "p"}') f ORDER BY id""")
    assert got.columns == ["id", "Head line", "to", "p"]
    assert [tuple(r) for r in got.collect()] == [(1, ["A"], ["https://s.example/x"], ["b", "c"]), (2, [], [], [])]
    for bad in ("url", "'{}'", "'[1]'", "NULL", """'{"a": "p", "A": "p"}'"""):
        with pytest.raises(Exception, match="select_fields"):
            spark.sql(f"SELECT * FROM bodies, LATERAL select_fields(html, url, {bad})").collect()
