"""Literal cases of the functions."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import email, intent, numbers, pages, phone, slop, urls


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_email(spark):
    cases = {
        "mailto:%20Contato@Empresa.com?subject=Oi": "contato@empresa.com", "<vendas@loja.com.br>.": "vendas@loja.com.br", "user@example.com": None, "logo@2x.png": None, "icon@2x.retina.com": None,
        "0123456789abcdef0123456789abcdef@sentry.example.dev": None, "a..b@empresa.com": None, "nome@-empresa.com": None, "nome@empresa": None, "a+b@firm.com": "a+b@firm.com", "x@%zz.com": None, "": None, None: None, "a@b@c.com": None,
    }
    assert values(spark, email.clean, list(cases)) == list(cases.values())


def test_find_email(spark):
    cases = {"vendas(arroba)loja(ponto)com(ponto)br": ["vendas@loja.com.br"], "a@firm.com or b {at} firm {dot} com, a@firm.com": ["a@firm.com", "b@firm.com"], "look at this": [], "é@x": []}
    assert values(spark, email.find, list(cases)) == list(cases.values())
    assert values(spark, email.kind, ["contato.sp@x.com", "dr.carlos@x.com", "vendas2@x.com"]) == ["role", "personal", "role"]
    assert values(spark, email.decode_protected, ["7a1b1a1b", "zz", "7a", None])[1:] == [None, None, None]


def test_phone(spark):
    cases = {
        "(62) 99999-9999": ("+5562999999999", "mobile", True), "+55 (11) 3333-4444": ("+551133334444", "fixed", True), "123.456.789-09": None, "12.345.678/0001-95": None, "74000-000": None, "1712345678": None,
        "2019-2026": None, "11945678941": None, "(62) 8999-9999": ("+5562989999999", "mobile", True), "(20) 99876-5432": ("+5520998765432", "unknown", False), "": None, None: None, "5562999999999": ("+5562999999999", "mobile", True),
    }
    got = values(spark, phone.normalise, list(cases))
    assert [None if g is None else (g.e164, g.type, g.valid) for g in got] == list(cases.values())
    assert values(spark, lambda c: phone.key(c, context="tel"), ["11945678941"]) == ["+5511945678941"]
    assert values(spark, lambda c: phone.key(c, region="GB"), ["020 7946 0958"]) == ["+442079460958"]
    assert values(spark, phone.country_to_region, ["Brasil", "uk", "United States", "br", "Nowhere"]) == ["BR", "GB", "US", "BR", None]


def test_ids(spark):
    assert values(spark, phone.valid_cnpj, ["12.ABC.345/01DE-35", "11.111.111/1111-11", "11.222.333/0001-81", "12abc34501de35", None]) == [True, False, True, False, False]
    assert values(spark, phone.cnpj_check_digits, ["1345C3A50001", "000000000000", "x"]) == ["06", None, None]
    assert values(spark, phone.cnpj_formatted, ["11222333000181", "nope"]) == ["11.222.333/0001-81", "nope"]
    assert values(spark, phone.valid_cpf, ["52998224725", "11111111111", "52998224726", None]) == [True, False, False, False]


def test_numbers(spark):
    assert values(spark, numbers.shorthand, ["12.5K", "5,2 mil", "10.000", "350", "1.2M", "3 mi", "1,5 bi", "", "abc", None]) == [12500, 5200, 10000, 350, 1200000, 3000000, 1500000000, None, None, None]
    assert values(spark, lambda c: numbers.count_before(c, ["followers", "seguidores"]), ["83,1 mil seguidores · 2 seguindo", "1.2 million followers", "none"]) == [83100, 1200000, None]
    assert values(spark, numbers.utf16_length, ["a🕷b", "é"]) == [4, 1]
    assert [str(x) for x in values(spark, numbers.long_date, ["14 de março de 2026 às 09:05", "March 14, 2026 at 9:05 PM", "no date"])] == ["2026-03-14 09:05:00", "2026-03-14 21:05:00", "None"]


def test_urls(spark):
    assert values(spark, urls.canonical, ["https://A.com/x?b=2&utm_source=q&a=1#top", "https://a.com", "nonsense", "http://a.com:80/?fbclid=1"]) == ["https://a.com/x?a=1&b=2", "https://a.com/", "nonsense", "http://a.com/"]
    assert values(spark, lambda c: urls.domain_key(c, F.lit("Clínica São João")), ["https://www.Firm.com.br/x", "", None]) == ["firm.com.br", "clinica-sao-joao.surrogate", "clinica-sao-joao.surrogate"]
    assert values(spark, lambda c: urls.passes(c, "a.com", ["/blog/*/x"], ["draft"]), ["https://a.com/blog/1/x", "https://a.com/blog/1/x?draft", "https://b.com/blog/1/x", "https://a.com/"]) == [True, False, False, False]
    for bad in ("a|b", "x.*", "(a)", "a" * 201):
        with pytest.raises(ValueError):
            urls.pattern_regex(bad)
    assert values(spark, urls.robots_path, ["/%70rivate", "/é", "/a%2fb"]) == ["/private", "/%C3%A9", "/a%2Fb"]
    assert values(spark, urls.unwrap_redirect, ["/url?q=https://x.com/%3Fa&sa=U", "https://x.com"]) == ["https://x.com/?a", "https://x.com"]
    assert values(spark, urls.ip_private, ["127.0.0.1", "8.8.8.8", "::1", "::ffff:10.0.0.1", "2606:4700::1111", "64:ff9b::7f00:1", "junk", None]) == [True, False, True, True, False, True, True, None]
    assert values(spark, urls.target_problem, ["https://x.com", "ftp://x.com", "http://u:p@x.com", "http://localhost/", "http://10.1.1.1/", None]) == [None, "only http and https", "credentials in URL", "private or local host", "private or local host", "missing URL"]
    assert values(spark, urls.video_handle, ["@User.Name", "https://www.tiktok.com/@abc?x=1", "a b"]) == ["user.name", "abc", None]


def test_intent(spark):
    cases = {
        "procuro carro até R$ 45.000": ("buyer", 45000.0), "procuro carro até 2015": ("buyer", None), "Vendo meu Gol e procuro um SUV até 90 mil": ("buyer", 90000.0), "Quanto custa?": ("price_question", None),
        "vendo sofá": ("seller", None), "bom dia": ("none", None), "procuro emprego": ("none", None), None: ("none", None),
    }
    got = values(spark, intent.score, list(cases))
    assert [(g.kind, g.budget) for g in got] == list(cases.values())
    car = values(spark, lambda c: intent.score(c, "car", ["Goiânia"]), ["procuro hilux em goiania", "procuro apartamento", "procuro pneus para o gol"])
    assert [(g.kind, g.score, g.region) for g in car] == [("buyer", 90, "goiania"), ("none", 0, None), ("none", 0, None)]
    with pytest.raises(ValueError):
        intent.score(F.lit("x"), "boats")
    posts = spark.createDataFrame([(1, "a", "oi", "u1", [("b", "quanto custa?", None)]), (2, "c", "procuro um carro", "u2", [])], "item_id int, author string, text string, url string, comments array<struct<author string, text string, url string>>")
    assert [(r.item_id, r.author, r.url) for r in intent.leads(posts).collect()] == [(2, "c", "u2"), (1, "b", "u1")]


def test_lint(spark):
    texts = ["No cenário atual, um método revolucionário.", "We cut no-shows by 32% in 30 dias.", "", "word " * 90, "It's not just about X, it's about Y."]
    got = values(spark, slop.lint, texts)
    assert [(g.banned, g.antitheses, g.score, g.is_slop) for g in got] == [(2, 0, 50, True), (0, 0, 0, False), (0, 0, 0, False), (0, 0, 20, True), (0, 1, 30, True)]
    assert values(spark, slop.sanitised, texts[:1]) == ["um método eficiente."]
    placed = values(spark, slop.violations("en"), ["Let us delve into a tapestry"])
    assert [(v.matched, v["index"], v.rule) for v in placed[0]] == [("delve into", 7, "Classic ChatGPT signature vocabulary"), ("tapestry", 20, "Overused florid AI metaphors")]


def test_cells_and_pages(spark):
    assert values(spark, pages.safe_cell, ["=1", " -x", "\tx", "ok", None, "   "]) == ["'=1", "' -x", "'\tx", "ok", "", "   "]
    assert values(spark, lambda c: pages.safe_cell(c, True), [-16.68], "double") == ["-16.68"]
    assert values(spark, pages.strict_cell, ["-16.68", "x"]) == ["'-16.68", "x"]
    assert values(spark, pages.csv_field, ['a,"b"', "c"]) == ['"a,""b"""', "c"]
    assert values(spark, pages.markdown_links, ["[a](b) x\n[1]: c"]) == [["b", "c"]]
    got = values(spark, lambda c: pages.blocked(F.lit(200), c), ["<title>Robot Check</title>", "about access denied pages", "Just a moment...", None])
    assert [g.is_blocked for g in got] == [True, False, True, False]
