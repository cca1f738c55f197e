"""Components of near copies over several rounds of links."""

import random

from pagewright.llm import neardup


def test_later_rounds_go_without_links_inside_known_components(spark, monkeypatch):
    """pipeline: each round joined all earlier links again in every turn."""
    rng, edges = random.Random(5), []
    kept = neardup._small
    monkeypatch.setattr(neardup, "_small", lambda df, label, scratch, **sums: (lambda made: (edges.append((label, made[1]["n"])) if "edges" in label else None, made)[1])(kept(df, label, scratch, **sums)))
    state = object.__new__(neardup._Rounds)
    state.scratch, state.kept, state.parts, state.n_parts = [], [], None, 0
    if "links" in neardup._Rounds.__init__.__code__.co_names:
        state.links = None
    rounds = [[(i, i + 1) for i in range(0, 200) if i % 40 != 39], [(rng.randrange(40), rng.randrange(40)) for _ in range(300)] + [(300 + i, 301 + i) for i in range(20)], [(7, 90), (50, 310), (400, 401)], [(8, 91)]]
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for k, links in enumerate(rounds):
        links = [(min(p), max(p)) for p in links if p[0] != p[1]]
        state.add(spark.createDataFrame(links, "a long, b long"), str(k))
        for a, b in links:
            a, b = sorted((find(a), find(b)))
            top[b] = a
        assert {r["id"]: r["part"] for r in state.parts.collect()} == {x: find(x) for x in list(top)}
    assert state.n_parts == len(top)
    assert dict(edges)["neardup-edges-2"] == 6 and dict(edges)["neardup-edges-3"] == 0


def test_sets_do_not_leave_their_group(spark):
    """A set took a neighbour's label while its group went elsewhere, and the link between both had been left out by then."""
    for links in ([(0, 3), (3, 4), (2, 4), (1, 2)], [(9, 2), (9, 7), (7, 8), (8, 3), (3, 1), (1, 6), (4, 6), (4, 5), (5, 0)]):
        state = object.__new__(neardup._Rounds)
        state.scratch, state.kept, state.parts, state.n_parts = [], [], None, 0
        state.add(spark.createDataFrame(links, "a long, b long"), "chain")
        assert {r["id"]: r["part"] for r in state.parts.collect()} == {x: 0 for p in links for x in p}
