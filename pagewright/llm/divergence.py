"""Operator 12, source divergence: how each source of a language uses its terms, against the other sources and the language.

Sort-based streaming. Each task counts the terms of blocks of documents as they come, by language and source; what leaves it
is a run of documents for a term: (lang, term, source, document, documents with the term, occurrences). Those rows are
repartitioned by language and term and sorted by (lang, term, source, document), behind a hash of the first two; one pass measures runs, which gives the
document frequency in the language and the occurrences in each source, and only terms in LEAST documents go on. A second
sorted pass over the kept terms emits, for each run, a part of the divergence of every two sources that both have the term, and
the term's own contributions. What a source contributes with terms that the other one lacks depends on the other's totals
alone, so it comes from a histogram of its counts: no row is made for a term that a source doesn't have.

All arithmetic is in 64-bit integers: the probabilities of a group add up to 10**9 and its number of terms, so no sum of
p * p / q exceeds 10**18.

Rows of a hot term are as many as sources and blocks, never documents. A run whose pairs of sources are more than PAIRS is
dealt out over tasks by rows of its matrix.

Defined results: null text, lang and source count as ''. A document is a row, also where rows repeat. Groups without terms
have a row for each other source of their language; a language with one source has no pairs. An empty table gives no rows.
Texts are read whole, however long; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import dropped, freed, measured, written
from .neardup import few

LEAST = 3  #: documents of a language that a term must be in
TOP = 200  #: terms reported of a group
SCALE = 1_000_000_000
HELD = 500_000  #: terms that a task counts before it hands them on
MOST_DOCUMENTS, COUNT_BITS = 1 << 22, 40  #: of a block; bits of occurrences beside the documents of a block
PAIRS = 1 << 20  #: of sources, that one run works out in one task

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters A to Z, in lower case, and of whatever isn't ASCII."""
    return text.translate(_FOLD).split()


def runs(documents: DataFrame) -> DataFrame:
    """key (of lang and term), source, document (the block's first), counts: what each block of documents has of each term.

    A row is as narrow as can be, as there are many: counts holds the documents with the term above COUNT_BITS of occurrences.
    """
    shape = "key binary, source binary, document long, counts long"
    binary = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)

    def count(batches):
        held: dict = {}
        size, documents, block = 0, 0, None

        def rows():
            for (lang, source), (n, df) in held.items():
                k, start = len(n), lang + b"\0"
                if k:
                    counts = np.fromiter(map(df.__getitem__, n), dtype=np.int64, count=k) << COUNT_BITS | np.fromiter(n.values(), dtype=np.int64, count=k)
                    yield pa.RecordBatch.from_arrays([pa.array([start + t for t in n], pa.binary()), pa.array([source] * k, pa.binary()), pa.array(np.full(k, block)), pa.array(counts)], names=["key", "source", "document", "counts"])

        for batch in batches:
            texts = batch.column("text")
            for i, (lang, source, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "at")))):
                block = at if block is None else block
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms_of(texts[i].as_py()), len(n)
                n.update(words)
                df.update(set(words))
                size, documents = size + len(n) - before, documents + 1
                if size >= HELD or documents >= MOST_DOCUMENTS:
                    yield from rows()
                    held, size, documents, block = {}, 0, 0, None
        yield from rows()
        held.clear()
        freed()

    return documents.select(binary("text"), binary("lang"), binary("source"), F.monotonically_increasing_id().alias("at")).mapInArrow(count, shape)


def _edges(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where a run of rows that are equal in the columns begins."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, n - 1)).to_numpy()
    return np.flatnonzero(new)


def _whole_runs(batches, key: tuple[str, ...], read=None, shorten=None):
    """Tables that end where a run of equal keys ends. read: of a batch; shorten: makes less of a part that isn't ended."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = read(part) if read else part
        part = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        last = int(_edges(part, key)[-1])
        if last:
            yield part.slice(0, last)
        held = part.slice(last)
        held = shorten(held) if shorten else held
    if held is not None:
        yield held


def _read(part: pa.Table) -> pa.Table:
    counts = part.column("counts").to_numpy()
    return pa.table({"key": part.column("key"), "source": part.column("source"), "df": counts >> COUNT_BITS, "n": counts & ((1 << COUNT_BITS) - 1)})


def _summed(part: pa.Table) -> pa.Table:
    """One row for each (key, source)."""
    at = _edges(part, ("key", "source"))
    take = pa.array(at)
    return pa.table({"key": part.column("key").take(take), "source": part.column("source").take(take)} | {c: np.add.reduceat(part.column(c).to_numpy(), at) for c in ("df", "n")})


def kept_terms(partial: DataFrame) -> DataFrame:
    """lang, term, source, n, total (of the language), head (1 in a term's first row), of terms in LEAST documents."""
    shape = "lang binary, term binary, source binary, n long, total long, head int"
    # the hash in front keeps terms together as well, and lets most comparisons be of one number
    ordered = partial.repartition("key").sortWithinPartitions(F.xxhash64("key"), "key", "source", "document")

    def scan(batches):
        for part in _whole_runs(batches, ("key",), _read, _summed):
            part = _summed(part)
            at = _edges(part, ("key",))
            long = np.diff(np.append(at, part.num_rows))
            n = part.column("n").to_numpy()
            real = np.add.reduceat(part.column("df").to_numpy(), at) >= LEAST
            if not real.any():
                continue
            total, at, long = np.add.reduceat(n, at)[real], at[real], long[real]
            run = np.repeat(np.arange(len(at)), long)
            rows = at[run] + np.arange(len(run)) - np.repeat(np.cumsum(long) - long, long)
            lang, _, term = zip(*(k.rpartition(b"\0") for k in part.column("key").take(pa.array(at)).to_pylist()))
            head = np.zeros(len(run), dtype=np.int32)
            head[np.cumsum(long) - long] = 1
            one = pa.array(run)
            whole = pa.table({"lang": pa.array(lang, pa.binary()).take(one), "term": pa.array(term, pa.binary()).take(one), "source": part.column("source").take(pa.array(rows)), "n": n[rows], "total": total[run], "head": head})
            yield from whole.combine_chunks().to_batches()

    return ordered.mapInArrow(scan, shape)


def _f(p, q):
    return (p - q) * (p - q) // q


def emitted(kept: DataFrame) -> DataFrame:
    """kept with p, p0 (the source's for a term that it lacks), q (the language's) and tiles -> parts of pairs, and terms.

    A pair's part is what the term adds to f beyond the three values that are known without it: f(p, q0) + f(p0, q) - f(p0, q0).
    """
    shape = "part string, lang binary, source binary, item binary, value long"
    dealt = kept.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile"))
    ordered = dealt.select("lang", "term", "source", "tile", "own", "p", "p0", "q").repartition("lang", "term", "tile").sortWithinPartitions(F.xxhash64("lang", "term", "tile"), "lang", "term", "tile", "source")

    def batch(part, lang, source, item, value):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(value), pa.string()), lang, source, item, pa.array(value, pa.int64())], names=["part", "lang", "source", "item", "value"])

    def scan(batches):
        for part in _whole_runs(batches, ("lang", "term", "tile")):
            part = part.combine_chunks()
            p, p0, q = (part.column(c).to_numpy() for c in ("p", "p0", "q"))
            own = part.column("own").to_numpy()
            lang, source, term = (part.column(c).combine_chunks() for c in ("lang", "source", "term"))
            more = np.flatnonzero(own & (p > q))
            take = pa.array(more)
            yield batch("term", lang.take(take), source.take(take), term.take(take), _f(p[more], q[more]))
            at = _edges(part, ("lang", "term", "tile"))
            long = np.diff(np.append(at, part.num_rows))
            of = pa.table({"lang": lang, "source": source})
            known = of.group_by(["lang", "source"]).aggregate([])
            code = {(a, b): i for i, (a, b) in enumerate(zip(known.column("lang").to_pylist(), known.column("source").to_pylist()))}
            group = np.fromiter(map(code.__getitem__, zip(lang.to_pylist(), source.to_pylist())), dtype=np.int64, count=part.num_rows)
            mine = np.add.reduceat(own.astype(np.int64), at)
            ends, sums = np.cumsum(mine * long), []
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2 * PAIRS, "right")))
                rows = np.arange(at[lo], at[hi - 1] + long[hi - 1])
                run = np.repeat(np.arange(lo, hi), long[lo:hi])
                left, run = rows[own[rows]], run[own[rows]]
                n = long[run]
                x = np.repeat(left, n)
                y = np.repeat(at[run] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                x, y = x[x != y], y[x != y]
                value = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
                pair = group[x] * len(code) + group[y]
                order = np.argsort(pair, kind="stable")
                pair, value = pair[order], value[order]
                if len(pair):
                    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                    sums.append((pair[first], np.add.reduceat(value, first)))
                lo = hi
            if sums:
                pair, value = (np.concatenate(x) for x in zip(*sums))
                order = np.argsort(pair, kind="stable")
                pair, value = pair[order], value[order]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                x, y = pa.array(pair[first] // len(code)), pa.array(pair[first] % len(code))
                names = known.column("source").combine_chunks()
                yield batch("pair", known.column("lang").combine_chunks().take(x), names.take(x), names.take(y), np.add.reduceat(value, first))

    return ordered.mapInArrow(scan, shape)


def _ratio(p: str, q: str):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def audit(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scratch: list = []
    kept = written(kept_terms(runs(documents)), "divergence-kept", scratch)
    present = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("all"))
    groups = present.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "v", "all"])
    many = present.groupBy("lang").agg(F.ceil(F.count("*") * F.count("*") / PAIRS).cast("int").alias("tiles"))
    groups = groups.join(many, "lang").withColumn("p0", F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div (size + v)")).otherwise(1))
    groups, seen = measured(groups, "divergence-groups", scratch)
    n = seen.get("n", 0)
    # a term's probabilities need its group's totals; where groups are many, rows and groups meet by shuffle
    rows = kept.join(few(groups, n), ["lang", "source"]).withColumn("p", F.expr(f"1 + {SCALE} * (n + 1) div (size + v)")).withColumn("q", F.expr(f"1 + {SCALE} * (total + 1) div (all + v)"))
    parts = written(emitted(rows), "divergence-parts", scratch)

    other = few(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), n)
    base = groups.select("lang", "source", "v", "p0").join(other, "lang").where("source <> item").withColumn("value", F.col("v") * _ratio("p0", "q0"))
    counts = rows.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k"))
    met = counts.join(other, "lang").where("source <> item")
    mine = met.withColumn("value", F.col("k") * (_ratio("p", "q0") - _ratio("p0", "q0")))
    theirs = met.withColumn("value", F.col("k") * (_ratio("q0", "p") - _ratio("q0", "p0"))).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    columns = ["lang", "source", "item", "value"]
    pairs = base.select(columns).union(mine.select(columns)).union(theirs).union(parts.where("part = 'pair'").select(columns))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    # binary order is that of UTF-8
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", place)
    terms = parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= TOP)
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    out = written(pairs.select(*text, "part", "item", "value", "rank").union(terms.select(*text, "part", "item", "value", "rank")), "divergence-audit")
    dropped(spark, scratch)
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), n AS (
  SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
