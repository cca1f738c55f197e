"""Operator 7, near-duplicates: an LSH forest over MinHash signatures finds candidates, full shingle sets confirm them.

Each of TREES trees puts the distinct shingle sets in the sorted order of their signatures, which every tree reads from
another place on: its first BASE values as one number, the next DEEPER values a byte each. One range-partitioned sort holds
all trees; a pass over it gives each set its neighbours in every order and the length of the prefix that they share. Sets
that share BASE values of a tree or more form a region, a stretch of that order.

Depth adapts to each region. (0) Each set meets the neighbour with which it shares the longest prefix in any tree. (1) All
other neighbours with a common prefix of BASE or more meet. (2) Where a region then still holds several components, all of it
is compared at depth BASE: its sets outside of its largest component, each with every set of the region that isn't in its
own component. (3) The same for crowded regions, those of more than CROWD sets with more than OTHERS of them outside of the
largest component. There no row is made for a pair: both sides are dealt into blocks of about SIDE sets, each two blocks
meet in a task, which counts all common shingles at once and gives only links that join two components. Every pair of a
region is thus compared or in one component; a pair that meets in several crowded regions is compared in the first tree's.
Pairs within a component are never compared, so copies cost rows in proportion to their number; sets that share a region
but no component cost time with the square of their number. After each round the confirmed links are joined to components.

At a similarity of 0.75 a pair misses all regions with chance (1 - 0.75**BASE)**TREES, below 2e-5.

Defined results: null or wordless text has an empty set, is its own component and kept. Fewer words than WORDS: the whole
sequence is one shingle. Equal sets are one class from the start. Rows of one doc_id are one document: the classes of its
texts are linked. A null id has a null component and is kept. A text of any length is one row and never cut. Other columns
pass by unread; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, dropped, hold, map_arrow, measured, written

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100  #: linked from intersection / union >= 0.75 on
TREES, BASE, DEEPER = 20, 3, 8
CROWD, OTHERS = 48, 24  #: sets of a region, or of those outside of its largest component, up to which what is left becomes rows of pairs; beyond, blocks
SIDE = 256  #: sets of a block's side, about
FEW = 1_000_000  #: ids that a join may broadcast, 16 MB; more are joined by shuffle
FEW_BYTES = 20_000_000  #: sets that a join may broadcast
SHARE = 256  #: pairs of one set that meet in a task
ROWS_A_TASK, PAIRS_A_TASK = 200_000, 2_000
MEMO_BYTES = 30_000_000  #: of hashed words that a worker keeps

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, size=TREES * BASE, dtype=np.uint32) << 1 | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, size=TREES * BASE, dtype=np.uint64).astype(np.uint32)
_C = (_rng.integers(0, 1 << 62, size=WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _word_hash() -> Memo:
    """Hashes of words, in the worker's memory."""
    return hold("neardup", lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w) >> 1, MEMO_BYTES))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; bytes.split knows just the six white-space characters."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash().__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        if len(h) < WORDS:
            total = np.array([len(h)], dtype=np.uint64)
            for i, c in zip(range(len(h)), _C):
                total += _mix(h[i] * c)
            return _mix(total)
        total = h[: len(h) - WORDS + 1] * _C[0]
        for i in range(1, WORDS):
            total = _mix(total) + h[i : len(h) - WORDS + 1 + i] * _C[i]
        return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set, TREES x BASE."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * BASE, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        np.minimum(best, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return best.reshape(TREES, BASE)


def region_keys(sig: np.ndarray) -> np.ndarray:
    """For each tree: a hash of the tree's number and values."""
    key = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for j in range(BASE):
            key = _mix(key ^ _mix(sig[:, j].astype(np.uint64) + np.uint64(j + 1)))
    return key.astype(np.int64)


_AFTER = (np.arange(TREES)[:, None] * BASE + BASE + np.arange(DEEPER)) % (TREES * BASE)


def deeper_keys(sig: np.ndarray) -> np.ndarray:
    """For each tree: the low bytes of the DEEPER values that follow its own, the first one highest."""
    return (sig.reshape(-1) & 0xFF).astype(np.uint8)[_AFTER].view(">u8").ravel().astype(np.uint64).view(np.int64)


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of sets of one region."""
    apart = (a ^ b).view(np.uint64)
    return BASE + sum(((apart >> np.uint64(64 - 8 * k)) == 0).astype(np.int32) for k in range(1, DEEPER + 1))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray, least: int = NUMERATOR) -> bool:
    """least: percent of the union that the intersection must have."""
    if DENOMINATOR * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = intersection(a, b)
    return both > 0 and DENOMINATOR * both >= least * (len(a) + len(b) - both)


def crossing(region: int, ids, parts, left, top, sets: list, keys) -> list[tuple[int, int]]:
    """Links between the sets of a block's left side and those of its right that join two components.

    All arguments but region have an entry a set; left: whether it is of that side; top: whether it is in the region's
    largest component. Of two sets outside of that, which meet on both sides, the smaller id is taken on the left; pairs
    that share an earlier tree's region are left to it.
    """
    rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(rows) or not len(cols):
        return []
    _, part = np.unique(parts, return_inverse=True)
    size = np.array([len(sets[j]) for j in cols])
    flat = np.concatenate([sets[j] for j in cols])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(cols)), size)[order]
    tree = int(np.flatnonzero(keys[rows[0]] == region)[0])
    before, out = keys[cols, :tree], []
    for i in rows:
        free = (part[cols] != part[i]) & (top[cols] | (ids[cols] > ids[i])) & ~(before == keys[i, :tree]).any(axis=1)
        if not free.any():
            continue
        first = np.searchsorted(flat, sets[i], "left")
        n = np.searchsorted(flat, sets[i], "right") - first
        both = np.bincount(owner[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(cols))
        for j in cols[free & (both > 0) & (DENOMINATOR * both >= NUMERATOR * (len(sets[i]) + size - both))]:
            if part[j] != part[i]:
                out.append((int(ids[i]), int(ids[j])))
                part[part == part[j]] = part[i]
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp (of the whole set), and by tree heads and deeps; empty sets have null fp."""

    def run(c):
        out: dict = {"n_shingles": [], "fp": [], "heads": [], "deeps": []}
        for text in c["text"]:
            s = shingles(text)
            sig = signature(s) if len(s) else None
            out["n_shingles"].append(len(s))
            out["fp"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["heads"].append(region_keys(sig) if len(s) else None)
            out["deeps"].append(deeper_keys(sig) if len(s) else None)
        return out

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, run, "doc_id long, text_hash long, n_shingles long, fp binary, heads array<long>, deeps array<long>", ["doc_id", "text_hash"])


def neighbours(trees: DataFrame) -> DataFrame:
    """(head, deep, id) of every set in every tree -> head, id, and the set before in the order with the depth that both share.

    Only rows of regions with several sets stay, and the first and last row of each partition: what stands beyond those
    isn't seen there, so they wait for round 2, when their region is compared whole.
    """
    import pyarrow as pa

    ordered = trees.repartitionByRange("head", "deep", "id").sortWithinPartitions("head", "deep", "id")

    def rows(head, ids, prev, depth, real, keep):
        own = [pa.array(head[keep]), pa.array(ids[keep]), pa.array(prev[keep], mask=~real[keep]), pa.array(depth[keep].astype(np.int32), mask=~real[keep])]
        return pa.RecordBatch.from_arrays(own, names=["head", "id", "prev", "depth"])

    def scan(batches):
        held = None  # the last row so far, whose next one isn't known: head, deep, id, prev, depth, real, met
        for batch in batches:
            if not batch.num_rows:
                continue
            head, deep, ids = (batch.column(n).to_numpy() for n in ("head", "deep", "id"))
            if held is not None:
                head, deep, ids = (np.append(x, y) for x, y in zip(held, (head, deep, ids)))
            prev, depth, real, met = held[3:] if held is not None else (0, 0, False, True)
            same = head[1:] == head[:-1]
            prev, real, met = np.append(prev, ids[:-1]), np.append(real, same), np.append(met, same)
            depth = np.append(depth, shared_depth(deep[1:], deep[:-1]))
            yield rows(head, ids, prev, depth, real, np.append(met[:-1] | same, False))
            held = [x[-1] for x in (head, deep, ids, prev, depth, real, met)]
        if held is not None:
            yield rows(*(np.array([held[i]]) for i in (0, 2, 3, 4, 5)), np.array([True]))

    return ordered.mapInArrow(scan, "head long, id long, prev long, depth int")


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Marks a narrow table for a broadcast if its rows are few enough (n of them); else the join shuffles."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= FEW else rows


def _small(df: DataFrame, label: str, scratch: list, **sums) -> tuple[DataFrame, dict]:
    """Writes a narrow table and reads it in as few tasks as its rows need, so that rounds over few links don't run many empty ones."""
    made, seen = measured(df, label, scratch, **sums)
    n = seen.get("n", 0)
    return made.coalesce(max(1, n // ROWS_A_TASK)) if n <= FEW else made, {"n": 0} | seen


class _Rounds:
    """State of one run: the sets that may be compared and the component of each set that has a link."""

    LEAST = NUMERATOR  #: percent
    SHINGLES = staticmethod(shingles)

    def __init__(self, documents: DataFrame, classes: DataFrame, rows: DataFrame, scratch: list):
        self.scratch, self.kept = scratch, []  # folders that may go at the end, and the labels' last ones
        self.parts: DataFrame | None = None
        self.n_parts = 0
        self.tested: DataFrame | None = None
        self.n_tested = 0
        met = classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("low").alias("doc_id"), "text_hash")
        ids, seen = _small(met, "neardup-ids", scratch)

        shingles_of = self.SHINGLES

        def sets(c):
            return {"items": [shingles_of(t).tobytes() for t in c["text"]]}

        texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(few(ids, seen["n"]), ["doc_id", "text_hash"])
        made = map_arrow(texts.select("id", "text"), sets, "id long, items binary", ["id"])
        n, (self.full, seen) = seen["n"], measured(made, "neardup-sets", scratch, size=F.sum(F.length("items")))
        if seen.get("n", 0) > n:  # rows that repeat
            self.full = written(self.full.dropDuplicates(["id"]), "neardup-sets", scratch)
        self.fits = seen.get("size", 0) <= FEW_BYTES  # then the sets go to every task, else pairs and sets meet by shuffle

    def attached(self, left: DataFrame, side: str) -> DataFrame:
        """Adds the set of one side. A set in many pairs is dealt out in shares, so that none meets all of them in one task."""
        own = self.full.select(F.col("id").alias(side), F.col("items").alias(f"items_{side}"))
        if self.fits:
            return left.join(F.broadcast(own), side)
        shares = left.groupBy(side).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
        copies = own.join(shares, side).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        other = "a" if side == "b" else "b"
        dealt = left.join(few(shares.where("shares > 1")), side, "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("shares")).cast("int"))).drop("shares")
        return dealt.join(copies, [side, "share"]).drop("share")

    def test(self, pairs: DataFrame, label: str) -> None:
        """Confirms pairs (a, b) on full sets."""
        pairs, seen = measured(pairs, f"neardup-pairs-{label}", self.scratch)
        n = seen.get("n", 0)
        if not n:
            return
        dealt = pairs.repartition(max(1, min(n // PAIRS_A_TASK, 10_000))) if self.fits else pairs
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.n_tested += n
        least = self.LEAST

        def check(c):
            good = [(a, b) for a, b, x, y in zip(c["a"], c["b"], c["items_a"], c["items_b"]) if linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), least)]
            return {"a": [a for a, _ in good], "b": [b for _, b in good]}

        self.add(map_arrow(self.attached(self.attached(dealt, "b"), "a"), check, "a long, b long"), label)

    def add(self, links: DataFrame, label: str) -> None:
        """Takes confirmed links in and joins components anew."""
        found, seen = measured(links, f"neardup-links-{label}", self.scratch)
        if seen.get("n", 0):
            self.join_up(found, label)

    def join_ids(self, real: DataFrame, classes: DataFrame) -> None:
        """Links the classes of the texts that bear one doc_id."""
        several, seen = _small(real.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id"), "neardup-several", self.scratch)
        if seen["n"]:
            own = real.select("doc_id", "fp").join(few(several, seen["n"]), "doc_id").distinct().join(classes.select("fp", "id"), "fp").select("doc_id", "id")
            least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
            self.add(own.join(few(least, seen["n"]), "doc_id").where("a <> id").select("a", F.col("id").alias("b")), "ids")

    def regions_of(self, members: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
        """(region, id, part of members (region, id); region, n, most, top, others of the regions with several components; their number)."""
        members = written(self.part_of(members, "id", "part"), f"neardup-members-{label}", self.scratch)
        parts = members.groupBy("region", "part").agg(F.count("*").alias("c"))
        regions = parts.groupBy("region").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("part", F.struct("c", -F.col("part"))).alias("top"))
        made, seen = _small(regions.withColumn("others", F.col("n") - F.col("most")).where("others > 0"), f"neardup-left-{label}", self.scratch)
        return members, made, seen["n"]

    def test_crowds(self, members: DataFrame, classes: DataFrame, label: str) -> None:
        """Confirms all pairs of each region that aren't in one component, block by block."""
        members, regions, n = self.regions_of(members, label)
        if not n:
            return
        blocks = regions.select("region", "top", F.ceil(F.col("others") / SIDE).cast("int").alias("down"), F.ceil(F.col("n") / SIDE).cast("int").alias("across"))
        dealt = members.join(few(blocks, n), "region").withColumn("top", F.col("part") == F.col("top"))
        place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = dealt.where("not top").withColumn("lb", place(1, "down")).withColumn("rb", every("across")).withColumn("left", F.lit(True))
        right = dealt.withColumn("rb", place(2, "across")).withColumn("lb", every("down")).withColumn("left", F.lit(False))
        ids, seen = _small(dealt.select("id").distinct(), f"neardup-crowd-ids-{label}", self.scratch)
        sets, held = measured(self.full.join(few(ids, seen["n"]), "id").join(classes.select("id", F.col("heads").alias("keys")).join(few(ids, seen["n"]), "id"), "id"), f"neardup-crowd-sets-{label}", self.scratch)
        full = left.unionByName(right).drop("down", "across").join(F.broadcast(sets) if self.fits and held.get("n", 0) <= FEW // 20 else sets, "id")

        def check(pdf):
            import pandas as pd

            sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["items"]]
            got = crossing(pdf["region"].iloc[0], *(pdf[c].to_numpy() for c in ("id", "part", "left", "top")), sets, np.stack(pdf["keys"].to_numpy()))
            return pd.DataFrame(got, columns=["a", "b"], dtype=np.int64)

        self.add(full.groupBy("region", "lb", "rb").applyInPandas(check, "a long, b long"), label)

    def join_up(self, found: DataFrame, label: str) -> None:
        """Components over all links so far: those of the new links over the components that are known, whose own links say no more.

        In turns until none changes a label each set takes its label's own label, and a set that is its own label the least of
        those of the neighbours of the sets that it labels, so that whole groups move: turns grow with the logarithm of a chain's
        length. No other set leaves its label for a neighbour's: it would part from its group, as links whose ends have had one
        label are left out of later turns.
        """
        between = self.part_of(self.part_of(found, "a", "pa"), "b", "pb").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        both = between.union(between.select("b", "a"))
        edges, seen = _small(both.toDF("id", "other").distinct(), f"neardup-edges-{label}", self.scratch)
        if not seen["n"]:
            return
        made: list = []
        parts, seen = _small(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("part")), f"neardup-parts-{label}-0", made)
        n = seen["n"]
        for turn in count(1):
            ends = parts.select(F.col("id").alias("other"), F.col("part").alias("there"))
            edges, _ = _small(edges.join(few(parts, n), "id").join(few(ends, n), "other").where("part <> there").select("id", "other"), f"neardup-edges-{label}-{turn}", self.scratch)
            tops = parts.join(few(parts.select(F.col("id").alias("part"), F.col("part").alias("top")), n), "part")  # a label is a set with links, too
            tops = tops.select("id", "part", "top")
            if n > FEW:  # else it costs less to work it out three times
                tops = written(tops, f"neardup-tops-{label}-{turn}", self.scratch)
            beside = edges.join(few(tops.select(F.col("id").alias("other"), "top"), n), "other").groupBy("id").agg(F.min("top").alias("near"))
            low = tops.join(few(beside, n), "id", "left").select("id", "part", "top", "near")
            if n > FEW:
                low = written(low, f"neardup-low-{label}-{turn}", self.scratch)
            hooks = low.groupBy(F.col("part").alias("id")).agg(F.min("near").alias("hook"))
            nxt = low.join(few(hooks, n), "id", "left").select("id", F.when(F.col("part") == F.col("id"), F.least("top", "hook")).otherwise(F.col("top")).alias("part"), F.col("part").alias("was"))
            nxt, seen = _small(nxt, f"neardup-parts-{label}-{turn}", made, moved=F.count_if(F.col("part") != F.col("was")))
            parts = nxt.select("id", "part")
            dropped(edges.sparkSession, made[:-1])
            made = made[-1:]
            if not seen["moved"]:
                break
        if self.parts is not None:  # each set of a component that was known goes where its label went
            whole = self.parts.join(few(parts.select(F.col("id").alias("part"), F.col("part").alias("now")), n), "part", "left").select("id", F.coalesce("now", "part").alias("part"))
            whole = whole.unionByName(parts.join(few(self.parts.select("id"), self.n_parts), "id", "left_anti"))
            parts, seen = _small(whole, f"neardup-parts-{label}", made)
            n = seen["n"]
            dropped(edges.sparkSession, self.kept + made[:-1])
            made = made[-1:]
        self.parts, self.n_parts, self.kept = parts, n, made

    def part_of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """Adds the component of an id; a set without links is its own."""
        if self.parts is None:
            return rows.withColumn(name, F.col(column))
        known = self.parts.select(F.col("id").alias(column), F.col("part").alias("_part"))
        return rows.join(few(known, self.n_parts), column, "left").withColumn(name, F.coalesce("_part", column)).drop("_part")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that aren't in one component and weren't tested."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
        if self.parts is not None:
            pairs = self.part_of(self.part_of(pairs, "a", "pa"), "b", "pb").where("pa <> pb").select("a", "b")
        pairs = pairs.distinct()
        return pairs if self.tested is None else pairs.join(few(self.tested, self.n_tested), ["a", "b"], "left_anti")


def grouped(spark: SparkSession, documents: DataFrame, by_id: bool, scratch: list) -> tuple[DataFrame, DataFrame]:
    """(what signatures() gives of every row but the trees; fp, low and component of each class of equal sets).

    low: the least doc_id of the class; component: the id of one class of each group. by_id: texts of one doc_id are linked.
    """
    sigs = written(signatures(documents), "neardup-signatures", scratch)
    real = sigs.where("fp is not null and doc_id is not null")
    made = real.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"), F.first("heads").alias("heads"), F.first("deeps").alias("deeps"))
    made = made.select("fp", F.col("low.doc_id").alias("low"), F.col("low.text_hash").alias("text_hash"), "heads", "deeps")
    classes = written(made.withColumn("id", F.monotonically_increasing_id()), "neardup-classes", scratch)
    trees = classes.select("id", F.explode(F.arrays_zip("heads", "deeps")).alias("t")).select(F.col("t.heads").alias("head"), F.col("t.deeps").alias("deep"), "id")
    rows = written(neighbours(trees), "neardup-regions", scratch)
    state = _Rounds(documents, classes, rows, scratch)
    if by_id:
        state.join_ids(real, classes)
    met = rows.where("prev is not null")
    either = met.select("id", F.col("prev").alias("other"), "depth").union(met.select("prev", "id", "depth"))
    state.test(state.apart(either.groupBy(F.col("id").alias("b")).agg(F.max_by("other", F.struct("depth", -F.col("other"))).alias("a"))), "0")
    state.test(state.apart(met.select(F.col("id").alias("a"), F.col("prev").alias("b"))), "1")
    # What pairs of a region are left: those of its sets outside of its largest component with any of its sets.
    members, regions, n = state.regions_of(rows.select(F.col("head").alias("region"), "id"), "2")
    settle = (F.col("others") <= OTHERS) | (F.col("n") <= CROWD)
    settled = regions.where(settle).select("region", "top")
    others = members.join(few(settled, n), "region").where("part <> top").groupBy("region").agg(F.collect_list(F.struct("id", "part")).alias("m"))
    found = members.join(F.broadcast(others) if n <= FEW // CROWD else others, "region").select(F.col("id").alias("a"), F.explode(F.expr("filter(m, y -> y.part <> part)")).alias("y")).select("a", F.col("y.id").alias("b"))
    state.test(state.apart(found), "2")
    crowded = few(regions.where(~settle).select("region"), n)
    state.test_crowds(members.join(crowded, "region", "left_semi").select("region", "id"), classes, "3")
    scratch += state.kept
    return sigs.drop("heads", "deeps"), state.part_of(classes.select("fp", "low", "id"), "id", "component").drop("id")


def components(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of documents."""
    scratch: list = []
    sigs, classes = grouped(spark, documents, True, scratch)
    found = by_document(sigs, classes, "neardup", scratch)
    dropped(spark, scratch)
    return found


def by_document(sigs: DataFrame, classes: DataFrame, label: str, scratch: list) -> DataFrame:
    """What grouped() gives -> doc_id, n_shingles, component_id, kept."""
    # Most classes are a component of their own; the others' components are few rows, so that a large one needn't meet in one task.
    least, seen = _small(classes.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{label}-least", scratch)
    whole = classes.join(few(least, seen["n"]), "component", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    whole = written(whole, f"{label}-groups", scratch)
    # Copies of one text may be a third of all rows: their class is one row here, so the join's other side may be split.
    out = sigs.select("doc_id", "n_shingles", "fp").join(whole, "fp", "left")
    at = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return written(out.select("doc_id", "n_shingles", at.alias("component_id"), F.coalesce(F.col("doc_id") == at, F.lit(True)).alias("kept")), f"{label}-components")


def dropped_copies(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents without near copies: of each group the row of least doc_id stays, of several texts of it that of the least hash.

    Groups are of texts, so no text goes because another one bears the same id. Of rows equal in id and text one stays.
    Null ids, null texts and texts without words stay.
    """
    scratch: list = []
    sigs, classes = grouped(spark, documents, False, scratch)
    rows = sigs.where("fp is not null and doc_id is not null").groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    rows = rows.join(classes.select("fp", "component"), "fp")
    rows = written(rows, "neardup-rows", scratch)
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"), F.sum("rows").alias("n")).where("n > 1").drop("n")
    best, groups = _small(best, "neardup-best", scratch)
    rows = rows.join(few(best, groups["n"]), "component").withColumn("kept", F.struct("doc_id", "text_hash") == F.col("best"))
    odd, seen = measured(rows.where("not kept or rows > 1").select("doc_id", "text_hash", "kept"), "neardup-gone", None, again=F.count_if("kept"))
    dropped(spark, scratch)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), whole.alias("row"))
    out = keyed.join(few(odd, seen.get("n", 0)), ["doc_id", "text_hash"], "left_anti").select("row.*")
    if seen.get("again", 0):
        once = keyed.join(few(odd.where("kept"), seen["again"]), ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
        out = out.unionByName(once.select("row.*"))
    return out


#: DuckDB: all pairs that share a shingle, and what can be reached over links.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x
), lowest AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
