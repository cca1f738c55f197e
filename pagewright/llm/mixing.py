"""Operator 3, mixing sources to target weights: Pfair windows and earliest deadline first.

A source's rows form blocks of BLOCK rows. With integer weights n_i of sum D, block j of source i may go out from slot
floor(j D / n_i) on and must by slot ceil((j + 1) D / n_i); one block goes out a slot, of those released the one with the
earliest deadline. All windows are met, so that at any slot each source has had its weight's share of slots to within one
block. The pattern repeats after D slots: the driver works out D slots at most for each phase and every row finds its
slot by arithmetic. When a source is used up a phase ends and the others go on with their own weights, so every row is
placed once and none is repeated.

All sources are scheduled in one level, however many there are. At the start of a phase every source's first block is
released, and those stand in the order of the weights, which never changes: a phase costs the slots that it takes, not the
sources that wait. So the driver's work and the plan grow with the blocks (rows / BLOCK) at most, and with few sources only
with their phases and periods.

Rows are numbered within a source by hash bucket: rows in earlier buckets, plus the place in the own one. No task holds a
whole source.

Defined results: a null source is a source of its own; null or repeated ids are placed like others (which of two equal
rows comes first is open); a source without a weight gets the default one; weights below 1 are refused; other columns
pass through, whatever their names; an empty table gives an empty table; texts of any length aren't looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd

from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from .common import ranked, shared

BLOCK = 32  #: rows that go out together
RESOLUTION = 1000  #: default weights are whole shares of about this sum
TEMPERATURE = 0.5  #: default weight: the source's row count to this power
BUCKETS = 4096  #: parts of a source that are numbered apart
FEW_BUCKETS = 250_000  #: counts of buckets that a join may broadcast, 10 MB; more are joined by shuffle
MOST_SOURCES = 500  #: default weights of more sources are finer, so that the shares of many are told apart as well
FAN = 32  #: of no effect: groups of sources are no longer made


def default_weights(counts: dict) -> dict:
    total = sum(n**TEMPERATURE for n in counts.values()) or 1
    resolution = RESOLUTION * max(1, len(counts) / MOST_SOURCES)  # as fine for many sources as for MOST_SOURCES
    return {s: max(1, round(resolution * n**TEMPERATURE / total)) for s, n in counts.items()}


def _order(weights: dict) -> list:
    return sorted(weights, key=lambda s: (-weights[s], s is None, str(s)))


def _slots(weights: list, going: list | range, total: int) -> Iterator[tuple[int, int]]:
    """(place of a source in weights, its block) slot by slot, of those going: earliest deadline first over Pfair windows.

    weights descend, going ascends, total is the sum of the weights of those going. All blocks 0 are released at once and
    their deadlines ascend with the places, so they wait in that order, not in a heap.
    """
    waiting: list = []  # by release
    ready: list = []
    fresh, t = 0, 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), k, j))
        if fresh < len(going) and (not ready or (-(-total // weights[going[fresh]]), going[fresh]) < ready[0][:2]):
            k, j = going[fresh], 0
            fresh += 1
        else:
            _, k, j = heapq.heappop(ready)
        yield k, j
        heapq.heappush(waiting, ((j + 1) * total // weights[k], k, j + 1))
        t += 1


def pattern(weights: dict, slots: int) -> list:
    """The source of each of the first `slots` slots."""
    order = _order(weights)
    return [order[k] for k, _ in islice(_slots([weights[s] for s in order], range(len(order)), sum(weights.values())), slots)]


def plan(blocks: dict, weights: dict) -> dict:
    """blocks: source -> number of blocks. Returns source -> its phases (first block, first slot, period, weight, slots in a period).

    A phase in which a source gets no slot isn't listed; of a phase that ends within its first period only its own slots are.
    """
    order = _order({s: weights[s] for s, n in blocks.items() if n > 0})
    own, left, done = [weights[s] for s in order], [blocks[s] for s in order], [0] * len(order)
    going, total, slot = list(range(len(order))), sum(own), 0
    out: dict = {s: [] for s in order}
    while going:
        places: dict = {}
        least, ended, period = 1, None, None
        for t, (k, j) in enumerate(_slots(own, going, total)):
            if t >= len(going):  # no period is shorter
                if period is None:
                    least = gcd(*(own[x] for x in going))
                    period = total // least
                if t == period:
                    break
            places.setdefault(k, []).append(t)
            if j + 1 == left[k]:
                ended, length = k, t + 1
                break
        if ended is None:  # periods follow until the first source ends
            last = {k: (left[k] - 1) // (own[k] // least) * period + x[(left[k] - 1) % (own[k] // least)] for k, x in places.items()}
            ended = min(last, key=last.get)
            length = last[ended] + 1
        for k, x in places.items():
            weight, every = own[k] // least, total // least
            out[order[k]].append((done[k], slot, every, weight, x))
            used = length // every * weight + bisect_left(x, length % every) if length > every else len(x)
            done[k] += used
            left[k] -= used
        total -= own[ended]
        del going[bisect_left(going, ended)]
        slot += length
    return out


def slot_of(phases: list, block: int) -> tuple[int, int, int]:
    """(slot, release, deadline) of a block of a source."""
    first, start, period, weight, places = phases[bisect_right(phases, block, key=lambda p: p[0]) - 1]
    k = block - first
    share = Fraction(weight, period)
    return start + k // weight * period + places[k % weight], start + int(k / share), start - int(-(k + 1) / share // 1)


def levels(blocks: dict, weights: dict) -> dict:
    """source -> its plan, as a path of one level for place_of."""
    return {s: [p] for s, p in plan(blocks, weights).items()}


def place_of(path: list, block: int) -> tuple[int, int, int]:
    """(slot, release, deadline) of a block of a source."""
    return slot_of(path[0], block)


def scheduled(documents: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """All columns, and mix_slot, mix_rank (the row's number in its source), mix_release and mix_deadline.

    A column of documents that bears one of these four names gives way; no other name clashes.
    """
    given = [c for c in documents.columns if c.lower() not in ("mix_slot", "mix_rank", "mix_release", "mix_deadline")]
    whole = F.struct(*[F.col(f"`{c}`") for c in given])
    hashed = F.xxhash64("doc_id", F.lit("mix"))
    keyed = documents.select(F.col("doc_id").alias("id"), "source", whole.alias("row"), hashed.alias("hash"), F.shiftrightunsigned(hashed, 64 - (BUCKETS.bit_length() - 1)).cast("int").alias("bucket"))
    per = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    counts = {r["source"]: r["n"] for r in per.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    own = default_weights(counts) | {s: w for s, w in (weights or {}).items() if s in counts}
    if any(w != int(w) or w < 1 for w in own.values()):
        raise ValueError("weights must be whole numbers from 1 on")
    plans = shared(documents.sparkSession, levels({s: -(-n // block) for s, n in counts.items()}, own))
    first = ranked(per, "source", "bucket", "n").select(F.col("source").alias("own_source"), F.col("bucket").alias("own_bucket"), "first")
    w = W.partitionBy("source", "bucket").orderBy("hash", "id")
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "release", "deadline")])

    @F.pandas_udf(kind)
    def place(source, number):
        import pandas as pd

        found = {}
        for s, b in {*zip(source, number)}:
            found[s, b] = place_of(plans.value[s], b)
        return pd.DataFrame([found[x] for x in zip(source, number)], columns=["slot", "release", "deadline"])

    at = F.col("source").eqNullSafe(F.col("own_source")) & (F.col("bucket") == F.col("own_bucket"))
    small = len(counts) * BUCKETS <= FEW_BUCKETS  # an upper bound of the rows of `first`
    numbered = keyed.withColumn("place", F.row_number().over(w)).join(F.broadcast(first) if small else first, at)
    numbered = numbered.select("row", "source", (F.col("first") + F.col("place") - 1).cast("long").alias("mix_rank"))
    slots = numbered.withColumn("at", place(F.col("source"), F.floor(F.col("mix_rank") / block).cast("long")))
    return slots.select("row.*", F.col("at.slot").alias("mix_slot"), "mix_rank", F.col("at.release").alias("mix_release"), F.col("at.deadline").alias("mix_deadline"))


def mixed(documents: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of documents in the order of the schedule: partitions follow one another, rows are sorted within."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])  # so that no name of theirs meets one of the schedule
    placed = scheduled(documents.select("doc_id", "source", whole.alias("mix_row")), weights, block)
    return placed.repartitionByRange(n, "mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select("mix_row.*")
