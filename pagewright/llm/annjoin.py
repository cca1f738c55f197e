"""Operator 8, nearest neighbours: a block matrix join over int8 tiles with proven error bounds.

Queries and candidates are dealt into blocks of fixed size; each pair of blocks is a tile. Unit vectors are rounded to
int8 with a scale and the length of the rounding error, so that a product of int8 vectors gives a cosine to within
|x - x'| + |y - y'| + |x - x'||y - y'|. A candidate whose upper bound lies below the lower bound of K others of its query
cannot be among its K nearest; all others are computed again on the original numbers in double precision. Each tile keeps
a heap of K per query, and the heaps of a query's tiles are merged. The result is exact.

Defined results: vectors that are null or zero, or hold a null or a number that isn't finite, take no part, nor does a
null id. Only vectors of one length are compared. Rows with a query's own id are not its candidates. Equal rows (id and
vector) count once. Ties go to the smaller id. Other columns pass by unread; with no candidates a query has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

K = 5
STRIDE = 50
QUERY_BLOCK, ROW_BLOCK = 4096, 16384  #: vectors of a tile's sides
MERGED = 500  #: queries whose heaps are merged together
STEP = 256  #: queries of a tile that are worked on at once


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the rows that take part, equal rows once."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", vector.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(~bad & nonzero).dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of the rounding error) of unit rows; the error is rounded up."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    gap = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, gap * (1 + 1e-9) + 1e-12


def _level(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision; a row's value doesn't depend on the rows beside it."""
    a, b = _level(a), _level(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _units(x: np.ndarray) -> np.ndarray:
    x = _level(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile(query_ids, queries, row_ids, rows, k: int = K):
    """(query id, row id, cosine) of the k best row ids of a tile for each query row, by int8 bounds and then in full.

    An id may have several rows; the best stands for it.
    """
    row_ids, query_ids = np.asarray(row_ids), np.asarray(query_ids)
    by_id = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[by_id], rows[by_id]
    # Of equal vectors, only the k + 1 smallest ids can be among the best (one of them may be the query's own).
    _, group = np.unique(rows, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = np.sort(order[place <= k])
    row_ids, rows = row_ids[kept], rows[kept]
    rq, rs, rg = quantised(_units(rows))
    rf = rq.astype(np.float32)
    starts = np.flatnonzero(np.diff(row_ids, prepend=row_ids[0] - 1))  # of an id's rows
    out_q, out_r, out_s = [], [], []
    for lo in range(0, len(query_ids), STEP):
        ids, q = query_ids[lo : lo + STEP], queries[lo : lo + STEP]
        qq, qs, qg = quantised(_units(q))
        # int8 products sum to below 2**24 for up to 1040 dimensions and are then exact in float32; longer ones go in double
        wide = np.float32 if q.shape[1] <= 1040 else np.float64
        dots = (qq.astype(wide) @ rf.astype(wide).T).astype(np.float64) * (qs[:, None] * rs[None, :])
        slack = qg[:, None] + rg[None, :] + qg[:, None] * rg[None, :] + 1e-12
        lower, upper = dots - slack, dots + slack
        own = ids[:, None] == row_ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        of_id = lower if len(starts) == lower.shape[1] else np.maximum.reduceat(lower, starts, axis=1)
        if len(starts) > k:
            bar = np.partition(of_id, len(starts) - k, axis=1)[:, len(starts) - k]
        else:
            bar = np.full(len(ids), -np.inf)
        qi, ri = np.nonzero((upper >= bar[:, None]) & ~own)
        score = np.empty(len(qi))
        for s in range(0, len(qi), 65536):
            score[s : s + 65536] = cosines(q[qi[s : s + 65536]], rows[ri[s : s + 65536]])
        best = np.lexsort((row_ids[ri], -score, qi))
        qi, ri, score = qi[best], ri[best], score[best]
        once = np.sort(np.unique(qi * len(starts) + np.searchsorted(row_ids[starts], row_ids[ri]), return_index=True)[1])  # each id's first
        qi, ri, score = qi[once], ri[once], score[once]
        n = np.bincount(qi, minlength=len(ids))
        place = np.arange(len(qi)) - np.repeat(np.cumsum(n) - n, n)
        keep = place < k
        out_q.append(ids[qi[keep]])
        out_r.append(row_ids[ri[keep]])
        out_s.append(score[keep])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def nearest(embeddings: DataFrame, k: int = K, stride: int = STRIDE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest candidates of each row whose id is divisible by stride."""
    rows = usable(embeddings)
    sizes = embeddings.select(F.count("vec_id").alias("n"), F.count_if(F.col("vec_id") % stride == 0).alias("q")).first()
    across, down = -(-sizes["n"] // ROW_BLOCK) or 1, -(-sizes["q"] // QUERY_BLOCK) or 1
    spread = lambda salt, n: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.lit(n)).cast("int")
    queries = rows.where(F.col("vec_id") % stride == 0).withColumn("qb", spread(1, down))
    queries = queries.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    cands = rows.withColumn("rb", spread(2, across)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cands = cands.select(*(F.col(c).alias(f"row_{c}") for c in ("vec_id", "embedding", "dim", "qb", "rb")))  # names apart from the queries' own

    def both(q, r):
        import pandas as pd

        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(r):
            return empty
        got = tile(q["vec_id"].to_numpy(), np.stack(q["embedding"].to_numpy()), r["row_vec_id"].to_numpy(), np.stack(r["row_embedding"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got)))

    tiles = queries.groupBy("dim", "qb", "rb").cogroup(cands.groupBy("row_dim", "row_qb", "row_rb")).applyInPandas(both, "query_id long, vec_id long, score double")

    def merge(pdf):
        """The heaps of queries' tiles, merged. Of rows of one id with different vectors the best stands for the id."""
        import heapq

        import pandas as pd

        once: dict = {}
        for q, r, x in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
            own = once.setdefault(q, {})
            own[r] = max(x, own.get(r, -np.inf))
        rows = [(q, i + 1, r, -x) for q, own in once.items() for i, (x, r) in enumerate(heapq.nsmallest(k, ((-x, r) for r, x in own.items())))]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    together = F.pmod(F.xxhash64("query_id"), F.lit(-(-sizes["q"] // MERGED) or 1))
    return tiles.groupBy(together).applyInPandas(merge, "query_id long, rank int, vec_id long, score double")


ORACLE = f"""
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e)))) AS score
  FROM v q JOIN v c ON q.vec_id % {STRIDE} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e) GROUP BY ALL
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= {K}
"""
