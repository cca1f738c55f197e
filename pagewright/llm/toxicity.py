"""Operator 10, toxicity: a linear-chain CRF tags toxic words; marginals give a document's score and the offending offsets.

Labels are by document. The CRF takes a word's label (clean, toxic) for hidden: a document is toxic if any of its words is.
So the likelihood of label 0 is that of the all-clean path, that of label 1 the rest, and the gradient for a toxic
document goes to the words' marginals given that not all are clean. Words share weights through hashed affixes, so
that inflected and unseen words of a toxic stem are found. Training goes over whole documents in chains of CHAIN words.

score: the chance that some word is toxic, by forward-backward over the whole text; spans: words of marginal one half or more.

Defined results: null or wordless text, or nothing to learn from (no labelled row, or one class only) -> score 0, no spans.
Repeated rows and null ids are scored alone; other columns pass by unread; an empty table gives an empty table. A text of
any length is scored whole, as one chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import crf, langid, words
from .common import fold_of, freed, held_out, hold, map_arrow

SAMPLE_PER_CLASS = 1200  #: labelled documents of either class to learn from, chosen by a hash of the id, each whole
THRESHOLD = 0.3
CHAIN = 48
EPOCHS, BATCH, RATE, L2 = 10, 32, 0.1, 1e-4
RARE = -5.0  #: log weight of a toxic word before anything is learned


def sample(documents: DataFrame, labels: DataFrame, quota: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, toxic, words) of about `quota` rows a class among rows that may be learned from; all, if fewer."""
    may = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in may.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, quota / max(1, counts.get(1, 0)))).otherwise(min(1.0, quota / max(1, counts.get(0, 0))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = may.where(draw < share).orderBy("doc_id").limit(4 * quota)  # so the broadcast holds 4 * quota ids at most
    texts = documents.select("doc_id", "text").where(F.length("text") <= words.TRAINING_CHARACTERS).join(F.broadcast(chosen), "doc_id")

    def take(c):
        return {"doc_id": c["doc_id"], "toxic": c["toxic"], "words": [" ".join(words.words_of(x)) for x in c["text"]]}

    return map_arrow(texts, take, "doc_id long, toxic int, words string").where("words <> ''").orderBy("doc_id", "words").limit(4 * quota)


def _chains(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words by chain, -1 after a chain's end; document of each chain)."""
    parts = [(i, d[k : k + CHAIN]) for i, d in enumerate(documents) for k in range(0, len(d), CHAIN)]
    out = np.full((len(parts), CHAIN), -1, dtype=np.int64)
    for row, (_, part) in zip(out, parts):
        row[: len(part)] = part
    return out, np.array([i for i, _ in parts])


def _expected(log_odds: np.ndarray, real: np.ndarray, start: np.ndarray, transitions: np.ndarray):
    """Of chains: marginal of toxic by word, expected pairs, first word's marginals, log chance of the all-clean path."""
    n, length = log_odds.shape
    e = np.ones((n, length, 2))
    e[..., 1] = np.where(real, np.exp(np.clip(log_odds, -30, 30)), 0.0)  # after its end a chain is clean
    trans, first = np.exp(transitions), np.exp(start)
    alpha, beta, log_z = np.empty_like(e), np.ones_like(e), np.zeros(n)
    for t in range(length):
        a = (first if t == 0 else alpha[:, t - 1] @ trans) * e[:, t]
        total = a.sum(axis=1)
        alpha[:, t] = a / total[:, None]
        log_z += np.log(total)
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ trans.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pairs = alpha[:, :-1, :, None] * trans * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return marginal[..., 1], pairs.sum(axis=1), marginal[:, 0], start[0] + transitions[0, 0] * (length - 1) - log_z


def fit(rows: list[tuple[int, list[str]]], seed: int = 3) -> crf.Model | None:
    """rows: (label, words) of documents. Adam on the likelihood of their labels."""
    labels = np.array([y for y, _ in rows])
    if not len(rows) or labels.all() or not labels.any():
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    documents = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text], dtype=np.int32) for _, text in rows]
    known = list(vocabulary)
    features = np.concatenate([crf.affixes(known[i : i + 20_000]).astype(np.int32) for i in range(0, len(known), 20_000)])
    del vocabulary, known
    weights, m, v = (np.zeros(crf.EMPTY + 1) for _ in range(3))
    chain = np.array([0.0, RARE, 0.0, RARE, 0.0, RARE + 2])  # start, then transitions: toxic words may stand together
    m_chain, v_chain, steps = np.zeros(6), np.zeros(6), 0
    clean_pairs = np.array([[CHAIN - 1.0, 0.0], [0.0, 0.0]])
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(len(documents)), max(1, len(documents) // BATCH)):
            grid, owner = _chains([documents[i] for i in chosen])
            real = grid >= 0
            distinct, inverse = np.unique(grid[real], return_inverse=True)
            ids = features[distinct]
            log_odds = np.zeros(grid.shape)
            log_odds[real] = weights[ids].sum(axis=1)[inverse]
            toxic, pairs, first, clean = _expected(log_odds, real, chain[:2], chain[2:].reshape(2, 2))
            none = np.exp(np.minimum(np.bincount(owner, weights=clean, minlength=len(chosen)), -1e-9))[owner]  # of its document
            bad = labels[chosen][owner] == 1
            more = np.where(bad, 1 / (1 - none) - 1, -1.0)  # what the label adds to a marginal, as a share of it
            by_word = np.bincount(inverse, weights=(toxic * more[:, None])[real], minlength=len(distinct))
            touched, where = np.unique(ids, return_inverse=True)
            gradient = np.bincount(where.ravel(), weights=np.repeat(by_word, ids.shape[1]), minlength=len(touched)) / len(chosen) - L2 * weights[touched]
            gradient[touched == crf.EMPTY] = 0
            share, none = bad[:, None, None], none[:, None, None]
            by_pair = np.where(share, (pairs - none * clean_pairs) / (1 - none), clean_pairs) - pairs
            by_first = np.where(share[:, 0], (first - none[:, 0] * [1, 0]) / (1 - none[:, 0]), [1.0, 0.0]) - first
            steps += 1
            rate = RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            m[touched] = 0.9 * m[touched] + 0.1 * gradient
            v[touched] = 0.999 * v[touched] + 0.001 * gradient * gradient
            weights[touched] += rate * m[touched] / (np.sqrt(v[touched]) + 1e-8)
            gradient = np.concatenate([by_first.sum(axis=0), by_pair.sum(axis=0).ravel()]) / len(chosen)
            m_chain = 0.9 * m_chain + 0.1 * gradient
            v_chain = 0.999 * v_chain + 0.001 * gradient * gradient
            chain += 0.3 * rate * m_chain / (np.sqrt(v_chain) + 1e-8)
    whole = np.stack([np.zeros(len(weights)), weights], axis=1).astype(np.float32)
    return crf.Model(["clean", "toxic"], whole, chain[2:].reshape(2, 2), chain[:2], by_affixes=True)


def score_texts(table: crf.WordTable, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, offending offsets in characters) of each text."""
    out: list = [(0.0, [])] * len(texts)
    model = table.model
    for i, at, p, log_z in words.marginals_of(table, texts):
        clean = model.start[0] + (len(at) - 1) * model.transitions[0, 0]  # a clean word's own potential is 0
        found = at[p[:, 1] >= 0.5].tolist()
        places = words.token_spans(texts[i]) if found else []
        out[i] = (float(-np.expm1(min(0.0, clean - log_z))), [places[j] for j in found])
    return out


def learned(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> crf.Model | None:
    got = sorted((r["doc_id"], r["toxic"], r["words"]) for r in sample(documents, labels).collect())
    known: dict[str, str] = {}
    model = fit([(y, [known.setdefault(x, x) for x in w.split()]) for _, y, w in got])
    del got, known
    freed()  # the driver's memory of the training
    return model


def _table(shared) -> crf.WordTable:
    return hold(("toxicity", shared.id), lambda: crf.WordTable(shared.value, words.word_of))


def score(documents: DataFrame, model: crf.Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id and text of documents -> held_out, score, predicted, span_starts, span_ends; `keep` carries other columns."""
    keep = keep or []
    shared = langid.handle(documents.sparkSession, model)
    known = model is not None
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = "doc_id long, held_out boolean, score double, predicted int, span_starts array<int>, span_ends array<int>" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(c):
        found = score_texts(_table(shared), c["text"]) if known else [(0.0, [])] * len(c["text"])
        return {
            "doc_id": c["doc_id"],
            "held_out": [d is not None and fold_of(d) == 2 for d in c["doc_id"]],
            "score": [s for s, _ in found],
            "predicted": [int(s >= THRESHOLD) for s, _ in found],
            "span_starts": [[a for a, _ in at] for _, at in found],
            "span_ends": [[b for _, b in at] for _, at in found],
        }

    return map_arrow(documents.select("doc_id", "text", *keep), run, schema, keep)


def detect(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, learned(spark, documents, labels))
