"""Operator 1, language ID: a linear-chain CRF labels every word of a (code-switched) text; shares decide the document.

Defined results: null text, no letter -> `und`, score 0, no spans. Ties between languages go to the first in order.
Rows repeat or ids are null: each row is labelled alone. Columns with other names pass by unread. A text of any length is
labelled whole; a stretch of letters without white space is one word, whatever its length.
An empty table, or one without a label to learn from, gives `und` for every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import crf, words
from .common import fold_of, freed, held_out, hold, map_arrow, shared

SAMPLE_PER_LANG = 600  #: training documents for each language, chosen by a hash of the id, each whole
SEQUENCES, LENGTH = 2400, 40
LEAST_SCORE = 0.4  #: the pipeline rejects documents of which no language holds this share


def sample(documents: DataFrame, quota: int = SAMPLE_PER_LANG) -> DataFrame:
    """Labelled rows to learn from, about `quota` a language (all, if fewer): (doc_id, lang, words)."""
    may = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= words.TRAINING_CHARACTERS))
    counts = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return may.select("doc_id", "lang", F.lit("").alias("words")).limit(0)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)

    def take(c):
        return {"doc_id": c["doc_id"], "lang": c["lang"], "words": [" ".join(words.words_of(x)) for x in c["text"]]}

    return map_arrow(may.where(draw < share), take, "doc_id long, lang string, words string").where("words <> ''").orderBy("doc_id", "lang", "words").limit(2 * quota * len(counts))


def fit(rows: list[tuple[str, list[str]]], seed: int = 11) -> crf.Model | None:
    """rows: (language, words). Sequences splice stretches of documents, so that transitions learn to switch."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    by_label = [[w for lang, w in rows if lang == x] for x in labels]
    counts: dict[str, np.ndarray] = {}
    for k, texts in enumerate(by_label):
        for text in texts:
            for w in set(text):
                counts.setdefault(w, np.zeros(len(labels)))[k] += 1
    lexicon = crf.purity_lexicon(counts, 5, 0.9)
    sequences, tags = [], []
    for _ in range(SEQUENCES):
        cuts = np.sort(rng.integers(1, LENGTH, size=rng.integers(0, 4))) if len(labels) > 1 else []
        out, y = [], []
        for n in np.diff([0, *cuts, LENGTH]):
            k = int(rng.integers(len(labels)))
            while n > 0:  # a short text is followed by another of its language
                text = by_label[k][rng.integers(len(by_label[k]))]
                start = int(rng.integers(max(1, len(text) - n + 1)))
                got = text[start : start + n]
                out, y, n = out + got, y + [k] * len(got), n - len(got)
        sequences.append(out)
        tags.append(np.array(y))
    return crf.train(sequences, tags, labels, lexicon, epochs=3)


def learned(spark: SparkSession, documents: DataFrame) -> crf.Model | None:
    rows = sorted((r["doc_id"], r["lang"], r["words"]) for r in sample(documents).collect())
    known: dict[str, str] = {}
    model = fit([(lang, [known.setdefault(x, x) for x in w.split()]) for _, lang, w in rows])
    del rows, known
    freed()  # the driver's memory of the training
    return model


def _table(shared) -> crf.WordTable:
    """One table in a Python worker."""
    return hold(("langid", shared.id), lambda: crf.WordTable(shared.value, words.word_of))


class _Handle:
    """What a task needs to find its model; a Spark broadcast in jobs, or a plain value in tests."""

    def __init__(self, shared, key):
        self.shared, self.id = shared, key

    @property
    def value(self):
        return self.shared.value if hasattr(self.shared, "value") else self.shared


def handle(spark: SparkSession | None, model) -> _Handle:
    import uuid

    return _Handle(shared(spark, model) if spark else model, uuid.uuid4().hex)


def label_texts(table: crf.WordTable, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    """(language, its share of the text, words, switches between words) of each text."""
    out = [("und", 0.0, 0, 0)] * len(texts)
    names = table.model.labels
    for i, _, p, _ in words.marginals_of(table, texts):
        share = p.mean(axis=0)
        best = int(share.argmax())
        tags = p.argmax(axis=1)
        out[i] = (names[best], float(min(1.0, share[best])), len(p), int((tags[1:] != tags[:-1]).sum()))
    return out


def spans(table: crf.WordTable, text: str) -> list[tuple[int, int, str]]:
    """Stretches of one language: (start, end, language), in characters."""
    places, out = words.token_spans(text), []
    for _, at, p, _ in words.marginals_of(table, [text]):
        for j, k in zip(at, p.argmax(axis=1)):
            a, b = places[j]
            name = table.model.labels[k]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], b, name)
            else:
                out.append((a, b, name))
    return out


def predict(documents: DataFrame, model: crf.Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id and text of documents -> held_out, lang_pred, score, n_words, n_switches; `keep` carries other columns."""
    keep = keep or []
    shared = handle(documents.sparkSession, model)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(c):
        found = label_texts(_table(shared), c["text"]) if model_known else [("und", 0.0, 0, 0)] * len(c["text"])
        lang, score, n, switches = zip(*found)
        return {"doc_id": c["doc_id"], "held_out": [d is not None and fold_of(d) == 2 for d in c["doc_id"]], "lang_pred": lang, "score": score, "n_words": n, "n_switches": switches}

    model_known = model is not None
    return map_arrow(documents.select("doc_id", "text", *keep), run, schema, keep)


def identify(spark: SparkSession, documents: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    return predict(documents, learned(spark, documents if train_on is None else train_on))
