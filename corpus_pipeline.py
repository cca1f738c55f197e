"""Corpus pipeline: drops toxic documents and those in no known language, keeps one of each group of near copies, mixes
the sources to their weights, and encodes.

Each stage reads what its predecessor wrote and works on all of it. Filters return the kept rows as they are, with the
columns of documents; mixing returns all rows in the order of its schedule; encoding restores that order and adds n_tokens,
ids_sha256 and decoded_sha256. Models are learned from the documents table, never from rows that are held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import codec, langid, mixing, neardup, toxicity
from pagewright.llm.common import dropped, released, table, written
from pagewright.llm.queries import tokenizer


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with every column but doc_id under a name that no operator uses, beside text; and those names."""
    names = [f"carried_{i}" for i in range(len(docs.columns))]
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]), names


def _back(rows: DataFrame, docs: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns of docs again, and more of the operator's; a column of docs that is named like one of those gives way."""
    own = [F.col(n).alias(c) for c, n in zip(docs.columns, names) if c not in more]
    return rows.select(*own, *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that toxicity doesn't predict to be toxic.

    Null and empty texts, null ids and rows that repeat are scored alone, null and empty ones as clean. Very long texts are
    scored whole. No rows in, no rows out. Columns of any name go through; without labels of both classes all rows stay.
    """
    model = toxicity.learned(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    aside, names = _aside(docs)
    return _back(toxicity.score(aside, model, keep=names).where("predicted = 0"), docs, names)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one language holds a clear share; drops those without a letter, null and empty texts among them.

    Null ids and rows that repeat are judged alone, very long texts whole. No rows in, no rows out. Columns of any name go
    through. Without a labelled row to learn from every row goes, as no language is known.
    """
    model = langid.learned(spark, table(spark, sf_dir, "documents"))
    aside, names = _aside(docs)
    found = langid.predict(aside, model, keep=names)
    return _back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.LEAST_SCORE)), docs, names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies, by text and row; of rows equal in id and text one.

    Null ids, null texts and texts without words stay. Very long texts are compared whole. No rows in, no rows out. Columns
    of any name go through.
    """
    return neardup.dropped_copies(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the schedule.

    A null source is a source of its own; null ids, null texts, rows that repeat and very long texts are rows like others.
    No rows in, no rows out. Columns of any name go through.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the digests of their token ids and of the text decoded from them, in the order of the mix.

    Files of a table are read in no fixed order. The schedule is a function of the rows, so it is worked out again here.
    A null or empty text has no tokens; null ids stay null; rows that repeat are encoded one by one, very long texts whole.
    No rows in, no rows out. A column named like one of the three gives way to it.
    """
    aside, names = _aside(mixing.mixed(docs))
    return _back(codec.round_trip(aside, tokenizer(codec.FILE), keep=names), docs, names, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None  # trained models, MinHash and byte-pair merges; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        made: list = []
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", made)
        released()
        dropped(spark, before)  # what this stage read
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
