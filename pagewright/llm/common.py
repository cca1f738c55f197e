"""Helpers that several operators share: reading tables, cutting lineage, distributed ranks, Arrow maps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a folder of this session's own.

    The fallback is a local folder and holds for a local master only: on a cluster it would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
    own = os.path.join(tempfile.gettempdir(), f"pagewright-checkpoints-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def measured(df: DataFrame, label: str, scratch: list | None = None, **sums) -> tuple[DataFrame, dict]:
    """written(), and aggregates over the rows seen on the way out: n, their number, and those of `sums`."""
    spark, seen = df.sparkSession, Observation()
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]).write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.parquet(path), {k: v or 0 for k, v in seen.get.items()}


def written(df: DataFrame, label: str, scratch: list | None = None) -> DataFrame:
    """Cuts the lineage of df by a Parquet table in the shared folder: columns that a later stage doesn't read stay on disk.

    scratch: a list that the folder's path is added to, for dropped().
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.parquet(path)


def dropped(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes written() tables that nothing reads any more."""
    for name in scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def reclaimed(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files and broadcasts that nothing refers to any more.

    It does so only once the driver collects its garbage, which a driver of few objects puts off until its memory is full.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_BYTES = 6_000_000  #: of rows that become Python objects at once
ROWS_A_BATCH = 2_000  #: of an Arrow batch between Spark and a worker, where the session doesn't say otherwise

_held: dict = {}


def hold(key, make):
    """The one large object (model table, tokenizer, memo) that a worker process keeps: another key's takes its place.

    Workers outlive stages, so without this a pipeline's operators would all stay in memory together.
    """
    if key not in _held:
        _held.clear()
        freed()
        _held[key] = make()
    return _held[key]


def freed() -> None:
    """Collects garbage and gives free memory back to the system where the C library can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_broadcasts: list = []


def shared(spark: SparkSession, value):
    """A broadcast of value that released() takes back."""
    _broadcasts.append(spark.sparkContext.broadcast(value))
    return _broadcasts[-1]


def released() -> None:
    """Takes models and schedules back from the executors, once what needs them is written; a task that runs again fetches its own."""
    for b in _broadcasts:
        b.unpersist()
    _broadcasts.clear()


def shipped(spark: SparkSession, path: str) -> str:
    """Gives the workers a file of the driver's; returns the name under which local() finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def local(name: str) -> str:
    """On a worker: the path of a shipped() file."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def stretches(batches, most: int):
    """Arrow batches as tables of about `most` bytes: small ones are gathered, large ones cut by rows."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and size + part.nbytes > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def map_arrow(df: DataFrame, fn, schema: str, carry: list[str] | None = None, read: list[str] | None = None, most: int = BATCH_BYTES) -> DataFrame:
    """fn(dict of Python lists) -> dict of lists or arrays, over stretches of about `most` bytes of df.

    carry: columns that go from input to output as they are, without becoming Python objects; read: those of them that
    fn sees nevertheless. At a task's end the worker gives its free memory back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(rows)) == 10_000:  # the default: texts of a few KB would fill tens of MB on either side
        conf.set(rows, str(ROWS_A_BATCH))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    carried, seen = set(carry or ()), set(read or ())

    def run(batches):
        for part in stretches(batches, most):
            out = fn({n: part.column(n).to_pylist() for n in part.schema.names if n not in carried or n in seen})
            columns = [part.column(f.name).combine_chunks().cast(f.type) if f.name in carried else pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        freed()

    return df.mapInArrow(run, schema)


def fold_of(doc_id) -> int:
    """The remainder that decides which rows may be learned from: 2 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 4


def held_out(column="doc_id"):
    """The same as a column: null ids have the text "null" in neither place, so they count as not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(sizes: list[int], most: int):
    """Index ranges whose sizes add up to about `most`: bounds the memory that one step of a batch takes."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ranked(counts: DataFrame, group: str, bucket: str, count: str) -> DataFrame:
    """Adds `first`: how many rows of the group stand in earlier buckets.

    counts has one row for each group and bucket, so the window sees as many rows as there are buckets, not rows.
    """
    w = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))


class Memo(dict):
    """A memo of fn bounded in bytes, in two generations: when the young one is full it becomes the old one, so hot keys survive.

    A key or value longer than LONG isn't kept: one text without white space must not fill a worker.
    """

    LONG = 256

    def __init__(self, fn, cap: int):
        """cap: bytes of both generations, about."""
        super().__init__()
        self.fn, self.half, self.old, self.size = fn, cap // 2, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        more = len(key) + (len(value) if isinstance(value, bytes) else 0)
        if more <= self.LONG:
            if self.size >= self.half:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[key] = value
            self.size += more + 200  # the objects' own heads and their places in the table
        return value
