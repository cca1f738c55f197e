"""Operator 11, compaction: small files of a day are packed into bins by first fit and each bin becomes one file.

A table is written as files of (day, lot, piece), one folder a file, and compacted in place. A plan is made for each day from
the rows that its files hold: files under a size are taken by descending rows, and each joins the earliest-opened bin with
room. Bins stand in blocks of about the square root of the number of files; a block caches its largest room, so a search
looks at blocks and then inside of the first sufficient one. A day has at most 4 * (1 + 200) files, whatever the table's size.

Plan and rows are grouped together by file, the rows of a bin are sorted by their place in it and written by one task, which
streams: sort and writer spill, and no file is held in memory. (Pandas groups of plan and rows would hold R / 400 rows each.)
New files are committed beside the old ones before those are deleted; a run that dies between leaves rows twice in its own
folder, never none. Deleting takes the paths one by one; their number is bounded by four times the days and lots.

Defined results: a null arrived_at makes a day of its own, null; a null click_id counts as the text '' for its crc32 and in
the list of ids; values that are null or not finite count 0 cents. Rows that repeat are rows. No rows give no files. Columns
of any name and order go into the files; a column named like a folder gives that another name.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpoint_dir, measured, written
from .neardup import few

LOT, SMALL, BIN = 200, 750, 400  #: a day's rows a lot, a file to be merged, and a bin, each as a share of the table's rows
PIECES = 4


def share(rows: int, x: int) -> int:
    """S(x): rows that the x-th part of the table has."""
    return 1 + rows // x


def packed(sizes, most: int) -> tuple[list[int], list[int]]:
    """First fit: the bin of each size, in the order given, and its place there. A size over `most` has a bin alone."""
    width = max(1, math.isqrt(len(sizes)))
    room: list[int] = []
    top: list[int] = []  # of each block of `width` bins: the largest room
    count: list[int] = []
    bins, places = [], []
    for size in sizes:
        block = next((b for b, r in enumerate(top) if r >= size), None)
        if block is None:
            at = len(room)
            room.append(most - size)
            count.append(0)
            if at % width == 0:
                top.append(room[at])
            else:
                top[-1] = max(top[-1], room[at])
        else:
            at = next(i for i in range(block * width, len(room)) if room[i] >= size)
            room[at] -= size
            top[block] = max(room[block * width : (block + 1) * width])
        bins.append(at)
        places.append(count[at])
        count[at] += 1
    return bins, places


def names_beside(columns: list[str], wanted: tuple[str, ...]) -> list[str]:
    """The wanted names, each with underscores in front until no column has it (Spark ignores case)."""
    used, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name in used:
            name = "_" + name
        used.add(name)
        out.append(name)
    return out


def day_of(at: Column) -> Column:
    return F.unix_date(at.cast("date")).cast("long")


def write_starting(clicks: DataFrame, path: str) -> tuple[list[str], int]:
    """Writes the starting files below path; returns the names of their folders' columns, and the table's rows."""
    folders = names_beside(clicks.columns, ("day", "lot", "piece", "day_rows", "hash"))
    day, lot, piece, of_day, h = folders
    rows = clicks.withColumns({day: day_of(F.col("arrived_at")), h: F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary"))})
    days, seen = measured(rows.groupBy(day).agg(F.count("*").alias(of_day)), "compaction-days", None, rows=F.sum(of_day))
    total = seen.get("rows", 0)
    known = days.withColumnRenamed(day, h + "_day")
    rows = rows.join(few(known, seen.get("n", 0)), F.col(day).eqNullSafe(F.col(h + "_day"))).drop(h + "_day")
    lots = F.lit(1) + F.floor(F.col(of_day) / F.lit(share(total, LOT)))
    rows = rows.withColumns({lot: (F.floor(F.col(h) / 16) % lots).cast("long"), piece: F.least(F.col(h) % PIECES, F.floor(F.col(h) / 4) % PIECES).cast("long")})
    own = [F.col(f"`{c}`") for c in clicks.columns]
    whole = rows.select(*own, day, lot, piece).repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, "arrived_at", "click_id")
    whole.write.option("maxRecordsPerFile", 0).partitionBy(day, lot, piece).parquet(path)
    return folders[:3], total


def planned(files: DataFrame, total: int) -> DataFrame:
    """day, lot, piece, n (rows of a file), and more columns of text -> and bin, place, first_lot, first_piece, members, sources."""
    small, most = share(total, SMALL), share(total, BIN)

    def plan(pdf):
        pdf = pdf.sort_values(["n", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
        packs = (pdf["n"] < small).to_numpy()
        bins, places = np.full(len(pdf), -1), np.zeros(len(pdf), dtype=np.int64)
        bins[packs], places[packs] = packed(pdf["n"][packs].tolist(), most)
        bins[~packs] = len(pdf) + np.arange((~packs).sum())
        pdf = pdf.assign(bin=bins, place=places).sort_values(["bin", "place"], ignore_index=True)
        of = pdf.groupby("bin")
        names = pdf["lot"].astype(str) + "-" + pdf["piece"].astype(str)
        joined = names.groupby(pdf["bin"]).agg(",".join)
        return pdf.assign(first_lot=of["lot"].transform("first"), first_piece=of["piece"].transform("first"), members=of["n"].transform("size"), sources=pdf["bin"].map(joined))

    shape = "day long, lot long, piece long, n long, path string, bin long, place long, first_lot long, first_piece long, members long, sources string"
    return files.groupBy("day").applyInPandas(plan, shape)


def with_folders(rows: DataFrame, folders: list[str]) -> DataFrame:
    """Adds day, lot and piece under names of our own, as longs."""
    return rows.withColumns({f"at_{k}": F.col(c).cast("long") for k, c in zip(("day", "lot", "piece"), folders)})


def read_folder(spark: SparkSession, path: str, clicks: DataFrame, folders: list[str]) -> DataFrame:
    """The files below path, with their folders' columns and _metadata."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in clicks.schema), *(f"`{c}` long" for c in folders)])
    return spark.read.schema(schema).parquet(path)


def merge(spark: SparkSession, clicks: DataFrame, path: str, folders: list[str], total: int) -> DataFrame:
    """Compacts the files below path; returns the plan."""
    day, lot, piece = folders
    rows = read_folder(spark, path, clicks, folders)
    files = rows.groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece")).agg(F.count("*").alias("n"), F.min("_metadata.file_path").alias("path"))
    plan = written(planned(files, total), "compaction-plan")
    gone = plan.where("members > 1")
    own = [F.col(f"`{c}`") for c in clicks.columns]
    keys = names_beside([*clicks.columns, *folders], ("p_day", "p_lot", "p_piece", "p_first_lot", "p_first_piece", "p_place", "p_row"))
    part = gone.select(*[F.col(c).alias(k) for c, k in zip(("day", "lot", "piece", "first_lot", "first_piece", "place"), keys)])
    both = rows.select(*own, day, lot, piece, F.col("_metadata.row_index").alias(keys[6])).join(part, F.col(day).eqNullSafe(F.col(keys[0])) & (F.col(lot) == F.col(keys[1])) & (F.col(piece) == F.col(keys[2])))
    new = both.select(*own, F.col(day), F.col(keys[3]).alias(lot), F.col(keys[4]).alias(piece), keys[5], keys[6])
    new = new.repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, keys[5], keys[6]).drop(keys[5], keys[6])
    new.write.mode("append").option("maxRecordsPerFile", 0).partitionBy(day, lot, piece).parquet(path)
    jvm = spark.sparkContext._jvm
    for row in gone.select("path").toLocalIterator():
        old = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.path))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, False)
    return plan


def cents(value: Column) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.floor(100 * value + 0.5)).otherwise(0).cast("long")


def digests(files: DataFrame) -> DataFrame:
    """day, lot, piece, row, click_id, cents, path of every row -> a row a file. Ids are hashed as they stream by."""
    import pyarrow as pa

    shape = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string, path string"
    ordered = files.repartition("day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "row")

    def scan(batches):
        open_: list | None = None  # key, digest, rows, least, most, cents

        def closed():
            key, digest, n, least, most, total = open_
            return pa.RecordBatch.from_pydict({"day": pa.array([key[0]], pa.int64()), "lot": [key[1]], "piece": [key[2]], "n_rows": [n], "min_click_id": pa.array([least], pa.int64()), "max_click_id": pa.array([most], pa.int64()), "cents": [total], "ids_sha256": [digest.hexdigest()], "path": [key[3]]})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("day", "lot", "piece", "path")]
            path = keys[3].dictionary_encode()
            turn = np.flatnonzero(np.diff(path.indices.to_numpy())) + 1
            for lo, hi in zip([0, *turn], [*turn, batch.num_rows]):
                key = tuple(k[int(lo)].as_py() for k in keys)
                ids = batch.column("click_id").slice(int(lo), int(hi - lo)).to_pylist()
                total = sum(batch.column("cents").slice(int(lo), int(hi - lo)).to_pylist())
                known = [i for i in ids if i is not None]
                if open_ is None or open_[0] != key:
                    if open_ is not None:
                        yield closed()
                    open_ = [key, hashlib.sha256(), 0, None, None, 0]
                open_[1].update(("," * (open_[2] > 0) + ",".join("" if i is None else str(i) for i in ids)).encode())
                open_[2] += len(ids)
                if known:
                    open_[3] = min(known) if open_[3] is None else min(open_[3], min(known))
                    open_[4] = max(known) if open_[4] is None else max(open_[4], max(known))
                open_[5] += total
        if open_ is not None:
            yield closed()

    return ordered.mapInArrow(scan, shape)


def compact(spark: SparkSession, clicks: DataFrame) -> DataFrame:
    """Writes clicks to a new folder, compacts it, and gives a row for each file that is there then."""
    path = f"{checkpoint_dir(spark)}/compaction-{uuid.uuid4().hex}"
    folders, total = write_starting(clicks, path)
    if not total:
        return spark.createDataFrame([], "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string, path string, sources string, rewritten boolean, columns string")
    plan = merge(spark, clicks, path, folders, total)
    spark.catalog.refreshByPath(path)
    rows = read_folder(spark, path, clicks, folders)
    files = rows.select(*[F.col(c).alias(k) for k, c in zip(("day", "lot", "piece"), folders)], F.col("_metadata.row_index").alias("row"), "click_id", cents(F.col("value")).alias("cents"), F.col("_metadata.file_path").alias("path"))
    final = plan.where("place = 0").select(F.col("day").alias("_day"), F.col("lot").alias("_lot"), F.col("piece").alias("_piece"), "sources", (F.col("members") > 1).alias("rewritten"))
    found = digests(files)
    joined = found.join(final, F.col("day").eqNullSafe(F.col("_day")) & (F.col("lot") == F.col("_lot")) & (F.col("piece") == F.col("_piece"))).drop("_day", "_lot", "_piece")
    return joined.withColumn("columns", F.lit(",".join(clicks.columns)))
