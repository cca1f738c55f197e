"""Writers: safe CSV, JSON lines, exports with a manifest, batched upserts, writer callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.pages import csv_field, safe_cell, strict_cell

BOM = "﻿"


def safe_lines(df: DataFrame, delimiter: str = ",", decimal: str = ".", strict: bool = False) -> DataFrame:
    """One text column: RFC 4180 lines whose cells no spreadsheet takes for formulas; lists are joined by `; `."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c, number = F.array_join(c, "; "), False
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c, number = F.to_json(c), False
        else:
            number = isinstance(f.dataType, T.NumericType)
            c = c.cast("string")
        cell = strict_cell(c) if strict else safe_cell(c, number)
        if number and decimal == ",":
            cell = F.replace(cell, F.lit("."), F.lit(","))
        cells.append(csv_field(cell, delimiter))
    return df.select(F.concat_ws(delimiter, *cells).alias("value"))


def header_line(df: DataFrame, delimiter: str = ",") -> str:
    return delimiter.join(df.columns)


def write_safe_csv(df: DataFrame, path: str, delimiter: str = ",", decimal: str = ".", bom: bool = False, strict: bool = False) -> None:
    """A folder of CSV parts, each with the header (and a byte-order mark), lines ended by CR LF.

    Parts stay as many as the data has partitions; the header goes in front of each by mapping partitions of text.
    """
    head = (BOM if bom else "") + header_line(df, delimiter)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head], type=b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    safe_lines(df, delimiter, decimal, strict).mapInArrow(with_header, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_items(df: DataFrame, path: str) -> None:
    """By the path's ending: safe CSV or JSON lines."""
    write_safe_csv(df, path) if path.endswith(".csv") else write_json_lines(df, path)


def export_manifest(df: DataFrame, filter_text: str) -> DataFrame:
    """One row: count, filter and a checksum over the rows that doesn't depend on their order."""
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    # The sum of the leading 60 bits of the rows' hashes, as a decimal that can't overflow.
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("sha256")).withColumn("filter", F.lit(filter_text))


def upsert_ignore(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key isn't there yet, one a key."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def written_in_batches(df: DataFrame, write, size: int = 100, retries: int = 3) -> DataFrame:
    """Hands rows to write(list of dicts) in batches; returns a row for each row that was refused: its JSON and the reason.

    A batch that fails is tried again, then row by row without NUL characters; what fails alone is refused. Tasks may run
    again after a lost executor, so `write` must bear a row twice, as an upsert does.
    """

    def clean(v):
        if isinstance(v, str):
            return v.replace("\x00", "")
        return [clean(x) for x in v] if isinstance(v, list) else {k: clean(x) for k, x in v.items()} if isinstance(v, dict) else v

    def run(frames):
        import json

        import pandas as pd

        def refused(rows: list[dict]) -> list[tuple[str, str]]:
            error = None
            for _ in range(retries):
                try:
                    write(rows)
                    return []
                except Exception as e:  # whatever the writer raises; its text becomes the reason
                    error = e
            if len(rows) > 1:
                return [x for row in rows for x in refused([clean(row)])]
            return [(json.dumps(rows[0], default=str, ensure_ascii=False), str(error))]

        for frame in frames:
            rows = frame.to_dict("records")
            out = [x for at in range(0, len(rows), size) for x in refused(rows[at : at + size])]
            yield pd.DataFrame(out, columns=["value", "reason"])

    return df.mapInPandas(run, "value string, reason string")


def write_totals(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """One row: how many rows a writer took and refused."""
    return rows.agg(F.count("*").alias("n")).crossJoin(refused.agg(F.count("*").alias("rejected"))).select((F.col("n") - F.col("rejected")).alias("accepted"), "rejected")


def publish(df: DataFrame, path: str, write=None) -> int:
    """Writes to a folder beside `path` and renames it when it is whole; returns the number of rows.

    What a failed write leaves becomes `<path>.partial`, and its error goes on.
    """
    from pyspark.sql import Observation

    spark, seen = df.sparkSession, Observation()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    made, goal, part = (jvm.Path(p) for p in (path + ".tmp", path, path + ".partial"))
    fs = goal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        (write or write_safe_csv)(df.observe(seen, F.count(F.lit(1)).alias("n")), path + ".tmp")
    except Exception:
        if fs.exists(made):
            fs.delete(part, True)
            fs.rename(made, part)
        raise
    fs.delete(goal, True)
    fs.rename(made, goal)
    return seen.get["n"]


def sanitised_copy(spark, source: str, target: str) -> int:
    """A CSV file as CSV whose cells no spreadsheet takes for formulas; returns the number of rows."""
    from .readers import csv_grid

    return publish(csv_grid(spark, source), target)


def for_each_batch(write):
    """A foreachBatch callback that hands a batch to a writer plugin as JSON lines, with its epoch for idempotence."""

    def run(df: DataFrame, epoch: int) -> None:
        write(df.select(F.to_json(F.struct(*df.columns)).alias("value")), epoch)

    return run
