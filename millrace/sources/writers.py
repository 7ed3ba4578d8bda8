"""Sinks: shards, canonical lines, reports, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shards(df: DataFrame, path: str, split: str = "split", rows: int = 2000) -> None:
    """Parquet shards of at most ``rows`` rows by split; only the splits that ``df`` has are replaced."""
    writer = df.write.option("maxRecordsPerFile", rows).option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(split).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Writes once: an error if the path exists.  Internal columns (leading ``_``) stay out."""
    df.drop(*(c for c in df.columns if c.startswith("_"))).write.mode("errorifexists").parquet(path)


def report(df: DataFrame, path: str, order: list) -> None:
    """Ranked rows as JSON lines, as a flat CSV, whose nested columns are JSON text, and a summary: rows and columns."""
    ranked = df.orderBy(*order)
    df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("columns", F.array(*(F.lit(c) for c in df.columns))).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    ranked.write.mode("overwrite").json(f"{path}/rows")
    nested = {name for name, kind in df.dtypes if kind.startswith(("struct", "map", "array"))}
    flat = ranked.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/table")


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, missing ones null."""
    out = parts[0].select("*")
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def slots(df: DataFrame, slot_column: str, path: str) -> None:
    """One JSON line for each element of an array column, numbered from 0, with the row's other columns."""
    df.select("*", F.posexplode(slot_column).alias("slot", "outcome")).drop(slot_column).write.mode("overwrite").json(path)


def metrics(stream: DataFrame, path: str, progress: str):
    """A sink for metric rows of a stream: each micro-batch is appended as JSON lines; returns the running query."""

    def put(batch: DataFrame, number: int) -> None:
        json_lines(batch.withColumn("batch", F.lit(number)), path)

    return stream.writeStream.option("checkpointLocation", progress).foreachBatch(put).trigger(availableNow=True).start()


def whole_json(df: DataFrame, path: str, exclusive: bool = False) -> None:
    """Rows as JSON in one folder that appears whole: written beside it under another name and renamed.  exclusive: an error if
    it exists, else it is replaced."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    final, beside = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}.tmp")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if exclusive and files.exists(final):
        raise FileExistsError(path)
    df.write.json(beside.toString())
    if files.exists(final):
        if exclusive:
            files.delete(beside, True)
            raise FileExistsError(path)
        files.delete(final, True)
    if not files.rename(beside, final):
        raise OSError(f"{path} was not renamed")


def named_shards(df: DataFrame, path: str, split: str = "split", rows: int = 2000) -> list[str]:
    """Parquet shards ``{split}-{number:05d}.parquet`` of at most ``rows`` rows; the shards of the splits that ``df`` has are replaced,
    those of others stay.  Returns the names."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    beside, final = hadoop(f"{path}.{uuid.uuid4().hex}.tmp"), hadoop(path)
    df.withColumn("__split", F.col(split)).write.option("maxRecordsPerFile", rows).partitionBy("__split").parquet(beside.toString())
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(final)
    names = []
    for folder in files.listStatus(beside):
        own = folder.getPath().getName().partition("=")[2]
        if not folder.isDirectory():
            continue
        for old in files.listStatus(final):
            if old.getPath().getName().rpartition("-")[0] == own:
                files.delete(old.getPath(), False)
        parts = sorted(f.getPath().toString() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
        for number, part in enumerate(parts):
            names.append(f"{own}-{number:05d}.parquet")
            files.rename(hadoop(part), hadoop(final, names[-1]))
    files.delete(beside, True)
    return sorted(names)
