"""Immutable tables with a version and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> str:
    """Does not depend on the order or the partitions of the rows: the sum of the rows' digests, and their number."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 16, 31, 46)]
    found = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return f"{found['n']}:" + ":".join(str(found[f"s{at}"] or 0) for at in (1, 16, 31, 46))


def save(df: DataFrame, path: str, version: int, selection: str = "") -> str:
    """Writes rows and their checksum, once: an error if the path exists.  Internal columns (leading ``_``) stay out."""
    spark = df.sparkSession
    df.drop(*(c for c in df.columns if c.startswith("_"))).write.mode("errorifexists").parquet(f"{path}/rows")
    held = checksum(spark.read.parquet(f"{path}/rows"))
    spark.createDataFrame([(version, held, selection)], "version int, checksum string, selection string").coalesce(1).write.json(f"{path}/meta")
    return held


def load(spark: SparkSession, path: str, version: int, key: list[str]) -> DataFrame:
    """The rows; an error if the version or the checksum is another, there are none, or a key repeats."""
    meta = spark.read.json(f"{path}/meta").first()
    rows = spark.read.parquet(f"{path}/rows")
    if meta["version"] != version or meta["checksum"] != checksum(rows):
        raise ValueError("another version or checksum")
    if rows.isEmpty():
        raise ValueError("an empty manifest")
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("a repeated key")
    return rows


def trial_path(root: str, study: str, stage: str, trial: int, seed: int) -> str:
    """Where the files of a trial's seed stand."""
    return f"{root.rstrip('/')}/{study}/{stage}/trial-{trial:05d}/seed-{seed}"


def markdown_table(df: DataFrame, order: list, most: int = 1000) -> str:
    """A small report as a Markdown table: three decimals, ``-`` for null and not-a-number.  An error beyond ``most`` rows."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    shown = lambda v: "-" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
