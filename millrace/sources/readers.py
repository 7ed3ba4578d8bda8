"""Scans: tables, JSON documents and lines, CSV, text logs, Arrow streams, trial stores, checkpoints, synthetic labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, split: str | None = None) -> DataFrame:
    """A parquet table; the columns and the split reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("split") == split) if split is not None else df
    return df.select(*columns) if columns else df


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a ``.jsonl`` file, or of one JSON document (an array, or one object)."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", not path.endswith(".jsonl")).json(path)


def json_objects(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON document of named objects as one row a name; ``value`` is the objects' struct schema."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "__value")).select(key, "__value.*")


def balanced_csv(spark: SparkSession, path: str, group: str, key: str, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """The rows of a CSV with their ``split`` by the hash of their key; groups of the training split up-sampled to one size."""
    from ..functions.keys import hash_split
    from ..operators.records import balance

    rows = csv(spark, path).withColumn("split", hash_split(seed, F.col(key), ratios))
    train = balance(rows.where("split = 'train'"), group, key).drop("copy")
    return train.unionByName(rows.where("split <> 'train'"))


def csv(spark: SparkSession, path: str, index_column: str = "Unnamed: 0") -> DataFrame:
    """A CSV with a header, without an index column; an unnamed first column is an index too."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).drop(index_column, "_c0")


def literal_log(spark: SparkSession, path: str, prefix: str, fields: str) -> DataFrame:
    """Log lines that start with ``prefix`` and hold a literal of quoted names and numbers, as columns ``fields``."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit(prefix)))
    options = {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"}
    return lines.select(F.from_json("value", fields, options).alias("r")).select("r.*")


def trials(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """Completed trials of a relational store, read in parallel over ``partition`` where ``bounds`` (low, high, parts) are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition and bounds:
        low, high, parts = bounds
        reader = reader.option("partitionColumn", partition).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load().where("state = 'COMPLETE' AND value IS NOT NULL")


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(step, path, modified) of the files of checkpoint folders ``checkpoint-N`` under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    step = F.regexp_extract("path", r"/checkpoint-(\d+)/", 1)
    found = files.where(step != "").groupBy(step.cast("int").alias("step"), F.regexp_extract("path", r"^(.*/checkpoint-\d+)/", 1).alias("path"))
    return found.agg(F.max("modificationTime").alias("modified"), F.count(F.lit(1)).alias("n_files"))


def latest(found: DataFrame, least_files: int = 1) -> DataFrame:
    """The newest complete checkpoint: greatest (modified, step)."""
    return found.where(F.col("n_files") >= least_files).agg(F.max_by(F.struct("step", "path"), F.struct("modified", "step")).alias("r")).select("r.*")


def synthetic_labels(spark: SparkSession, groups: int, rows: int, kind: str = "uniform", exponent: float = 1.1, few: int = 3) -> DataFrame:
    """(label, copy): rows spread over groups evenly, by a power law, or over a few groups only; counts are made, not drawn."""
    g = spark.range(groups).withColumnRenamed("id", "label")
    if kind == "zipf":
        total = sum((i + 1) ** -exponent for i in range(groups))
        n = F.greatest(F.lit(1), F.round(F.pow(F.col("label") + 1.0, F.lit(-exponent)) * rows / total).cast("int"))
    elif kind == "few":
        n = F.when(F.col("label") < few, F.lit(max(1, rows // few))).otherwise(0)
    else:
        n = F.lit(max(1, rows // groups))
    return g.withColumn("__n", n).where("__n > 0").select("label", F.explode(F.expr("sequence(1, __n)")).alias("copy"))


class ArrowStreamSource(DataSource):
    """``spark.read.format("arrow_stream").schema(...).load(path)``: Arrow stream files, one task a file.  Files are reached
    through paths that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self) -> StructType:
        raise ValueError("give the schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowStreamReader(self.options["path"], [f.name for f in schema.fields])


class _ArrowStreamReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition):
        import pyarrow as pa

        with pa.memory_map(partition.value) as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                yield batch.select(self.columns)


def generated(spark: SparkSession, make: Callable[[int], Iterable[tuple]], parts: int, schema: str) -> DataFrame:
    """Rows of a generator: ``make`` gives those of each part, in parallel; the same number gives the same rows."""

    def rows(batches):
        import pandas as pd

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for part in batch["id"]:
                yield pd.DataFrame(list(make(int(part))), columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(rows, schema)


def framed_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_no, data) of binary logs in blocks of 32 KB: records under headers of checksum (4), length (2) and kind (1: whole,
    2 to 4: first, middle and last part).  What a cut file ends with is left out; the payload is for ``from_protobuf``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                out += [(name, i, r) for i, r in enumerate(framed_records(bytes(content)))]
            yield pd.DataFrame(out, columns=["path", "record_no", "data"])

    return files.mapInPandas(rows, "path string, record_no int, data binary")


BLOCK, HEADER = 32768, 7


def framed_records(content: bytes, start: int = 0) -> Iterator[bytes]:
    """The whole records of a framed log."""
    at, held = start, b""
    while at + HEADER <= len(content):
        left = BLOCK - at % BLOCK
        if left < HEADER:
            at += left
            continue
        length, kind = int.from_bytes(content[at + 4 : at + 6], "little"), content[at + 6]
        body = content[at + HEADER : at + HEADER + length]
        if len(body) < length or kind not in (1, 2, 3, 4):
            return
        at += HEADER + length
        if kind == 1:
            yield body
        else:
            held = body if kind == 2 else held + body
            if kind == 4:
                yield held


def register_tree_edges(spark: SparkSession) -> None:
    """Registers the table function ``tree_edges(json)``: (parent, child, depth) of a nested JSON object of names."""
    spark.udtf.register("tree_edges", TreeEdges)


@F.udtf(returnType="parent string, child string, depth int")
class TreeEdges:
    def eval(self, text: str):
        import json

        if text is None:
            return
        stack = [(None, json.loads(text), 0)]
        while stack:
            parent, below, depth = stack.pop()
            for child, more in (below or {}).items():
                if parent is not None:
                    yield parent, child, depth
                stack.append((child, more, depth + 1))
