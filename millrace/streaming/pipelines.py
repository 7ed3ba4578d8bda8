"""Structured Streaming: file arrival, de-duplication, event-time windows, tumbling count windows with carry-over."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive; the schema is that of what is there already."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key.  With an event time, keys are forgotten ``late`` after their last sight; without, state
    grows with the keys."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def event_windows(stream: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows by event-time window and keys."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def count_windows(stream: DataFrame, key: str, label: str, width: int, order: str) -> DataFrame:
    """(key, window_no, n_distinct): distinct labels of each run of ``width`` rows of a key, by ``order`` within a batch, a begun run
    carried over to the next batch.  State is at most one run a key; a key's rows of one batch are ordered together."""
    kind = dict(stream.dtypes)[key]

    def runs(group: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        number, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for value in pd.concat([f[[order, label]] for f in frames]).sort_values(order, kind="stable")[label].astype(str):
            held.append(value)
            if len(held) == width:
                out.append((group[0], number, len(set(held))))
                number, held = number + 1, []
        state.update((number, held))
        yield pd.DataFrame(out, columns=[key, "window_no", "n_distinct"])

    return stream.groupBy(key).applyInPandasWithState(
        runs, f"{key} {kind}, window_no int, n_distinct int", "number int, held array<string>", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, then stops, and reads the result back.  ``folder`` is a shared one: it holds the
    output and the progress.  A run of the same name goes on where the last one stopped: it skips what that has consumed."""
    spark = stream.sparkSession
    at = f"{folder}/{name or uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).format("parquet").start(f"{at}/rows")
    else:  # a complete or updated result: each batch replaces the one before
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/rows")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
