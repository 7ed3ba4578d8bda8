"""Record streams: filters, first occurrences, quotas, orders, samples.  Order is always a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seeded_order, unit_interval
from ..sources.staging import stage_table


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order.  An aggregate with partial combination, so a hot key is never gathered."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__first")).select("__first.*")


def tri_state(gate_ok: Column, length: Column, most: int) -> Column:
    """gate, length or ok, tested in this order; a null length counts as too long."""
    return F.when(~gate_ok, "gate").when(length.isNull() | (length >= most), "length").otherwise("ok")


def _numbered(df: DataFrame, order: list[Column | str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in range partitions of the order, written once with their partition and their rank in it, and the ranks before
    each partition.  Ranks and counts come from the same written table: a second execution would cut the ranges elsewhere."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    own = stage_table(ordered.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), name)
    counts = {r["__part"]: r["n"] for r in own.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    return own, spark.createDataFrame(offsets or [(0, 0)], "__part int, __before long")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Global rank from 1 without gathering the rows in one task: rows are range-partitioned by the order, each partition
    ranks its own, and the partitions' counts (one row a partition) give the offsets."""
    own, offsets = _numbered(df, order, "ranked")
    return own.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """The sum of a column up to each row, without gathering the rows: sums within range partitions, and those before each."""
    own, _ = _numbered(df, order, "running")
    spark, before, total = df.sparkSession, [], 0
    for r in own.groupBy("__part").agg(F.sum(value).alias("s")).orderBy("__part").collect():
        before.append((r["__part"], total))
        total += r["s"] or 0
    kind = own.agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(before or [(0, 0)], f"__part int, __before {kind}"))
    within = F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy("__part").orderBy("__own"))
    return own.join(table, "__part").withColumn(name, F.col("__before") + within).drop("__part", "__own", "__before")


def group_ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 1 within each group, a group of any size: global ranks by group and order, less those before the group."""
    everywhere = ranked(df, [*group, *order], "__global")
    first = everywhere.groupBy(*(F.col(g).alias(f"__{g}") for g in group)).agg((F.min("__global") - 1).alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    out = everywhere.join(first, same).withColumn(name, F.col("__global") - F.col("__first"))
    return out.drop("__global", "__first", *(f"__{g}" for g in group))


def skip_take(df: DataFrame, order: list[Column | str], skip: int, take: int) -> DataFrame:
    """Rows skip + 1 to skip + take in order; take 0: all the rest."""
    out = df.orderBy(*order).offset(skip)
    return out.limit(take) if take else out


def seeded_sample(df: DataFrame, key: str, seed: int, n: int, eligible: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A uniform sample of n rows, the same in each run: the n least seeded digests.  n < 0: all.  eligible: what may be drawn."""
    out = (df.transform(eligible) if eligible else df).withColumn("__draw", seeded_order(seed, F.col(key)))
    return (out if n < 0 else out.orderBy("__draw", key).limit(n)).drop("__draw")


def stratified_sample(df: DataFrame, strata: list[str], key: str, seed: int, n: int, exact: bool = False) -> DataFrame:
    """Round robin over strata in seeded order, each in seeded order, until n rows.  No stratum gives more than n, so each
    task passes on n rows a stratum at most.  exact: an error where there are fewer than n rows."""
    draw = seeded_order(seed, F.col(key))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))
    stratum = seeded_order(seed, F.concat_ws("|", *strata))
    turns = df.withColumn("__turn", turn).where(F.col("__turn") <= n).withColumn("__stratum", stratum)
    out = turns.orderBy("__turn", "__stratum", key).limit(n).drop("__turn", "__stratum")
    if exact and (found := out.count()) < n:
        raise ValueError(f"{found} rows of {n}")
    return out


def per_group_sample(df: DataFrame, group: list[str], key: str, seed: int, n: int) -> DataFrame:
    """At most n rows of each group, in seeded order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(seeded_order(seed, F.col(key)), key))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def interleave(df: DataFrame, group: str, order: list[str], kind: str = "even") -> DataFrame:
    """Position columns that spread groups out: ``slot`` to sort by, then ``group_order`` (size down, key up).

    even: slot is (rank - 0.5) / size of the group; round_robin: the rank in the group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    sizes = ranked(sizes, [F.desc("group_size"), F.asc(group)], "group_order").withColumnRenamed(group, "__group")
    out = group_ranked(df, [group], order, "group_rank").join(sizes, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    slot = (F.col("group_rank") - 0.5) / F.col("group_size") if kind == "even" else F.col("group_rank").cast("double")
    return out.withColumn("slot", slot)


def balance(df: DataFrame, group: str, key: str) -> DataFrame:
    """Every group up-sampled to the largest one's size: each row as often as its turn comes, rows in seeded order."""
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("top"))
    drawn = group_ranked(df.withColumn("__draw", seeded_order(0, F.col(key))), [group], ["__draw", key], "__rank")
    out = drawn.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).crossJoin(F.broadcast(largest))
    copies = F.floor((F.col("top") - F.col("__rank")) / F.col("n")) + 1
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("__rank", "__draw", "__group", "n", "top")


def modal_length(df: DataFrame, length: str) -> DataFrame:
    """Rows of the most frequent length (the least of equals)."""
    top = df.groupBy(length).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), F.asc(length)).limit(1).select(length)
    return df.join(F.broadcast(top), length, "left_semi")


def window_distinct(df: DataFrame, label: str, order: list[Column | str], width: int) -> DataFrame:
    """Distinct labels in each full run of ``width`` rows; a short tail counts only where it is the only run."""
    runs = ranked(df, order, "__r").withColumn("window_no", F.floor((F.col("__r") - 1) / width).cast("long"))
    out = runs.groupBy("window_no").agg(F.countDistinct(label).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))
    return out.where((F.col("n_rows") == width) | (F.col("window_no") == 0))


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on each side, in common, and the right's share of the common ones in percent (null on none)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), keys, "full")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both")).withColumn(
        "percent", F.when(F.col("n_right") > 0, 100.0 * F.col("n_both") / F.col("n_right"))
    )


def without_holdout(rows: DataFrame, holdout: DataFrame, key: str, names: str) -> DataFrame:
    """Rows none of whose names (an array) is a name of a hold-out row: two equi-joins instead of an OR."""
    banned = holdout.select(F.explode(names).alias("__name")).distinct()
    hit = rows.select(key, F.explode(names).alias("__name")).join(banned, "__name", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_anti")


def fill_slots(expected: DataFrame, saved: DataFrame, keys: list[str], n: int, slot: str) -> DataFrame:
    """Every expected (keys, slot 0 to n - 1) with what was saved for it; ``missing`` where nothing was."""
    full = expected.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(slot))
    return full.join(saved.withColumn("__saved", F.lit(True)), [*keys, slot], "left").withColumn("missing", F.col("__saved").isNull()).drop("__saved")


def buffered_shuffle(df: DataFrame, order: list[Column | str], key: str, seed: int, buffer: int, name: str = "position") -> DataFrame:
    """The order of a stream shuffled through a buffer: a row leaves at most ``buffer`` places after it came, by its seeded draw."""
    came = ranked(df, order, "__came")
    leaves = came.withColumn("__leaves", F.col("__came") + F.floor(unit_interval(seed, F.col(key)) * buffer))
    return ranked(leaves, ["__leaves", "__came"], name).drop("__leaves", "__came")
