"""Joins that check what they rely on, reuse of earlier results, renames, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unmet(ValueError):
    """A table does not hold what an operator relies on."""


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _refuse(df: DataFrame, what: str) -> None:
    rows = df.limit(3).collect()
    if rows:
        raise Unmet(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], *, same: list[str] | None = None, left_unique: bool = False, cover_right: bool = False) -> DataFrame:
    """Inner join in which every left row must match exactly one right row, else Unmet names up to three keys.

    same: columns on both sides that must agree (null equals null); left_unique: keys are unique on the left too;
    cover_right: every right row is matched.
    """
    _refuse(_repeated(right, keys), "repeated on the right")
    if left_unique:
        _refuse(_repeated(left, keys), "repeated on the left")
    _refuse(left.join(right, keys, "left_anti").select(*keys), "without a match")
    if cover_right:
        _refuse(right.join(left, keys, "left_anti").select(*keys), "never matched")
    other = right.withColumnsRenamed({c: f"__{c}" for c in same or []})
    out = left.join(other, keys)
    for c in same or []:
        _refuse(out.where(~F.col(c).eqNullSafe(F.col(f"__{c}"))).select(*keys), f"another {c}")
    return out.drop(*(f"__{c}" for c in same or []))


def paired_difference(left: DataFrame, right: DataFrame, key: str, group: str, measures: list[str]) -> DataFrame:
    """Per group the mean difference right - left of each measure over rows paired 1:1 by ``key``; Unmet if a side lacks a key,
    repeats one, or has it in another group."""
    _refuse(_repeated(left, [key]), "repeated on the left")
    _refuse(_repeated(right, [key]), "repeated on the right")
    l, r = (df.select(F.col(key), F.col(group).alias(f"{s}_group"), *(F.col(m).alias(f"{s}_{m}") for m in measures)) for df, s in ((left, "l"), (right, "r")))  # noqa: E741
    both = l.join(r, key, "full")
    _refuse(both.where(~F.col("l_group").eqNullSafe(F.col("r_group"))).select(key), "not on both sides")
    return both.groupBy(F.col("l_group").alias(group)).agg(*(F.avg(F.col(f"r_{m}").cast("double") - F.col(f"l_{m}").cast("double")).alias(m) for m in measures))


def detection_matrix(vectors: DataFrame, faults: DataFrame, circuit: str, detects: Column) -> DataFrame:
    """Each distinct vector with each distinct fault of its circuit, and ``detects``.  A circuit's vectors and faults bound it."""
    return vectors.distinct().join(faults.distinct(), circuit).withColumn("detected", detects)


def other_rows(df: DataFrame, group: str, key: str, ordered: bool = True) -> DataFrame:
    """Pairs of different rows of a group, whose few rows bound it: both orders, or each pair once.  The second row's columns
    have the prefix ``other_``."""
    other = df.select(group, *(F.col(c).alias(f"other_{c}") for c in df.columns if c != group))
    apart = F.col(key) != F.col(f"other_{key}") if ordered else F.col(key) < F.col(f"other_{key}")
    return df.join(other, group).where(apart)


def with_reuse(wanted: DataFrame, prior: DataFrame, keys: list[str], fresh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prior results where there are any (``reused``), else what ``fresh`` makes of the rows without one."""
    old = wanted.join(prior, keys).withColumn("reused", F.lit(True))
    new = fresh(wanted.join(prior, keys, "left_anti")).withColumn("reused", F.lit(False))
    return old.unionByName(new)


def known_on_both(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str) -> DataFrame:
    """Rows of two scored lists by key, never by position, that both sides know."""
    return left.select(*keys, left_value).join(right.select(*keys, right_value), keys).where(F.col(left_value).isNotNull() & F.col(right_value).isNotNull())


def assigned_or(df: DataFrame, manifest: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """``column`` from the manifest, computed where the manifest does not have the key."""
    held = manifest.select(F.col(key), F.col(column).alias("__held"))
    return df.join(held, key, "left").withColumn(column, F.coalesce("__held", default)).drop("__held")


def renamed_keys(df: DataFrame, assignment: str, names: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """A map column with its keys renamed by a table (old, new); keys without a name stay."""
    each = df.select(key, F.explode(assignment).alias(old, "__value")).join(names, old, "left")
    back = each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(new, old), "__value")))).alias(assignment))
    return df.drop(assignment).join(back, key, "left")


def selected(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in this order; Unmet names those that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise Unmet(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def slot_report(slots: DataFrame, problems: DataFrame, keys: list[str], slot: str, expected: int | None = None) -> DataFrame:
    """Per problem: rows, repeated slots, whether slots are 0 to n - 1 (n: ``expected``, else the rows)."""
    own = slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(slot).alias("n_slots"), F.min(slot).alias("__a"), F.max(slot).alias("__b"))
    n = F.lit(expected) if expected is not None else F.col("n_rows")
    out = problems.select(*keys).distinct().join(own, keys, "left")
    full = (F.col("n_slots") == n) & (F.col("n_rows") == n) & (F.col("__a") == 0) & (F.col("__b") == n - 1)
    return out.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("n_rows") - F.col("n_slots"), F.lit(0)).alias("n_repeated"), F.coalesce(full, F.lit(False)).alias("complete"))


def require_slots(slots: DataFrame, problems: DataFrame, keys: list[str], slot: str, expected: int | None = None) -> DataFrame:
    """The slots, if each belongs to a problem and every problem has its slots 0 to n - 1 once; else Unmet."""
    _refuse(slots.join(problems, keys, "left_anti").select(*keys), "slots of no problem")
    _refuse(slot_report(slots, problems, keys, slot, expected).where("not complete").select(*keys), "incomplete")
    return slots


def require_layout(size: int, generations: int, per_device: int, world: int) -> None:
    """Complete groups without padding: an evaluation of size * generations rows fills its batches, each of whole groups."""
    batch = per_device * world
    if min(size, generations, per_device, world) < 1 or batch % generations or size * generations % batch:
        raise Unmet(f"{size} x {generations} rows don't fill batches of {batch}")


def one_identity(df: DataFrame, group: str, identity: str) -> DataFrame:
    """(group, identity), which must be one value in each group."""
    own = df.groupBy(group).agg(F.countDistinct(identity).alias("n"), F.min(identity).alias(identity))
    _refuse(own.where("n <> 1").select(group), "not one identity")
    return own.select(group, identity)


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: how many rows were taken away or added, and in how many each immutable column differs."""
    b = before.select(key, F.struct(*columns).alias("__b"))
    both = b.join(after.select(key, F.struct(*columns).alias("__a")), key, "full")
    pair = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.agg(
        F.count_if(F.col("__a").isNull()).alias("n_removed"), F.count_if(F.col("__b").isNull()).alias("n_added"),
        *(F.count_if(pair & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))).alias(c) for c in columns),
    )
