"""Numeric columns: guarded ratios, intervals, pass@k, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product; 1 where fewer than k fail, null where k > n."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def wilson(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """95 % interval of a share, kept in [0, 1]; nulls without trials."""
    p = successes / trials
    d = 1 + z * z / trials
    middle = (p + z * z / (2 * trials)) / d
    half = z / d * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return F.when(trials > 0, F.greatest(F.lit(0.0), middle - half)), F.when(trials > 0, F.least(F.lit(1.0), middle + half))


def numeric_bin(value: Column, edges: list[int]) -> Column:
    """Label of the first edge at or above the value: ``e`` or ``low..e``, ``>last``; ``unknown`` for null or infinite."""
    out = F.when(value.isNull() | (value == F.lit(float("inf"))), "unknown_or_infinite")
    low = 0
    for i, e in enumerate(edges):
        out = out.when(value <= e, str(e) if (i == 0 and e <= 0) or low == e else f"{low}..{e}")
        low = e + 1
    return out.otherwise(f">{edges[-1]}")


def probability_bin(p: Column) -> Column:
    """``unknown``, ``0`` or the half-open class of p, like ``(0.0625,0.25]``."""
    out = F.when(p.isNull(), "unknown").when(p == 0, "0")
    low = "0"
    for name in ("0.00390625", "0.0625", "0.25", "0.5", "1"):
        out = out.when(p <= float(name), f"({low},{name}]")
        low = name
    return out.otherwise("unknown")


def rounded_percentile(column: str, p: float) -> Column:
    """Percentile with linear interpolation, rounded half to even; 0 on nothing."""
    return F.coalesce(F.bround(F.percentile(column, F.lit(p)), 0).cast("long"), F.lit(0).cast("long"))


def weighted_defined(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that are defined, their weights scaled up to 1; null where none is."""
    metrics = [(F.col(name), w) for name, w in weights.items()]
    total = sum((F.when(m.isNotNull(), w).otherwise(0.0) for m, w in metrics), F.lit(0.0))
    value = sum((F.coalesce(m * w, F.lit(0.0)) for m, w in metrics), F.lit(0.0))
    return ratio(value, total)


def alignment_score(recall: Column, mrr: Column, precision: Column, loss: Column) -> Column:
    """0.45 recall + 0.25 MRR + 0.2 average precision + 0.1 exp(-loss), the loss at most 20."""
    return 0.45 * recall + 0.25 * mrr + 0.2 * precision + 0.1 * F.exp(-F.least(loss, F.lit(20.0)))


def difficulty_bits(p: Column) -> Column:
    """-log2 of a probability; null for 0."""
    return F.when(p > 0, -F.log2(p))
