"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) take the weights in turn and share ``total_share`` of all words; a target
above ``most_copies`` times its source's words stops there and its excess is shared again by weight.

Rates: among all document rates r in (0, most_copies), those of least entropy distance from the middle rate whose words
meet the target of each source are exponentially tilted: r = most_copies * e^t / (1 + e^t), t = dual * size / mean size,
with one dual variable a source.  The dual is convex; each Newton iteration is one aggregate over all sources at once, on a
table of (source, size, documents), kept inside a shrinking bracket.

Copies: a document takes the rounded-down rate, or one more where hash(id) falls below the fraction.  Rounding is steered
per source and size class (powers of two, large first) by shifting the threshold so that the class's words, with what
larger classes left over, come nearest their expectation; thresholds are found on a histogram of at most BINS bins a class.
Everything depends on ids and sizes alone, so reruns agree.

Sizes: words ``[^\\x20\\x09-\\x0D]+``; null texts have none, take nothing and keep a row.  Equal ids (repeated rows, null
ids) move together.  Empty tables give empty results.  Only the id, text and source columns are read.  Sources are
corpora with a name: their totals (one row a source) come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, own_columns, stage_table

BINS = 4096


def words_in(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most_copies: float = 2) -> dict[str | None, float]:
    """Words that each source should give.

    The first capped source is found, its cap taken from the total and the rest shared again, until none is above; as the
    share of one unit of weight only grows, sources are capped in the order of cap over weight.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_weight, out = total_share * sum(sizes.values()), float(sum(weight.values())), {}
    rest = sorted(names, key=lambda s: most_copies * sizes[s] / weight[s])
    while rest and left * weight[rest[0]] / open_weight >= most_copies * sizes[rest[0]]:
        s = rest.pop(0)
        out[s] = float(most_copies * sizes[s])
        left, open_weight = left - out[s], open_weight - weight[s]
    return out | {s: left * weight[s] / open_weight for s in rest}


def _params(spark, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    small = len(rows) <= BROADCAST_ROWS and sum(len(str(x)) for r in rows for x in r) <= BROADCAST_BYTES
    return F.broadcast(table) if small else table


def rate(dual: Column, size: Column, scale: Column, most_copies: float) -> Column:
    t = F.least(F.greatest(dual * size / scale, F.lit(-500.0)), F.lit(500.0))
    return F.lit(float(most_copies)) / (F.lit(1.0) + F.exp(-t))


def duals(sizes: DataFrame, goals: list[tuple], most_copies: float, iterations: int = 60, tolerance: float = 1e-7) -> dict[int, float]:
    """The dual variable of each source: goals has (source number, target, words, documents); sizes: s, size, n."""
    spark, open_goals, found = sizes.sparkSession, {}, {}
    for s, target, words, docs in goals:
        if target >= most_copies * words * (1 - 1e-12):
            found[s] = math.inf
        else:
            open_goals[s] = [0.0, -math.inf, math.inf, target, words / docs, math.inf]
    for _ in range(iterations):
        if not open_goals:
            break
        now = _params(spark, [(s, x[0], x[4]) for s, x in open_goals.items()], "s int, dual double, scale double")
        size = F.col("size").cast("double")
        r = rate(F.col("dual"), size, F.col("scale"), most_copies)
        sums = (
            sizes.join(now, "s")
            .groupBy("s")
            .agg(
                F.sum(F.col("n") * size * r).alias("words"),
                F.sum(F.col("n") * size * size / F.col("scale") * r * (1 - r / most_copies)).alias("slope"),
            )
            .collect()
        )
        for row in sums:
            x = open_goals[row["s"]]
            gap = x[5] = row["words"] - x[3]
            if abs(gap) <= tolerance * max(1.0, x[3]):
                found[row["s"]] = open_goals.pop(row["s"])[0]
                continue
            x[1 if gap < 0 else 2] = x[0]
            step = x[0] - gap / row["slope"] if row["slope"] > 0 else math.nan
            low, high = x[1], x[2]
            if not (low < step < high) or abs(step) > 1e6:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * x[0] + 1 if gap < 0 else 2 * x[0] - 1)
            x[0] = step
    # a bracket at the limit of floating point is as near as it gets
    if far := [s for s, x in open_goals.items() if abs(x[5]) > 1e-4 * max(1.0, x[3]) and x[2] - x[1] > 1e-9 * max(1.0, abs(x[0]))]:
        raise RuntimeError(f"no rates meet the targets of {len(far)} sources after {iterations} iterations")
    return found | {s: x[0] for s, x in open_goals.items()}


def _flip() -> Column:
    """Where in [0, 1] a document's threshold lies: it takes the larger count of copies if that is below the class's."""
    unit = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (unit - F.col("fraction") + 1) / 2


def plan_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    total_share: float = 1.5,
    most_copies: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, taken (= copies * size)."""
    measured = stage_table(
        own_columns(docs, id=id_col, source=source_col, text=text_col).select("id", F.col("source").cast("string").alias("source"), words_in("text").alias("size")),
        "sizes",
    )
    return _plan(measured, weights, total_share, most_copies).withColumnRenamed("id", id_col)


def source_parameters(measured: DataFrame, weights: tuple[float, ...], total_share: float, most_copies: int) -> DataFrame:
    """One row a source: source, s (its number), source_size, target, scale, dual.  measured: source, size."""
    spark = measured.sparkSession
    totals = measured.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("size") > 0, 1)).alias("full")).collect()
    sizes = {r["source"]: r["words"] for r in totals}
    goal = targets(sizes, weights, total_share, most_copies)
    number = {name: i for i, name in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    rows = [(number[r["source"]], goal[r["source"]], r["words"], r["full"]) for r in totals if r["words"]]
    names = _params(spark, [(name, i) for name, i in number.items()], "source string, s int")
    pairs = measured.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    pairs = stage_table(pairs.join(names, pairs["source"].eqNullSafe(names["source"])).select("s", "size", "n"), "pairs")
    dual = duals(pairs, rows, most_copies)
    full = {r["source"]: r["full"] for r in totals}
    return spark.createDataFrame(
        [(name, i, sizes[name], float(goal[name]), sizes[name] / max(1, full[name]) or 1.0, float(dual.get(i, 0.0))) for name, i in number.items()],
        "source string, s int, source_size long, target double, scale double, dual double",
    )


def _rated(measured: DataFrame, parameters: DataFrame, most_copies: int) -> DataFrame:
    """``measured`` with s, source_size, target, rate, fraction, floor, class, flip."""
    p = parameters.withColumnRenamed("source", "__source")
    rated = measured.join(broadcast_if_small(p), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    exact = F.when(F.col("dual") == F.lit(math.inf), F.lit(float(most_copies))).otherwise(rate(F.col("dual"), F.col("size").cast("double"), F.col("scale"), most_copies))
    rated = rated.withColumn("rate", exact)
    rated = rated.withColumn("floor", F.floor("rate").cast("long"))
    rated = rated.withColumn("fraction", F.col("rate") - F.col("floor"))
    rated = rated.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int"))
    return rated.withColumn("flip", _flip())


def thresholds(rated: DataFrame) -> DataFrame:
    """(s, class, cut) such that a document of the class takes one copy more than its floor where flip < cut."""
    bins = (
        rated.where("size > 0")
        .groupBy("s", "class", F.least(F.floor(F.col("flip") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin"))
        .agg(F.sum(F.col("size") * F.col("fraction")).alias("wanted"), F.sum(F.when(F.col("fraction") > 0, F.col("size")).otherwise(0)).alias("gain"))
    )

    def steer(rows):
        import pandas as pd

        rows = rows.sort_values(["class", "bin"], ascending=[False, True])
        out, carried = [], 0.0
        for c, own in rows.groupby("class", sort=False):
            carried += own["wanted"].sum()
            sums = own["gain"].cumsum().to_numpy()
            best, taken, cut = abs(carried), 0, 0.0
            for total, b in zip(sums, own["bin"]):
                if abs(carried - total) < best:
                    best, taken, cut = abs(carried - total), total, (b + 1) / BINS
            carried -= taken
            out.append((int(rows["s"].iloc[0]), int(c), float(cut)))
        return pd.DataFrame(out, columns=["s", "class", "cut"])

    return bins.groupBy("s").applyInPandas(steer, "s int, class int, cut double")


def _plan(measured: DataFrame, weights: tuple[float, ...], total_share: float, most_copies: int) -> DataFrame:
    parameters = source_parameters(measured, weights, total_share, most_copies)
    rated = _rated(measured, parameters, most_copies)
    cuts = stage_table(thresholds(rated), "cuts")
    decided = rated.join(broadcast_if_small(cuts), ["s", "class"], "left")
    more = (F.col("fraction") > 0) & (F.least(F.floor(F.col("flip") * BINS), F.lit(BINS - 1)) < F.round(F.col("cut") * BINS))
    decided = decided.withColumn("copies", F.col("floor") + F.when(more & (F.col("size") > 0), 1).otherwise(0))
    return decided.select("id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    total_share: float = 1.5,
    most_copies: int = 2,
) -> DataFrame:
    """The mix itself: rows of ``docs``, with their columns, each as often as its copies; decided in place, no join on ids."""
    columns = docs.columns
    hidden = {c: f"__doc_{i}" for i, c in enumerate(columns)}
    renamed = docs.toDF(*hidden.values()).withColumns({"id": F.col(hidden[id_col]), "source": F.col(hidden[source_col]).cast("string"), "size": words_in(hidden[text_col])})
    measured = stage_table(renamed.select("id", "source", "size"), "sizes")
    parameters = source_parameters(measured, weights, total_share, most_copies)
    cuts = stage_table(thresholds(_rated(measured, parameters, most_copies)), "cuts")
    decided = _rated(renamed, parameters, most_copies).join(broadcast_if_small(cuts), ["s", "class"], "left")
    more = (F.col("fraction") > 0) & (F.least(F.floor(F.col("flip") * BINS), F.lit(BINS - 1)) < F.round(F.col("cut") * BINS))
    copies = F.col("floor") + F.when(more & (F.col("size") > 0), 1).otherwise(0)
    decided = decided.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))) ).where(F.col("__copy") <= copies)
    return decided.select(*(F.col(hidden[c]).alias(c) for c in columns))
