"""Ranking metrics, group-relative advantages, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage_table


def average_precision(df: DataFrame, group: list[str], score: str, label: str, order: list[str]) -> DataFrame:
    """Mean of cumulative precision at positives, by score down, ties by ``order``; null without positives."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *order)
    hits = F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__p", F.when(F.col(label) == 1, hits / F.row_number().over(w)))
    return out.groupBy(*group).agg(F.avg("__p").alias("average_precision"), F.sum(label).alias("n_positive"))


def roc_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; null with one class only.

    Rows are first counted by score (so ties, however many, are one row); running negatives then give the pairs.
    """
    by_score = df.groupBy(*group, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    wins = by_score.withColumn("w", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2))
    return wins.groupBy(*group).agg(F.sum("w").alias("w"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative")).select(
        *group, F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("w") / (F.col("n_positive") * F.col("n_negative"))).alias("auc"), "n_positive", "n_negative"
    )


def iou(predicted: Column, actual: Column) -> Column:
    """Aggregate: rows in both over rows in either; 1 where there are none."""
    either = F.count(F.when(predicted | actual, 1))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.count(F.when(predicted & actual, 1)) / either)


def z_advantages(df: DataFrame, group: str, objectives: dict[str, float], epsilon: float = 1e-4) -> DataFrame:
    """``advantage``: each objective's z-score in its group (sample deviation; 0 with under two values or a deviation up to
    epsilon), weighted and summed, then z-scored over all rows that have an objective."""
    w = Window.partitionBy(group)
    total, known = F.lit(0.0), F.lit(False)
    for name, weight in objectives.items():
        sd, mean = F.stddev_samp(name).over(w), F.avg(name).over(w)
        total = total + F.when((sd > epsilon) & F.col(name).isNotNull(), weight * (F.col(name) - mean) / (sd + epsilon)).otherwise(0.0)
        known = known | F.col(name).isNotNull()
    out = df.withColumn("group_score", total).withColumn("__known", known)
    moments = out.where("__known").agg(F.avg("group_score").alias("__m"), F.stddev_samp("group_score").alias("__s"))
    z = (F.col("group_score") - F.col("__m")) / (F.col("__s") + epsilon)
    return out.crossJoin(F.broadcast(moments)).withColumn("advantage", F.when(F.col("__known") & (F.col("__s") > 0), z).otherwise(0.0)).drop("__known", "__m", "__s")


def relative_advantages(df: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> DataFrame:
    """(r - mean) / (population deviation + epsilon) in the group; 0 where the deviation is at most epsilon."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(sd > epsilon, (F.col(reward) - F.avg(reward).over(w)) / (sd + epsilon)).otherwise(0.0))


def spread_subset(df: DataFrame, group: str, score: str, key: str, retained: int) -> DataFrame:
    """The ``retained`` rows of each group with the largest population variance: always the top k and the bottom rest, for
    some k; equal variances prefer the most balanced k, then the larger.  ``keep`` marks them."""
    w = Window.partitionBy(group)
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    r = finite.withColumn("__up", F.row_number().over(w.orderBy(F.desc(score), key))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= retained)
    r = r.withColumn("__down", F.col("__n") - F.col("__up") + 1)
    tried = r.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(retained)))).where((F.col("__up") <= F.col("__k")) | (F.col("__down") <= retained - F.col("__k")))
    spread = tried.groupBy(group, "__k").agg(F.var_pop(score).alias("__v"))
    best = spread.groupBy(group).agg(F.max_by("__k", F.struct(F.round("__v", 9), -F.abs(2 * F.col("__k") - retained), "__k")).alias("__best"))
    return r.join(best, group).withColumn("keep", (F.col("__up") <= F.col("__best")) | (F.col("__down") <= retained - F.col("__best"))).drop("__up", "__down", "__n", "__best")


def coverage_curve(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """Distinct items after each pattern: an item counts where it first occurs."""
    first = df.groupBy(group, item).agg(F.min(order).alias(order)).groupBy(group, order).agg(F.count(F.lit(1)).alias("fresh"))
    steps = df.select(group, order).distinct().join(first, [group, order], "left")
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(group, order, F.sum(F.coalesce("fresh", F.lit(0))).over(w).alias("covered"))


def detection_fractions(universe: DataFrame, hits: DataFrame, fault: str, vector: str, times: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Shares of the universe's faults that at least 1, 2, ... distinct vectors detect; undetected ones stay in."""
    counts = hits.groupBy(fault).agg(F.countDistinct(vector).alias("k"))
    full = universe.select(fault).distinct().join(counts, fault, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return full.agg(F.count(F.lit(1)).alias("n_faults"), *(F.avg((F.col("k") >= t).cast("double")).alias(f"n_detect_{t}") for t in times))


def greedy_cover(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """Patterns picked one by one for most new items (the lower order among equals) until all are covered: step, order.

    Each step needs the one before it, so it runs in one grouped function per group; memory is one group's distinct
    (pattern, item) pairs as integers, reduced before they are gathered.  Null items and patterns count for nothing.

    What patterns would add only falls.  So they are picked level by level from the largest gain down, each level in rising
    order, and an item's patterns are told once, when it is covered: time follows the pairs, not steps times patterns.
    """
    kind = dict(df.dtypes)

    def cover(rows):
        import numpy as np
        import pandas as pd

        orders, at = np.unique(rows[order].to_numpy(), return_inverse=True)
        of, items = pd.factorize(rows[item], use_na_sentinel=False)
        by_pattern, by_item = np.argsort(at, kind="stable"), np.argsort(of, kind="stable")
        gain, width = np.bincount(at), np.bincount(of)
        ends, item_ends = np.cumsum(gain), np.cumsum(width)
        starts, item_starts = (ends - gain).tolist(), (item_ends - width).tolist()
        ends, item_ends = ends.tolist(), item_ends.tolist()
        own, patterns = of[by_pattern], at[by_item]
        covered, out = np.zeros(len(items), bool), []
        while most := gain.max():
            for p in np.flatnonzero(gain == most).tolist():
                if gain[p] < most:
                    continue
                mine = own[starts[p] : ends[p]]
                for i in mine[~covered[mine]].tolist():
                    gain[patterns[item_starts[i] : item_ends[i]]] -= 1
                covered[mine] = True
                out.append(p)
        return pd.DataFrame({group: rows[group].iloc[0], "step": np.arange(1, len(out) + 1), order: orders[out]}, columns=[group, "step", order])

    pairs = df.select(group, order, item).where(F.col(order).isNotNull() & F.col(item).isNotNull()).distinct()
    return pairs.groupBy(group).applyInPandas(cover, f"{group} {kind[group]}, step int, {order} {kind[order]}")


def top_k(df: DataFrame, metric: str, k: int, config: str, ties: list[str]) -> DataFrame:
    """The k best distinct configurations, each by its best row; ranks from 1."""
    best = df.where(F.col(metric).isNotNull()).groupBy(config).agg(F.max_by(F.struct(*df.columns), F.struct(metric, *(-F.col(t) for t in ties))).alias("r")).select("r.*")
    top = best.orderBy(F.desc(metric), *ties).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), *ties)))


def retrieval(queries: DataFrame, targets: DataFrame, key: str, slots: str, vector: str, block: int = 2048) -> DataFrame:
    """One row: recall@1, recall@min(5, N) and mean reciprocal rank of N matched pairs, from queries to targets, back, and their
    means.  A query has several vectors (``slots``), its similarity is the greatest product of one with the target's vector,
    rounded to nine digits; equal ones are ranked by key.

    All queries meet all targets, block by block: a task holds one block of each and gives, for each of their rows, how many of the
    other block's come before its own partner.  Those counts add up to the ranks; no similarity leaves its task.
    """
    own_vector = targets.select(key, F.col(vector).alias("__t"))
    dot = lambda s: F.aggregate(F.zip_with(s, "__t", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    pairs = queries.join(own_vector, key)
    own = pairs.select(key, "__t", F.col(slots).alias("__slots"), F.round(F.array_max(F.transform(slots, dot)), 9).alias("__own"))
    own = stage_table(own, "retrieval")
    n = own.count()
    blocks = max(1, -(-n // block))
    at = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    kind = dict(own.dtypes)[key]
    left = own.select(key, "__slots", "__own", at.alias("__q"), F.explode(every).alias("__b"))
    right = own.select(key, "__t", "__own", F.explode(every).alias("__q"), at.alias("__b"))

    def compare(q, t):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(t):
            return pd.DataFrame({"side": pd.Series([], dtype=str), key: pd.Series([], dtype=q[key].dtype), "above": pd.Series([], dtype="int64")})
        other = np.stack(t["__t"].to_numpy()).astype(np.float64)
        widest = max(map(len, q["__slots"]))
        slot = lambda k: np.stack([np.asarray(x[min(k, len(x) - 1)], np.float64) for x in q["__slots"]])
        scores = np.round(np.max([slot(k) @ other.T for k in range(widest)], axis=0), 9)
        qi, ti = q[key].to_numpy(), t[key].to_numpy()
        mine, theirs = q["__own"].to_numpy()[:, None], t["__own"].to_numpy()[None, :]
        rows = ((scores > mine) | (scores == mine) & (ti[None, :] < qi[:, None])).sum(1)
        columns = ((scores > theirs) | (scores == theirs) & (qi[:, None] < ti[None, :])).sum(0)
        return pd.DataFrame({"side": ["q"] * len(qi) + ["t"] * len(ti), key: [*qi, *ti], "above": [*rows, *columns]})

    counted = left.groupBy("__q", "__b").cogroup(right.groupBy("__q", "__b")).applyInPandas(compare, f"side string, {key} {kind}, above bigint")
    ranks = counted.groupBy("side", key).agg((F.sum("above") + 1).alias("r"))
    share = lambda side, c: F.avg(F.when(F.col("side") == side, c.cast("double")))
    names = {"recall_1": F.col("r") <= 1, "recall_5": F.col("r") <= min(5, n), "mrr": 1 / F.col("r")}
    out = ranks.agg(*(share(side, c).alias(f"{way}_{name}") for side, way in (("q", "forward"), ("t", "backward")) for name, c in names.items()))
    return out.select("*", *(((F.col(f"forward_{name}") + F.col(f"backward_{name}")) / 2).alias(f"mean_{name}") for name in names))


def coverage_bounds(df: DataFrame, circuit: str, fault: str, detected: str) -> DataFrame:
    """Per circuit the shares of faults that are surely detected and that may be: unknown (null) cells count in the upper one."""
    own = df.groupBy(circuit, fault).agg(F.coalesce(F.bool_or(detected), F.lit(False)).alias("lo"), F.bool_or(F.coalesce(detected, F.lit(True))).alias("hi"))
    return own.groupBy(circuit).agg(F.count(F.lit(1)).alias("n_faults"), F.avg(F.col("lo").cast("int")).alias("low"), F.avg(F.col("hi").cast("int")).alias("high"))


def survivors(df: DataFrame, group: str, key: str, quality: list[str], score: str, vector: str, size: int) -> DataFrame:
    """Of each group's distinct vectors the best by (quality, score), then, until there are ``size``, the one of best quality, of
    those the farthest (share of places) from the kept ones, of those the best score: (group, place, key).

    Each choice needs the ones before, so a group's candidates are one function's; equal vectors are reduced before.
    """
    kind = dict(df.dtypes)
    best = df.groupBy(group, vector).agg(F.max_by(F.struct(*quality, score, key), F.struct(*quality, score, -F.col(key))).alias("r")).select(group, vector, "r.*")

    def choose(rows):
        import pandas as pd

        pool = sorted(rows.itertuples(index=False), key=lambda r: (*(getattr(r, q) for q in quality), getattr(r, score), -getattr(r, key)), reverse=True)
        kept = [pool.pop(0)]
        while pool and len(kept) < size:
            apart = lambda r: min(sum(a != b for a, b in zip(getattr(r, vector), getattr(k, vector))) / max(1, len(getattr(r, vector))) for k in kept)
            following = max(pool, key=lambda r: (*(getattr(r, q) for q in quality), apart(r), getattr(r, score)))
            kept.append(following)
            pool.remove(following)
        return pd.DataFrame([(getattr(r, group), i + 1, getattr(r, key)) for i, r in enumerate(kept)], columns=[group, "place", key])

    return best.groupBy(group).applyInPandas(choose, f"{group} {kind[group]}, place int, {key} {kind[key]}")
