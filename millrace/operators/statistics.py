"""Grouped statistics of outcomes: micro and macro means, strata, box plots, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import unit_interval
from ..functions.numbers import numeric_bin, pass_at_k, probability_bin
from ..functions.signals import difficulty_class
from .records import ranked


def box_statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one row), minimum, quartiles with linear interpolation, maximum."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("minimum"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("maximum"),
    )


def micro_macro(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """One row: micro (mean of rows) and macro (mean of outer means of inner means), with the counts."""
    problems = df.groupBy(outer, inner).agg(F.avg(value).alias("p"), F.sum(value).alias("s"), F.count(value).alias("k"))
    circuits = problems.groupBy(outer).agg(F.avg("p").alias("c"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))
    return circuits.agg(
        (F.sum("s") / F.sum("k")).alias("micro"), F.avg("c").alias("macro"), F.sum("n").alias("n_problems"), F.count(F.lit(1)).alias("n_circuits")
    )


def stratified_report(df: DataFrame, dimensions: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """The same aggregates for each label of each dimension and overall.  Rows are partially combined before the shuffle,
    per task one row a label, so the explosion never leaves the task."""
    labels = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("label")), *(F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("label")) for d, c in dimensions.items()))
    return df.withColumn("__stratum", F.explode(labels)).groupBy(F.col("__stratum.dimension").alias("dimension"), F.col("__stratum.label").alias("label")).agg(*(c.alias(n) for n, c in measures.items()))


def top_shares(df: DataFrame, key: str, tops: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Keys by count: how many, rows, the lower-middle count of the descending list, and the largest keys' share of rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
    first = counts.orderBy(F.desc("n"), F.asc(key)).limit(max(tops))
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc(key)))
    shares = first.withColumn("r", place).agg(*(F.sum(F.when(F.col("r") <= t, F.col("n"))).alias(f"s{t}") for t in tops))
    # count of counts: small, so the middle of the list needs no global sort of keys
    grades = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("n"))))
    middle = grades.crossJoin(totals).where(F.col("upto") > F.floor(F.col("n_keys") / 2)).agg(F.max("n").alias("middle_count"))
    return totals.crossJoin(shares).crossJoin(middle).select("n_keys", "n_rows", "middle_count", *((F.col(f"s{t}") / F.col("n_rows")).alias(f"top{t}_share") for t in tops))


def group_diagnostics(df: DataFrame, group: str, score: str, detected: str, graded: list[str]) -> DataFrame:
    """Of groups of scored rows: shares with one score, all failing, all passing, solved; detections, spread; and of the all-failing
    groups the share in which a graded component still differs.  Null and not-a-number count as 0."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    hit = F.when(clean(detected) >= 1, 1.0).otherwise(0.0)
    spread = lambda c: F.max(clean(c)) - F.min(clean(c))
    varies = F.lit(False)
    for c in graded:
        varies = varies | (spread(c) > 1e-8)
    g = df.groupBy(group).agg(spread(score).alias("range"), F.stddev_pop(clean(score)).alias("sd"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), varies.alias("varies"))
    share = lambda c: F.avg(c.cast("double"))
    fail = F.col("hits") == 0
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), share(F.col("range") <= 1e-8).alias("degenerate"), share(fail).alias("all_fail"), share(F.col("hits") == F.col("n")).alias("all_pass"), share(F.col("hits") >= 1).alias("solved"),
        (F.sum("hits") / F.sum("n")).alias("pass_at_1"), F.avg("hits").alias("mean_detected"), F.avg("sd").alias("mean_std"), F.avg("range").alias("mean_range"), F.avg(F.when(fail, F.col("varies").cast("double"))).alias("rescuable"),
    )


def difficulty_strata() -> dict[str, Column]:
    """The dimensions of a difficulty report over rows of ``circuit.testability``: sixteen labels and four of their crosses."""
    small, costs = [0, 1, 2, 4, 8, 16], [1, 2, 4, 8, 16, 32, 64]
    counts = [0, 1, 2, 4, 8, 16, 32, 64, 128]
    kind = F.concat(F.lit("sa"), F.col("stuck_at").cast("string"))
    zero = F.when(F.col("status") == "ok", None).when(F.col("status").startswith("rejected"), None).otherwise(F.col("status"))
    known = F.when(F.col("status").startswith("rejected"), "rejected").otherwise("ok")
    out = {
        "circuit": F.col("design"), "fault_type": kind, "fault_location": F.concat_ws(":", "design", "net"), "location_class": F.col("location"),
        "difficulty": difficulty_class(known, zero, F.col("p_detect")), "site_depth": numeric_bin(F.col("site_depth"), small), "circuit_depth": numeric_bin(F.col("circuit_depth"), small),
        "activation_cost": numeric_bin(F.col("activation_cost"), costs), "observability_cost": numeric_bin(F.col("co"), [0, *costs]), "scoap_cost": numeric_bin(F.col("scoap_cost"), costs),
        "gate_count": numeric_bin(F.col("gate_count"), [*costs, 128, 256]), "num_inputs": numeric_bin(F.col("num_inputs"), counts), "num_outputs": numeric_bin(F.col("num_outputs"), counts),
        "distance_to_output": numeric_bin(F.col("distance"), small), "activation_probability": probability_bin(F.col("p_active")), "conditional_observability": probability_bin(F.col("p_observe")),
    }
    crosses = {"num_inputs_difficulty": ("num_inputs", "difficulty"), "num_outputs_difficulty": ("num_outputs", "difficulty"), "input_output_counts": ("num_inputs", "num_outputs"), "type_location_difficulty": ("fault_type", "location_class", "difficulty")}
    return out | {name: F.concat_ws("|", *(out[x] for x in parts)) for name, parts in crosses.items()}


def median_of_seeds(df: DataFrame, config: str, seed: str, order: str, metric: str, least_seeds: int) -> DataFrame:
    """Per configuration the median over distinct seeds (the last row of a seed counts), with at least ``least_seeds``."""
    last = df.groupBy(config, seed).agg(F.max_by(metric, order).alias("m"))
    return last.groupBy(config).agg(F.percentile("m", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_seeds")).where(F.col("n_seeds") >= least_seeds)


def bootstrap_interval(df: DataFrame, key: str, value: str, repeats: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of a mean by Poisson weights: each row draws its weight in each repeat from the seeded digest of its own
    key, so no row moves and reruns agree; sums by repeat are combined in each task, and the 2.5th and 97.5th percentiles
    taken.  A statistically equivalent form of resampling with replacement.  Work is rows times repeats: give it one row a
    circuit."""
    u = unit_interval(seed, F.concat_ws(":", F.col("rep").cast("string"), F.col("__key").cast("string")))
    weight, total, step = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):
        total += step
        weight = weight + F.when(u >= total, 1).otherwise(0)
        step /= k + 1
    keyed = df.select(F.col(value).alias("v"), F.col(key).alias("__key")).where(F.col("v").isNotNull())
    reps = keyed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("w", weight)
    means = reps.groupBy("rep").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("m").alias("repeats"))


def lift_over_random(df: DataFrame, circuit: str, n: str, c: str, p: str, k: int) -> DataFrame:
    """One row: mean of 1 - (1 - p)^k, the mean lift of pass@k over it, and the mean of circuit means of the lift."""
    rows = df.select(F.col(circuit), pass_at_k(F.col(n), F.col(c), k).alias("d"), (1 - F.pow(1 - F.col(p), F.lit(k))).alias("r")).where("d is not null and r is not null")
    own = rows.groupBy(circuit).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum("d").alias("d"), F.avg(F.col("d") - F.col("r")).alias("gap"))
    return own.agg(F.sum("n").alias("n_paired"), (F.sum("r") / F.sum("n")).alias(f"random_{k}"), ((F.sum("d") - F.sum("r")) / F.sum("n")).alias("lift"), F.avg("gap").alias("macro_lift"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): each label gets the share of its mirror in the list by count, standardised and shifted by the range.
    Labels, not rows, are ordered."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    up = ranked(counts, [F.desc("n"), F.asc(label)], "__up")
    total = up.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    known = up.crossJoin(F.broadcast(total))
    mirror = known.select((F.col("__k") - F.col("__up") + 1).alias("__up"), (F.col("n") / F.col("__t")).alias("__w"))
    paired = up.join(mirror, "__up")
    moments = paired.agg(F.avg("__w").alias("__m"), F.stddev_pop("__w").alias("__s"), F.max("__w").alias("__b"), F.min("__w").alias("__a"))
    weight = (F.col("__w") - F.col("__m") + F.col("__b") - F.col("__a")) / (F.col("__s") + 0.001)
    return paired.crossJoin(F.broadcast(moments)).select(label, "n", weight.alias("weight"))


def output_baselines(df: DataFrame, group: str, bits: str, width: int) -> DataFrame:
    """(group, exact, n_patterns, per_bit, n_variable) of bit strings of one width."""
    patterns = df.groupBy(group, bits).agg(F.count(F.lit(1)).alias("n"))
    ones = [(F.sum(F.col("n") * F.substring(bits, i + 1, 1).cast("int")) / F.sum("n")) for i in range(width)]
    own = patterns.groupBy(group).agg((F.max("n") / F.sum("n")).alias("exact"), F.count(F.lit(1)).alias("n_patterns"), F.array(*ones).alias("__a"))
    better = F.aggregate("__a", F.lit(0.0), lambda acc, a: acc + F.greatest(a, 1 - a)) / width
    return own.select(group, "exact", "n_patterns", better.alias("per_bit"), F.size(F.filter("__a", lambda a: (a > 0) & (a < 1))).cast("long").alias("n_variable"))


def most_common(counts: DataFrame, group: str, item: str, n: str, k: int, high: int) -> DataFrame:
    """(group, n_unique, top, n_high): distinct items, the k most frequent as ``item n``, and how many have ``high`` or more."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), item))
    first = counts.withColumn("__r", place).where(F.col("__r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("__r", F.concat_ws(" ", item, F.col(n).cast("string")).alias("s"))))
    top = first.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("top"))
    return counts.groupBy(group).agg(F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col(n) >= high).alias("n_high")).join(top, group)


def split_audit(df: DataFrame, split: str, train: str, identities: dict[str, str]) -> DataFrame:
    """(split, n_rows, n_<name>, <name>_in_train): distinct identities of each split, and those that the training split has too."""
    out = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    for name, column in identities.items():
        own = df.select(split, F.col(column).alias("__i")).distinct()
        also = own.groupBy("__i").agg(F.max(F.when(F.col(split) == train, 1).otherwise(0)).alias("__t"))
        shares = own.join(also, "__i").groupBy(split).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("__t").alias(f"{name}_in_train"))
        out = out.join(shares, split)
    return out


def consumed(per_device: Column, world: Column, accumulation: Column, generations: Column, step: Column, launched: Column) -> list[Column]:
    """sequences, prompts_per_step and cumulative: rows a step takes, the prompts among them, prompts taken since the start."""
    sequences = per_device * world * accumulation
    prompts = F.greatest(F.lit(1), F.floor(sequences / F.greatest(F.lit(1), generations)))
    return [sequences.cast("long").alias("sequences"), prompts.cast("long").alias("prompts_per_step"), (launched + step * prompts).cast("long").alias("cumulative")]


def skip_counter(text: Column, name: str = "cumulative_skip_buffer_size") -> Column:
    """The counter in a saved JSON summary, at least 0; null where there is none."""
    value = F.get_json_object(text, f"$.{name}").try_cast("long")
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("long"), value))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, n, k, mean, median, std, p95): rows in equal bins, min(50, max(10, half the distinct values)), beside the statistics of all."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 2)
    totals = df.agg(
        F.count(value).alias("k"), F.round(F.avg(value), 2).alias("mean"), q(0.5).alias("median"), F.round(F.stddev_pop(value), 2).alias("std"), q(0.95).alias("p95"),
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.countDistinct(value).alias("__d"),
    )
    totals = totals.withColumn("__bins", F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("__d") / 2)))).drop("__d")
    place = F.floor((F.col(value) - F.col("__lo")) * F.col("__bins") / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)))
    binned = df.crossJoin(F.broadcast(totals)).withColumn("bin", F.least(F.col("__bins") - 1, place).cast("long"))
    return binned.groupBy("bin", "k", "mean", "median", "std", "p95").agg(F.count(F.lit(1)).alias("n"))
