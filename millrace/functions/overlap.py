"""Overlap of texts: ROUGE-1, ROUGE-2 as columns, ROUGE-L and BLEU counts in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, ngrams


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def rouge_n(reference: Column, candidate: Column, n: int) -> Column:
    """F1 of the n-grams in common, repeats counted as often as both have them; 0 where either has none."""

    def f1(grams: Column) -> Column:
        a, b = grams["a"], grams["b"]
        times = lambda all_of, g: F.size(F.filter(all_of, lambda x: x == g))
        hits = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, g: acc + F.least(times(a, g), times(b, g)))
        return F.when(hits > 0, 2.0 * hits / (F.size(a) + F.size(b))).otherwise(0.0)

    return let(F.struct(ngrams(words(reference), n).alias("a"), ngrams(words(candidate), n).alias("b")), f1)


def _tokens(text: str | None) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", (text or "").lower())


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common subsequence of words; the recurrence has no column form."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x, y):
            x, y = _tokens(x), _tokens(y)
            row = [0] * (len(y) + 1)
            for w in x:
                before = 0
                for j, v in enumerate(y):
                    before, row[j + 1] = row[j + 1], before + 1 if w == v else max(row[j], row[j + 1])
            return 2 * row[-1] / (len(x) + len(y)) if row[-1] else 0.0

        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return score(reference, candidate)


def bleu_counts(reference: Column, candidate: Column) -> Column:
    """struct of what corpus BLEU adds up: lengths, and hits and totals of 1- to 4-grams of white-space words."""

    @F.arrow_udf("struct<r: bigint, c: bigint, hits: array<bigint>, totals: array<bigint>>")
    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = (x or "").split(), (y or "").split()
            hits, totals = [], []
            for n in range(1, 5):
                grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y)]
                hits.append(sum((grams[0] & grams[1]).values()))
                totals.append(max(0, len(y) - n + 1))
            out.append({"r": len(x), "c": len(y), "hits": hits, "totals": totals})
        return pa.array(out, pa.struct([("r", pa.int64()), ("c", pa.int64()), ("hits", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))]))

    return counts(reference, candidate)


def corpus_bleu(counts: Column) -> Column:
    """Aggregate of ``bleu_counts``: BLEU in percent; an n-gram without hits counts half of one, halved at each further such n
    (exponential smoothing)."""
    add = lambda field, n: F.sum(counts[field][n - 1]).cast("double")
    r, c = F.sum(counts["r"]).cast("double"), F.sum(counts["c"]).cast("double")
    log, misses = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        misses = misses + (add("hits", n) == 0).cast("int")
        precision = F.when(add("hits", n) > 0, 100.0 * add("hits", n) / add("totals", n)).otherwise(100.0 / (F.pow(F.lit(2.0), misses) * add("totals", n)))
        log = log + F.log(precision) / 4
    brevity = F.when(c < r, F.exp(1 - r / c)).otherwise(1.0)
    return F.when((c > 0) & (add("totals", 4) > 0), brevity * F.exp(log)).otherwise(0.0)


def plain_bleu(pairs: list[tuple[str, str]]) -> float:
    """The same of a few pairs in plain Python, for tests."""
    hits, totals, r, c = [0] * 4, [0] * 4, 0, 0
    for x, y in pairs:
        a, b = x.split(), y.split()
        r, c = r + len(a), c + len(b)
        for n in range(4):
            left, right = (Counter(zip(*(t[i:] for i in range(n + 1)))) for t in (a, b))
            hits[n] += sum((left & right).values())
            totals[n] += sum(right.values())
    if not c or not totals[3]:
        return 0.0
    half, log = 1.0, 0.0
    for h, t in zip(hits, totals):
        half = half if h else half * 2
        log += math.log(100 * h / t if h else 100 / (half * t)) / 4
    return math.exp(log) * (math.exp(1 - r / c) if c < r else 1.0)
