from __future__ import annotations

import collections
import re

import pytest
from millrace.llm import mixing

from . import fixtures


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Fill up round by round: share what is left by weight, stop the ones above their cap, share again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_names, left = {}, list(names), share * sum(sizes.values())
    while open_names:
        total = sum(w[s] for s in open_names)
        over = [s for s in open_names if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_names}
        for s in over:
            out[s] = most * sizes[s]
            open_names.remove(s)
        left -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 50, None: 3}, {"x": 5}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 997}])
def test_targets(sizes):
    got, want = mixing.targets(sizes), plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_plan_meets_targets_and_repeats(spark):
    data = fixtures.rows(400, seed=3)
    docs = fixtures.frame(spark, data)
    first = mixing.plan_copies(docs).collect()
    again = mixing.plan_copies(docs.repartition(7)).collect()
    tell = lambda rows: collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert tell(first) == tell(again) and len(first) == len(data)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert collections.Counter((r["doc_id"], r["size"]) for r in first) == collections.Counter((r[0], size(r[1])) for r in data)
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    goal = plain_targets(dict(sizes))
    taken = collections.Counter()
    by_size = collections.defaultdict(set)
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_size[(r["source_size"], round(r["target"], 3))].add(1)
    source = {r[0]: r[3] for r in data}
    for r in first:
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
    largest = collections.Counter()
    for r in data:
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    for s, want in goal.items():  # whole copies: a source that is mostly one document misses by up to half of it
        assert abs(taken[s] - want) <= (largest[s] / 2 if largest[s] > 0.5 * sizes[s] else max(0.02 * want, 10)), (s, taken[s], want)


def test_mix_repeats_rows_as_planned(spark):
    docs = fixtures.frame(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = collections.Counter()
    for r in mixing.plan_copies(docs).collect():
        planned[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +planned


def test_mix_of_nothing(spark):
    assert mixing.plan_copies(fixtures.frame(spark, [])).count() == 0
    blank = [(i, None, "en", "s", 0, "", 0.0, 0, "") for i in range(3)]
    assert {r["taken"] for r in mixing.plan_copies(fixtures.frame(spark, blank)).collect()} == {0}
