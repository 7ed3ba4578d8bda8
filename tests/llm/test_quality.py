from __future__ import annotations

import collections
import random
import zlib

import numpy as np
from millrace.llm import quality_classifier, quality_rules

from . import fixtures, plain


def test_counts_match_brute_force(spark):
    data = fixtures.rows()
    texts = ["a b c d e f g h i a b c d e f g h", "x\nx\n\n \ny\nx", "|<>#", "w " * 9, "a b c d e f g h a b c d e f g h a b c d e f g h z"]
    data += [(100 + i, t, "en", "s", 0, "", 0.0, 0, "") for i, t in enumerate(texts)]
    got = quality_rules.judge(fixtures.frame(spark, data)).collect()
    assert len(got) == len(data)
    want = collections.Counter((r[0], *plain.base_counts(r[1])) for r in data)
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_clean_and_drop_junk(spark):
    rng = random.Random(4)
    clean = [(i, fixtures.sentence(rng, 80)) for i in range(80)]
    junk = [(1000 + i, " ".join(w + rng.choice(["***", "###", "%%%"]) for w in fixtures.sentence(rng, 80).split())) for i in range(12)]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(judged[i] for i, _ in clean) and not any(judged[i] for i, _ in junk)


def test_rules_on_empty_and_in_place(spark):
    empty = fixtures.frame(spark, [])
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(empty).columns == empty.columns
    docs = fixtures.frame(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = collections.Counter(r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"])
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=40).round(1), rng.integers(0, 2, 40).astype(float)
    steps, levels = quality_classifier.isotonic(s, y)
    fit = np.interp(s, steps, levels)
    assert (np.diff(levels) >= 0).all()
    for _ in range(500):  # no rising function of the scores does better
        other = np.interp(s, np.sort(np.unique(s)), np.sort(rng.random(len(np.unique(s)))))
        assert ((fit - y) ** 2).sum() <= ((other - y) ** 2).sum() + 1e-9
    pooled = sorted(set(s))
    best = [max(min(y[(s >= a) & (s <= b)].mean() for b in pooled if b >= x) for a in pooled if a <= x) for x in s]
    assert np.allclose(fit, best)


def test_classifier_scores_every_row_and_learns(spark):
    rng = random.Random(2)
    data, marks = [], []
    for i in range(400):
        bad = i % 5 == 0 and i % 2 == 0 or i % 7 == 0
        text = fixtures.sentence(rng, 60)
        data.append((i, text.upper() + " !! ##" if bad else text))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    assert len(got) == 400
    for i, y, _ in marks:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    held = [(got[i]["predicted"], y) for i, y, _ in marks if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    kept = quality_classifier.keep_predicted(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["predicted"]}


def test_held_out_labels_are_never_learned(spark):
    docs = fixtures.frame(spark)
    marks = [tuple(r) for r in fixtures.labels(spark).collect()]
    other = [(d, 1 - q if d is not None and q is not None and zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in marks]
    a, b = (quality_classifier.score(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect() for m in (marks, other))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and sorted(a, key=key)


def test_classifier_odd_cases(spark):
    docs = fixtures.frame(spark)
    got = quality_classifier.score(docs, fixtures.labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7, 8)}) == 1
    none = fixtures.labels(spark, [])
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(fixtures.frame(spark, []), fixtures.labels(spark)).count() == 0
    assert quality_classifier.keep_predicted(docs, none).columns == docs.columns


def with_salad(rng, n, varied_first):
    """``n`` words: 200 that differ before a salad of seven words, or 200 words of the salad before others that differ."""
    varied = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(200 if varied_first else n - 200)]
    salad = rng.choices(["ever", "over", "river", "stone", "green", "north", "cloud"], k=n - len(varied))
    return " ".join(varied + salad if varied_first else salad + varied)


def test_distinct_words_are_counted_over_the_whole_text(spark):
    rng = random.Random(6)
    data = [(0, with_salad(rng, 4000, True)), (1, with_salad(rng, 4000, False)), (2, "a b a"), (3, ""), (4, "x " * 200 + "y")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, text in data:
        words = text.split()
        assert got[i]["n_distinct_words"] == sum(len(set(words[k : k + 200])) for k in range(0, len(words), 200))
    assert got[0]["distinct_words"] == -1 and got[1]["distinct_words"] == 1


def test_classifier_statistics_see_the_whole_text():
    rng = random.Random(8)
    words, salad = [f"w{rng.getrandbits(40)}" for _ in range(200)], ["a", "b"] * 2000
    front, back = (quality_classifier.text_statistics(" ".join(x).encode()) for x in (words + salad, salad + words))
    assert front[4] == back[4] == (200 + 20 * 2) / 4200


def test_label_model_matches_plain_expectation_maximisation(spark):
    """Votes, posteriors and verdicts against the same steps in plain Python, document by document."""
    data = fixtures.rows(120, seed=9)
    judged = quality_rules.judge(fixtures.frame(spark, data)).collect()
    names = [r.name for r in quality_rules.RULES]
    want = collections.Counter()
    all_votes = [plain.votes(r[1]) for r in data]
    for r, v, p in zip(data, all_votes, plain.posteriors(all_votes)):
        n, *_, repeats = plain.base_counts(r[1])
        want[r[0], v, round(p, 5), n >= 20 and 100 * repeats <= 30 * n and p >= 0.5] += 1
    assert collections.Counter((r["doc_id"], tuple(r[n] for n in names), round(r["posterior"], 5), r["kept"]) for r in judged) == want


def test_scores_match_a_plain_fit(spark):
    """Features, normal equations and calibration against one dense solve in plain numpy."""
    data = fixtures.rows(150, seed=21)
    docs, labels = fixtures.frame(spark, data), fixtures.labels(spark, data)
    want = collections.defaultdict(list)
    for r, s in zip(data, plain.quality_scores(data, [tuple(r) for r in labels.collect()])):
        want[r[0]].append(float(s))
    for r in quality_classifier.score(docs, labels).collect():
        assert any(abs(r["score"] - s) < 2e-3 for s in want[r["doc_id"]])


def test_rules_match_their_sql(spark):
    """The whole query against its SQL, on odd texts and on an empty table."""
    import duckdb
    import pandas as pd

    for data in (fixtures.rows(150, seed=5), []):
        documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in data], "Int64"), "text": pd.array([r[1] for r in data], "string")})  # noqa: F841  (read by DuckDB)
        result = duckdb.connect().execute(quality_rules.judge_sql())
        names = [d[0] for d in result.description]
        want = sorted(repr(tuple(None if v is pd.NA else v for v in r)) for r in result.fetchall())
        judged = quality_rules.judge(fixtures.frame(spark, data)).collect()
        assert sorted(repr(tuple(round(r[c], 6) if c == "posterior" else r[c] for c in names)) for r in judged) == want
