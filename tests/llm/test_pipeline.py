from __future__ import annotations

import collections

import corpus_pipeline
from millrace.llm import mixing, quality_classifier, quality_rules, simhash

from . import fixtures, plain
from .test_mixing import plain_targets


def test_pipeline_on_odd_documents(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, labels = fixtures.frame(spark).select(*columns), fixtures.labels(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    plain = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = plain
        out = stage(spark, before, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / f"stage{n}"))
        plain = spark.read.parquet(str(tmp_path / f"stage{n}"))
        ids = collections.Counter(r["doc_id"] for r in plain.collect())
        if stage is corpus_pipeline.classify:
            want = collections.Counter(r["doc_id"] for r in quality_classifier.score(before, labels).collect() if r["predicted"])
        elif stage is corpus_pipeline.apply_rules:
            want = collections.Counter(r["doc_id"] for r in quality_rules.judge(before).collect() if r["kept"])
        elif stage is corpus_pipeline.deduplicate:
            want = collections.Counter(r["doc_id"] for r in simhash.keep_first(before).collect())
            one_print = {r["component_id"] for r in simhash.near_duplicates(before, shingle=5).collect()}
            assert set(want) <= one_print and set(want.values()) == {1}
        else:
            want = collections.Counter()
            for r in mixing.plan_copies(before).collect():
                want[r["doc_id"]] += r["copies"]
            want = +want
        assert ids == want, name
    encoded = corpus_pipeline.STAGES[-1][1](spark, plain, sf)
    assert encoded.count() == plain.count() and encoded.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert collections.Counter(r["doc_id"] for r in run.collect()) == collections.Counter(r["doc_id"] for r in plain.collect())
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_of_nothing(spark, tmp_path):
    fixtures.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    fixtures.labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_match_plain_versions(spark, tmp_path):
    """Each stage, on what the one before kept, against a plain version that shares no code with it."""
    import random

    import sentencepiece
    from millrace.llm.queries import piece_model_path

    rng = random.Random(31)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    data = [(r[0], r[1], r[2], r[3], r[4]) for r in fixtures.rows(160, seed=31)]
    long = [r[1] for r in data if r[1] and 60 <= len(r[1].split()) <= 200][:12]
    for i, t in enumerate(long):  # near copies, some of them too far apart, and copies under other ids
        words = t.split()
        for _ in range(1 + i % 6):
            words[rng.randrange(len(words))] = f"word{rng.randrange(1 << 30)}"
        data.append((400 + i, " ".join(words), "en", f"src{i % 3}", None))
    data += [(500 + i, "!!! ### BUY $$$ NOW" * (3 + i), "en", "src1", None) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    marks = [(r[0], 0 if r[1] and ("$$$" in r[1] or "again" in r[1]) else 1, 0) for r in data if r[0] is not None]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    count = lambda rows: collections.Counter((r[0], r[1]) for r in rows)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, before):
        out = stages[name](spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        back = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        return back, [tuple(r) for r in back.select(*columns).collect()] if back.columns == columns else back.collect()

    scores = plain.quality_scores(data, marks)
    assert min(abs(scores - 0.3)) > 2e-3
    kept, rows = run("quality classifier", docs)
    assert count(rows) == count(r for r, s in zip(data, scores) if s >= 0.3)
    votes = [plain.votes(r[1]) for r in rows]
    good = [r for r, p in zip(rows, plain.posteriors(votes)) if p >= 0.5 and (c := plain.base_counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    kept, rows = run("quality rules", kept)
    assert count(rows) == count(good) and 0 < len(good) < len(data)
    firsts = plain.first_of_groups(rows)
    before, (kept, rows) = rows, run("simhash near-dedup", kept)
    assert count(rows) == count(firsts) and len(firsts) < len(before)
    before, (kept, rows) = rows, run("mixing", kept)
    size = lambda t: len(plain.WORD.findall(t or ""))
    times = count(rows)
    assert set(times) <= {(r[0], r[1]) for r in before} and max(times.values()) <= 2
    totals, taken = collections.Counter(), collections.Counter()
    for r in before:
        totals[r[3]] += size(r[1])
        taken[r[3]] += times[r[0], r[1]] * size(r[1])
    largest = {s: max(size(r[1]) for r in before if r[3] == s) for s in totals}
    for s, goal in plain_targets(dict(totals)).items():
        assert abs(taken[s] - goal) <= max(largest[s], 0.02 * goal)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    encoded = stages["sentencepiece"](spark, kept, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], tuple(r["tokens"])) for r in encoded) == collections.Counter((r[0], tuple(library.encode(r[1]))) for r in rows)


def test_stages_with_clashing_columns(spark, tmp_path):
    """Extra columns with the names that stages use inside come through every stage as they are."""
    from pyspark.sql import functions as F

    fixtures.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    names = ["kept", "n", "key", "u", "v", "root", "t", "s", "x", "y", "fold", "class", "copies", "rate", "floor", "target", "n_words", "posterior", "base_failed", "first"]
    docs = fixtures.frame(spark).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    plain_docs = fixtures.frame(spark)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out, want = stage(spark, docs, str(tmp_path)), stage(spark, plain_docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == i for r in rows for i, c in enumerate(names))
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in want.collect())
        out.write.parquet(str(tmp_path / f"c{n}"))
        want.write.parquet(str(tmp_path / f"p{n}"))
        docs, plain_docs = spark.read.parquet(str(tmp_path / f"c{n}")), spark.read.parquet(str(tmp_path / f"p{n}"))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
