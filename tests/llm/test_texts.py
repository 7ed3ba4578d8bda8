from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import chat_format, language_model, license_scan, matroska, sentencepiece_codec, url_filter
from millrace.llm.license_texts import LICENSES
from millrace.llm.queries import PLANTED, URL_RULES, piece_model_path

from . import fixtures

# language model


def test_lm_base_scores_match_brute_force(spark):
    data = fixtures.rows()
    tokens = [(r[1] or "").encode().lower().split() + [b""] for r in data]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    counts = collections.Counter(t for own, h in zip(tokens, held) if not h for t in own)
    n, v = sum(counts.values()), len(counts)
    for most in (1 << 17, 8):  # all tokens in the broadcast table, or nearly none
        got = language_model.score_held_out(fixtures.frame(spark, data), most_frequent=most).collect()
        plain = collections.Counter((r[0], h, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 5)) for r, own, h in zip(data, tokens, held))
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == plain
        assert all(r["score"] < 0 for r in got)


def test_lm_prefers_what_it_has_read(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["red cat sat", "blue dog ran", "old man slept"]) for _ in range(30))) for i in range(150)]
    shuffled = [(10_000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in docs]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(docs + shuffled, "doc_id long, text string"), language_model.train(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert all(got[i]["score"] > got[10_000 + i]["score"] + 5 for i, _ in docs)


def test_lm_filter_levels(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    levels = rng.integers(1, 6, 20_000)
    blocks = int(levels.sum()) * language_model.BITS_PER_ENTRY // language_model.BLOCK_BITS
    bits = np.zeros(blocks * language_model.BLOCK_BITS, bool)
    for level in range(1, 6):
        block, spots = language_model.Filter.places(hashes[levels >= level], level, blocks)
        for s in spots:
            bits[block * language_model.BLOCK_BITS + s] = True
    f = language_model.Filter(np.packbits(bits, bitorder="little"), blocks, 1)
    found = f.levels(hashes, np.zeros(len(hashes), np.int64))
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (f.levels(other, np.zeros(len(other), np.int64)) > 0).mean() < 0.02


def brute_scores(data, smoothing=4.0):
    """The model's formula over exact counts, each taken at its level's count."""
    tokens = [(r[1] or "").encode().lower().split() + [b""] for r in data]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    single = collections.Counter(t for own, h in zip(tokens, held) if not h for t in own)
    pairs = collections.Counter(p for own, h in zip(tokens, held) if not h for p in zip([None, *own], own))
    total, starts = sum(single.values()) + len(single) + 1, held.count(False)
    level = lambda c: language_model.LEVEL_COUNTS[c.bit_length()]
    out = []
    for own in tokens:
        score = 0.0
        for before, t in zip([None, *own], own):
            together, context = level(pairs[before, t]), starts if before is None else level(single[before])
            score += math.log10((together + smoothing * (level(single[t]) + 1) / total) / (max(context, together) + smoothing))
        out.append(score)
    return out


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_lm_scores_match_exact_counts(spark, monkeypatch, bound):
    """With so many bits that nothing collides; the whole filter broadcast, and probed segment by segment."""
    monkeypatch.setattr(language_model, "BITS_PER_ENTRY", 400)
    data = fixtures.rows()
    got = language_model.score_held_out(fixtures.frame(spark, data), max_filter_bytes=bound, segments=7).collect()
    want = collections.Counter((r[0], round(s, 6)) for r, s in zip(data, brute_scores(data)))
    assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in got) == want


def test_lm_probes_by_segment_as_it_does_by_broadcast(spark):
    data = fixtures.rows(200, seed=4)
    columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    one, two = (language_model.score_held_out(fixtures.frame(spark, data), max_filter_bytes=b, most_frequent=30).select(*columns).collect() for b in (1 << 28, 0))
    shown = lambda rows: sorted(repr((r[0], r[1], r[2], round(r[3], 6), round(r[4], 6))) for r in rows)
    assert shown(one) == shown(two)
    assert language_model.score_held_out(fixtures.frame(spark, []), max_filter_bytes=-1).count() == 0


def test_lm_counts_travel_in_few_batches():
    """A batch for each segment of each flush would grow with the square of the text."""
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i % 4000}" for i in range(5000))])], ["text"])
    out = list(language_model._count_partitions(500)(iter([batch])))
    assert len(out) == 2
    rows = pa.Table.from_batches(out * 3).sort_by("segment").combine_chunks().to_batches()
    merged = list(language_model._merge_segments(iter(rows)))
    counts = {t: n for b in merged for t, n in zip(b.column("tokens")[0].as_py(), b.column("token_counts")[0].as_py())}
    assert counts == {b"": 3} | {f"w{i}".encode(): 6 if i < 1000 else 3 for i in range(4000)}
    # pairs: 4,000 within a round, the start, the end, one from round to round
    sizes = [len(b.column("hashes")[0].as_py()) // language_model.KEY_BYTES for b in merged]
    assert sum(sizes) == len(counts) + 4002


def test_lm_many_chunks_and_groups(spark, monkeypatch):
    """Chunks of 2 KB and groups of one segment give the scores of the broadcast, copies of a row included."""
    data = fixtures.rows(120, seed=6)
    frame = fixtures.frame(spark, data + data[:3] * 40).repartition(5)
    shown = lambda rows: sorted(repr((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))) for r in rows)
    want = shown(language_model.score_held_out(frame, segments=50).collect())
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(language_model, "GROUP_BYTES", 1)
    monkeypatch.setattr(language_model, "MOST_TASKS", 6)
    assert shown(language_model.score_held_out(frame, segments=50, max_filter_bytes=0).collect()) == want


def test_lm_empty(spark):
    assert language_model.score_held_out(fixtures.frame(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = language_model.score_held_out(fixtures.frame(spark, [(held, "a b", "en", "s", 0, "", 0.0, 0, "")])).collect()
    assert [(r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) for r in only] == [(0, 0, 3, 0.0)]


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.Model.load(piece_model_path())


def test_encoding_equals_the_library(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    data = fixtures.rows() + [(200 + i, t, "", "", 0, "", 0.0, 0, "") for i, t in enumerate([" ", "  two  marks ", "a\x00b<s></s><0x0A>", "▁", "tab\tline\n\n end ", "x" * 3000, "日本語のテキスト", "</turn> ### 3.14"])]
    encoded = sentencepiece_codec.encode(fixtures.frame(spark, data), model, check=True)
    want = collections.Counter((r[0], tuple(library.encode(r[1] or ""))) for r in data)
    rows = encoded.collect()
    assert collections.Counter((r["doc_id"], tuple(r["tokens"])) for r in rows) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    back = sentencepiece_codec.decode(encoded, model).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((r[0], (r[1] or "").replace("▁", " ")) for r in data)
    assert sentencepiece_codec.encode(fixtures.frame(spark, []), model).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrst ▁.é", max_size=30), max_size=8))
def test_encoding_of_random_texts(model, texts):
    import sentencepiece

    library = _library.setdefault("sp", None) or _library.update(sp=sentencepiece.SentencePieceProcessor(model_file=piece_model_path())) or _library["sp"]
    offsets, tokens = sentencepiece_codec.Encoder(model).encode(texts)
    assert [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t) for t in texts]


_library: dict = {}


def test_unigram_is_viterbi():
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.2, "ba": -5.0, "aba": -6.0}
    model = sentencepiece_codec.Model({p: i for i, p in enumerate(pieces)}, list(pieces.values()), [0] * 256, 0, True, 3)

    def best(word):
        if not word:
            return 0.0, []
        return max((pieces[word[:n]] + best(word[n:])[0], [model.ids[word[:n]], *best(word[n:])[1]]) for n in range(1, len(word) + 1) if word[:n] in pieces)

    words = sorted({"▁" + "".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(60)})
    for word, tokens in zip(words, model.encode_words(words)):
        assert sum(model.scores[t] for t in tokens) == pytest.approx(best(word)[0])


def unigram_file(pieces: dict[str, float]) -> bytes:
    """A SentencePiece model file with these pieces, written by hand: no normalisation, a mark before the text."""

    def number(n: int) -> bytes:
        out = b""
        while True:
            out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
            if not n:
                return out

    field = lambda k, data: number(k << 3 | 2) + number(len(data)) + data
    flag = lambda k, v: number(k << 3) + number(v)
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + flag(3, kind))
    head = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    normal = field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1)
    return head + b"".join(piece(t, s, 1) for t, s in pieces.items()) + field(2, flag(3, 1)) + field(3, normal)


def test_unigram_equals_the_library(tmp_path):
    import sentencepiece

    rng = random.Random(12)
    letters = "abcde"
    pieces = {"▁": -4.0} | {c: -6.0 - i / 7 for i, c in enumerate(letters)}
    while len(pieces) < 120:
        body = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
        pieces.setdefault(rng.choice(["", "▁"]) + body, -1.0 - 9 * rng.random())
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_file(pieces))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    model = sentencepiece_codec.Model.load(str(path))
    assert model.unigram
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    offsets, tokens = sentencepiece_codec.Encoder(model).encode(texts)
    assert [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t) for t in texts]


# Matroska


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40_000))
def test_matroska_round_trip(data):
    sent = matroska.pad(data)
    file = matroska.write(sent)
    parsed = matroska.parse(file)
    assert matroska.payload(file, parsed) == sent and len(sent) % matroska.FRAME == 0
    assert [p[1] for p in parsed.packets] == [24_000_000 * i for i in range(len(parsed.packets))]
    assert {c for *_, c in parsed.cues} == set(parsed.clusters)


def test_matroska_lacings_unknown_sizes_and_groups():
    m = matroska
    track = m.element(m.TRACKS, m.element(m.TRACK, m.number(m.TRACK_NUMBER, 3) + m.number(m.TRACK_TYPE, 1) + m.element(m.CODEC, b"V_TEST") + m.number(m.DEFAULT_DURATION, 40_000_000)))
    frames = [b"a" * 300, b"b" * 10, b"c" * 77]
    xiph = b"\x02" + b"\xff\x2d" + b"\x0a" + b"".join(frames)
    ebml = b"\x02" + m.size_bytes(300) + m.size_bytes(10 - 300 + 8191, 2) + b"".join(frames)
    head = m.size_bytes(3) + (5).to_bytes(2, "big", signed=True)
    cluster = m.number(m.CLUSTER_TIME, 100) + m.element(m.SIMPLE_BLOCK, head + b"\x82" + xiph) + m.element(m.SIMPLE_BLOCK, head + b"\x06" + ebml) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, head + b"\x00" + frames[0]) + m.number(m.REFERENCE, 1))
    body = track + m.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster + m.element(m.CUES, b"")
    file = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    parsed = m.parse(file)
    assert [file[at : at + n] for _, _, _, at, n, _, _ in parsed.packets] == [*frames, *frames, frames[0]]
    assert [p[1] // 1_000_000 for p in parsed.packets] == [105, 145, 185, 105, 145, 185, 105]
    assert [p[2] for p in parsed.packets] == [True] * 3 + [False] * 4 and [p[6] for p in parsed.packets] == [1] * 3 + [3] * 3 + [0]


def test_matroska_tables(spark):
    data = fixtures.rows()
    stored = matroska.store_texts(fixtures.frame(spark, data), with_media=True)
    rows = stored.collect()
    assert len(rows) == len(data)
    texts = collections.Counter((r[0], hashlib.sha256(matroska.pad((r[1] or "").encode())).hexdigest()) for r in data)
    assert collections.Counter((r["doc_id"], r["payload_sha256"]) for r in rows) == texts
    packets = matroska.packet_table(stored, id_col="doc_id", media_col="media").where("doc_id = 5").collect()
    media = next(bytes(r["media"]) for r in rows if r["doc_id"] == 5)
    packets.sort(key=lambda p: p["timestamp_ns"])
    assert b"".join(media[p["first_byte"] : p["first_byte"] + p["n_bytes"]] for p in packets).rstrip(b" ") == data[5][1].encode()
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"not matroska"), (4, media[:1000])], "k long, media binary")
    bad = {r["k"]: r["error"] for r in matroska.packet_table(odd, id_col="k", media_col="media").collect()}
    assert set(bad) == {2, 3, 4} and all(bad.values())
    assert matroska.store_texts(fixtures.frame(spark, [])).count() == 0


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\n\\#</> turn", max_size=12), st.text(alphabet="ab\\#</turn> \n:é", max_size=40)), max_size=6))
def test_chat_round_trip(turns):
    assert chat_format.parse("".join(chat_format.render_turn(r, t)[0] for r, t in turns)) == turns


@pytest.mark.parametrize("text", ["x", "### user:\nhello", "### user:\nhi</turn>", "### user:\n### x</turn>\n", "### a\nb:\nx</turn>\n"])
def test_chat_rejects(text):
    with pytest.raises(chat_format.Unparsable):
        chat_format.parse(text)


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", PLANTED), (1, 2, None, None), (2, 0, "assistant", None), (1, 3, "assistant", "é😀"), (None, 0, "user", "x"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "tool", "### x\n</turn>\\")]
    turns += [(9, i, "assistant" if i % 2 else "user", f"turn {i} ### ") for i in range(3000)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    rendered = chat_format.render(df)
    got = {r["conv_id"]: r for r in chat_format.digests(rendered).collect()}
    assert set(got) == {1, 2, 3, 9, None}
    for conv, r in got.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(t for _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    parts = sorted((r["conv_id"] or -1, r["position"], r["formatted"]) for r in rendered.collect())
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(p[2]) for p in parts)
    assert chat_format.digests(chat_format.render(df.limit(0))).count() == 0


# URLs


def plain_judge(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[2].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[3]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, best and best.rule, best and best.verdict


def test_url_rules(spark):
    urls = ["https://Example.ORG/es/1", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a?b#c", "http://com/de/", "http://x.com/de", "http://org", "http://org/",
            None, "", "no scheme", "://", "a://b://c/d", "http://x.net/?q=http://y.org/", "http://x.org#f/", "http://ÄB.org/x\ny/z"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[1], "h")], "page_id long, url string, host string")
    model = url_filter.fit(spark.createDataFrame([], "url string, label int"))
    rows = url_filter.judge(pages, URL_RULES, model).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_judge(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert url_filter.judge(pages.limit(0), URL_RULES, model).count() == 0


def test_url_trees_learn(spark):
    rng = random.Random(8)
    make = lambda bad: (f"http://{'casino-' + str(rng.randrange(9999)) if bad else rng.choice(['news', 'wiki', 'blog'])}.{'top' if bad and rng.random() < 0.7 else 'com'}/{rng.randrange(999)}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.5 else ""), int(not bad))
    rows = [make(rng.random() < 0.4) for _ in range(1500)]
    model = url_filter.fit(spark.createDataFrame(rows[:1000] + [("http://x", None)], "url string, label int"))
    again = url_filter.fit(spark.createDataFrame(rows[:1000][::-1], "url string, label int"))
    scores = model.scores([u for u, _ in rows[1000:]])
    assert np.allclose(scores, again.scores([u for u, _ in rows[1000:]]))
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(scores, rows[1000:])]) > 0.97


# licences


def test_license_scan(spark):
    mit = dict(LICENSES)["MIT"]
    shouted = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ,").replace("\n", "\n   ")
    data = [(1, mit), (2, shouted), (3, mit + " And more."), (4, None), (5, ""), (6, "Text.\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (7, dict(LICENSES)["ISC"] + "\n\n© 1999 X"), (7, "x " * 50_000), (None, mit)]
    docs = spark.createDataFrame([(*d, "clash", "clash") for d in data], "doc_id long, text string, digest string, license string")
    rows = license_scan.scan(docs).collect()
    assert sorted((r["doc_id"] or 0, r["license"] or "", r["notices"]) for r in rows) == sorted(
        [(1, "MIT", []), (2, "MIT", []), (3, "", []), (4, "", []), (5, "", []), (6, "", ["CC-BY-NC-4.0", "MIT"]), (7, "ISC", []), (7, "", []), (0, "MIT", [])]
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    plain = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(map(str, plain)) == sorted(str((r["doc_id"], r["digest"], r["license"], r["notices"])) for r in rows)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_matroska_digests_match_a_plain_version(spark):
    data = fixtures.rows()
    got = {(r["doc_id"], r["payload_sha256"]): r for r in matroska.store_texts(fixtures.frame(spark, data), with_media=True).collect()}
    for r in data:
        text = (r[1] or "").encode()
        sent = text + b" " * (-len(text) % 192 or (192 if not text else 0))
        row = got[r[0], hashlib.sha256(sent).hexdigest()]
        media = bytes(row["media"])
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(text), len(sent), zlib.crc32(sent[-16:]))
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        parsed = matroska.parse(media)
        stated = dict(x.split("=") for x in row["feature"].split(";"))
        assert int(stated["packets"]) == len(parsed.packets) and int(stated["clusters"]) == media.count(bytes.fromhex("1f43b675"))
        assert int(stated["mean"]) == sum(sent) * 1000 // len(sent) and int(stated["power"]) == sum(b * b for b in sent) * 1000 // len(sent)


def test_matroska_refuses_numbers_out_of_range(spark):
    def element(kind: str, body: bytes) -> bytes:
        return bytes.fromhex(kind) + (len(body) | 1 << 56).to_bytes(8, "big") + body

    head = element("1a45dfa3", b"")
    late = element("18538067", element("1f43b675", element("e7", b"\xff" * 8) + element("a3", b"\x81\x00\x00\x80x")))
    wide = element("18538067", element("1f43b675", element("e7", b"\x00") + element("a3", b"\x01" + b"\xff" * 6 + b"\x7f" + b"\x00\x00\x80x")))
    files = spark.createDataFrame([(1, head + late), (2, head + wide)], "id long, media binary")
    rows = matroska.packet_table(files, id_col="id", media_col="media").collect()
    assert len(rows) == 2 and all(r["error"] and r["track"] is None for r in rows)


def test_licences_with_many_notices(spark):
    data = fixtures.rows() + [(300, "License: MIT-like\nsome text\nLicense: odd 77\nlicense: odd 77", "", "", 0, "", 0.0, 0, "")]
    few = spark.createDataFrame([("odd", "License: odd 77"), ("mit", "license mit-like")], "license string, text string")
    known = few.select(license_scan.digest(few["text"]).alias("digest"), "license")
    many = known.union(spark.range(3000).selectExpr("sha2(cast(id as string), 256) as digest", "'none' as license"))
    docs = fixtures.frame(spark, data)
    shown = lambda n: sorted(repr(tuple(r)) for r in license_scan.scan(docs, notices=n).collect())
    assert shown(known) == shown(many)
    assert [r["notices"] for r in license_scan.scan(docs, notices=many).where("doc_id = 300").collect()] == [["mit", "odd"]]


def test_url_features_of_long_urls(spark):
    long = "https://a.example.com/" + "x1/" * 100_000 + "?q=" + "z" * 100_000
    pages = spark.createDataFrame([(1, long), (2, "://"), (3, None)], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://{i % 7}.site{i % 3}.net/p{i}", i % 2) for i in range(400)], "url string, label int")
    model = url_filter.fit(labelled)
    rows = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, model).collect()}
    assert rows[1]["host"] == "a.example.com" and len(rows[1]["path"]) == 1 + 300_000 and 0 <= rows[1]["score"] <= 1
    again = url_filter.fit(labelled.repartition(7), max_fit_rows=150)
    assert np.array_equal(again.scores(["http://1.site2.net/p5"]), url_filter.fit(labelled, max_fit_rows=150).scores(["http://1.site2.net/p5"]))


def test_boosting_matches_a_plain_version():
    """One tree's splits and leaves against all cuts tried one by one."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.random(300) < 0.1)).astype(float)
    tree = url_filter.boost(x, y, trees=1, depth=1, rate=1.0, penalty=5.0)
    start = np.log(y.mean() / (1 - y.mean()))
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    best = (0.0, 0, 0.0)
    for j in range(3):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = g[left].sum() ** 2 / (h[left].sum() + 5) + g[~left].sum() ** 2 / (h[~left].sum() + 5) - g.sum() ** 2 / (h.sum() + 5)
            best = max(best, (gain, j, cut))
    left = x[:, best[1]] <= best[2]
    want = start + np.where(left, g[left].sum() / (h[left].sum() + 5), g[~left].sum() / (h[~left].sum() + 5))
    assert np.allclose(tree.margin(x), want)
