from __future__ import annotations

import collections
import random

import xxhash
from millrace.llm import simhash
from millrace.llm.components import components

from . import fixtures


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_match_brute_force(spark):
    data = fixtures.rows()
    got = simhash.near_duplicates(fixtures.frame(spark, data)).collect()
    prints = [brute_print(r[1]) for r in data]
    groups = brute_components(prints)
    least = {}
    for r, g in zip(data, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = collections.Counter((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(data, prints, groups))
    assert collections.Counter(tuple(r) for r in got) == want


def test_fingerprints_are_independent():
    text = " ".join(fixtures.sentence(random.Random(1), 300).split()).encode()
    prints = simhash.fingerprints_of(text, 5, 3)
    assert prints[0] == brute_print(text.decode(), 5) == simhash.fingerprints_of(text, 5)[0]
    assert all(20 < (prints[a] ^ prints[b]).bit_count() < 44 for a in range(3) for b in range(a))
    assert simhash.fingerprints_of(b"", 5, 3) == [0, 0, 0]


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing_in_hot_buckets(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(700):  # a cloud around one print, all in the same buckets, and chains leading away
        prints.add(centre ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(40)))
    walk = centre
    for _ in range(60):
        walk ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.add(walk)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(as_long(p),) for p in prints], "fp long")
    found = simhash.links(nodes, most_joined=16)
    pairs = [(r["u"], r["v"]) for r in found.collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in pairs)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    groups = brute_components(prints)
    mine = [roots.get(as_long(p), as_long(p)) for p in prints]
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))
    assert len(pairs) < 64 * len(prints)


def test_keep_first(spark):
    docs = fixtures.frame(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    data = fixtures.rows()
    texts = [(r[1] or "").encode() for r in data]
    many = [simhash.fingerprints_of(t, 5, 3) for t in texts]
    parent = list(range(len(data)))
    for k in range(3):  # join the components of each kind of fingerprint
        for i, g in enumerate(brute_components([m[k] for m in many])):
            a, b = parent[i], parent[g]
            parent = [b if x == a else x for x in parent]
    groups = parent
    assert len(rows) == len(set(groups))
    least = {}
    for r, g in zip(data, groups):
        key = (r[0] is None, r[0] or 0)
        least[g] = min(least.get(g, key), key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(least.values())


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components(chain).collect()}
    assert roots == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert components(chain.limit(0)).count() == 0


def test_empty(spark):
    empty = fixtures.frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns and simhash.keep_first(empty).count() == 0


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"x{rng.getrandbits(40)}"
    return " ".join(words)


def test_keep_first_finds_pairs_of_similarity_above_four_fifths(spark):
    rng = random.Random(3)
    data, similar = [], set()
    for k in range(60):
        words = [f"w{rng.getrandbits(40)}" for _ in range(400)]
        other = edited(rng, words, 2 + k % 12)
        data += [(2 * k, " ".join(words)), (2 * k + 1, other)]
        if jaccard(data[-2][1], other) >= 0.8:
            similar.add(2 * k + 1)
    assert 20 < len(similar) < 60
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(range(120)) - kept == similar


def test_keep_first_links_large_groups(spark):
    rng = random.Random(4)
    words = [f"w{rng.getrandbits(40)}" for _ in range(400)]
    data = [(i, edited(rng, words, 1)) for i in range(150)]
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_keep_first_keeps_different_texts_with_common_lines(spark):
    line = " ".join(f"common{i}" for i in range(15))
    data = []
    for k in range(12):
        rng = random.Random(k)
        data.append((k, "\n".join([line] * 100 + [" ".join(f"w{rng.getrandbits(40)}" for _ in range(3500))])))
    assert jaccard(data[0][1], data[1][1]) < 0.01
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(kept) == 12


def test_keep_first_connects_a_group_that_straddles_the_threshold(spark):
    """Variants of one text with more and fewer edits, and a second group that only outer members link to it: as brute force has it."""
    rng = random.Random(6)
    words = [f"w{rng.getrandbits(40)}" for _ in range(150)]
    data = [(i, edited(rng, words, rng.randrange(1, 9))) for i in range(160)]
    chain = data[5][1].split()
    for i in range(160, 230):  # a walk away from the group
        chain = edited(rng, chain, 1 + i % 2).split()
        data.append((i, " ".join(chain)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in data)]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = sorted({find(i) for i in range(len(data))})
    assert 20 < len(want) < 200
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_parity_never_exceeds_the_difference():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 3000))).encode() for _ in range(40)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    for a in sets:
        for b in sets:
            bits = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(simhash.parity(a), simhash.parity(b)))
            assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
