"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of its word shingles, repeats
included.  For a radius r the 64 bits are cut into as few segments as leave one segment with at most one differing bit
(two for r up to 3), and each fingerprint is indexed under each segment with each one of its bits left out: 64 keys.
Fingerprints that share a key are candidates; links are those within r bits.

Equal fingerprints are one node.  Keys with two fingerprints give their pair at once; keys with up to ``most_joined`` join
their members.  In larger buckets nothing is paired: their fingerprints go under themselves and all their 64
one-bit neighbours, where two meet exactly if they differ by two bits or fewer and at most 65 ever meet, and each such
meeting links its members to its least one.  So no link within the radius is lost and the work stays proportional to the rows.
Components over links come from star rounds (see components.py).

``keep_first`` links texts by the similarity of their sets of distinct shingles: fingerprints and MinHash bands name
candidates, the sets decide.  A set's parity sketch (bit b: how many of its hashes fall on b, modulo two) bounds the
difference of two sets from below, so that pairs which cannot link are left before their sets meet.

Null texts count as empty; texts without words have fingerprint zero and link like any other; shorter texts than a shingle
are one shingle.  Long texts are hashed whole, in blocks.  Repeated rows each get a result.  A null id never is the
component's id unless the component has no other.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, own_columns, stage_table, text_bytes
from .components import components

BLOCK = 50_000
#: MinHash bands of keep_first: at shingle similarity 0.8, 1 - (1 - 0.8^5)^20 = 0.9996 of the pairs share one.
BANDS, BAND_ROWS = 20, 5
#: Bits of a parity sketch; sets of up to about twice as many shingles are told apart by it.
PARITY_BITS = 1024
_SLOTS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (256 * np.arange(8)).astype(np.int64)


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """Bytes (big-endian rows) of the k-th hash of each shingle: the XXH64 itself for k = 0, else a bijective mix of it."""
    if not k:
        return hashes.view(np.uint8).reshape(-1, 8)
    x = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)


def _shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42, big-endian) of a text's word shingles, repeats included, in blocks; none of a text without words."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if n < shingle:
        first, last = [0], [len(joined)]
    else:
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
        first, last = starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    for at in range(0, len(first), BLOCK):
        part = b"".join([digest(joined[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])])
        yield np.frombuffer(part, ">u8")


def _prints(blocks: list[np.ndarray], prints: int) -> list[int]:
    if not blocks:
        return [0] * prints
    tables = np.zeros((prints, 2048), np.int64)
    for hashes in blocks:
        for k in range(prints):
            tables[k] += np.bincount((_spread(hashes, k) + _OFFSETS).ravel(), minlength=2048)
    counts = (tables.reshape(prints, 8, 256) @ _BITS).reshape(prints, 64)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(2 * counts > sum(map(len, blocks)), axis=1)]


def fingerprints_of(text: bytes | None, shingle: int = 3, prints: int = 1) -> list[int]:
    """The unsigned fingerprints of a text: the first from XXH64, others from mixes of it."""
    return _prints(list(_shingle_hashes(text, shingle)), prints)


def _distinct(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks).astype(np.uint64)) if blocks else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, rising."""
    return _distinct(list(_shingle_hashes(text, shingle)))


def band_keys(distinct: np.ndarray) -> list[int]:
    """One key a band from the least of each slot's products with the distinct shingle hashes; none of an empty set."""
    if not len(distinct):
        return []
    least = np.full(len(_SLOTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 2048):
        with np.errstate(over="ignore"):
            np.minimum(least, (distinct[at : at + 2048] * _SLOTS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """Fingerprints as signed longs with the same bits."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprints_of(t, shingle)[0] for t in text_bytes(texts)], np.uint64).view(np.int64))

    return prints(text)


def signatures(text: str | Column, shingle: int, prints: int) -> Column:
    """struct(s, fps, keys): hash of the distinct shingles, ``prints`` fingerprints, band keys, all as signed longs."""

    @F.arrow_udf("struct<s: bigint, fps: array<bigint>, keys: array<bigint>>")
    def every(texts: pa.Array) -> pa.Array:
        sets, fps, keys = [], [], []
        for t in text_bytes(texts):
            blocks = list(_shingle_hashes(t, shingle))
            distinct = _distinct(blocks)
            sets.append(xxhash.xxh64_intdigest(distinct.tobytes()))
            fps.append(np.array(_prints(blocks, prints), np.uint64).view(np.int64))
            keys.append(np.array(band_keys(distinct), np.uint64).view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(fps, lists), pa.array(keys, lists)], ["s", "fps", "keys"])

    return every(text)


def parity(distinct: np.ndarray) -> np.ndarray:
    """Bit b: whether an odd number of the hashes fall on b.  Two sketches differ in no more bits than their sets in members."""
    odd = np.bincount((distinct & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(text: str | Column, shingle: int) -> Column:
    """struct(n, p, items): size, parity sketch and members of a text's set of distinct shingle hashes."""

    @F.arrow_udf("struct<n: int, p: array<bigint>, items: array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [shingle_set(t, shingle) for t in text_bytes(texts)]
        lists = pa.list_(pa.int64())
        columns = [pa.array([len(x) for x in found], pa.int32()), pa.array([parity(x) for x in found], lists), pa.array([x.view(np.int64) for x in found], lists)]
        return pa.StructArray.from_arrays(columns, ["n", "p", "items"])

    return sets(text)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, fp): segment with one bit left out, the bit's number above it."""
    segments = max(2, -(-(radius + 1) // 2))
    bounds = [round(64 * i / segments) for i in range(segments + 1)]
    variants = []
    for low, high in zip(bounds, bounds[1:]):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        variants += [value.bitwiseAND(F.lit(~(1 << (b - low)))).bitwiseOR(F.lit(b << 32)) for b in range(low, high)]
    return nodes.select(F.explode(F.array(*variants)).alias("key"), "fp")


def links(nodes: DataFrame, radius: int = 2, most_joined: int = 64) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) within ``radius`` (at most 2) bits, enough of them to connect
    all that are linked: each pair in buckets of up to ``most_joined``, stars in larger ones."""
    if radius > 2:
        raise ValueError("large buckets are resolved for a radius of 2 or less")
    keys = _keys(nodes, radius)
    buckets = stage_table(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "buckets"
    )
    near = distance(F.col("u"), F.col("v")) <= radius
    pairs = buckets.where("n = 2").where(near).select("u", "v")
    wide = buckets.where("n > 2").select("key", "n")
    if wide.isEmpty():
        return stage_table(pairs.distinct(), "links")
    members = stage_table(keys.join(broadcast_if_small(wide), "key"), "members")
    left, right = (members.where(F.col("n") <= most_joined).select("key", F.col("fp").alias(x)) for x in "uv")
    joined = left.join(right, "key").where((F.col("u") < F.col("v")) & near).select("u", "v")
    hot = members.where(F.col("n") > most_joined).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(64)))
    around = hot.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    met = around.groupBy("z").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("u", F.explode("all").alias("v")).where((F.col("u") < F.col("v")) & near)
    return stage_table(pairs.union(joined).union(stars).distinct(), "links")


def _first(*columns: str) -> Column:
    """Orders rows by id, nulls last, then by the other columns."""
    return F.struct(F.col(columns[0]).isNull().alias("none"), *columns)


def _classes(printed: DataFrame, radius: int) -> DataFrame:
    """(fp, first): for each fingerprint of ``printed`` (id, t, fp) the first row (none, id, t) of its component."""
    nodes = stage_table(printed.groupBy("fp").agg(F.min(_first("id", "t")).alias("first")), "nodes")
    found = links(nodes.select("fp"), radius)
    roots = stage_table(components(found), "roots")
    # fingerprints with a link are few; the others are their own component
    linked = nodes.join(broadcast_if_small(roots), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    best = stage_table(linked.where("node is not null").groupBy("root").agg(F.min("first").alias("best")), "best")
    merged = linked.join(broadcast_if_small(best), "root", "left")
    return merged.select("fp", F.coalesce("best", "first").alias("first"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the least id reachable over links)."""
    printed = own_columns(docs, id=id_col, text=text_col).select("id", F.lit(0).alias("t"), fingerprint("text", shingle).alias("fp"))
    printed = stage_table(printed, "prints")
    out = printed.join(_classes(printed, radius), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def _print_links(nodes: DataFrame, prints: int, radius: int) -> DataFrame:
    """Links (u, v) between the sets s of ``nodes`` (s, fps) of which a fingerprint lies within ``radius`` bits; each kind of
    fingerprint has its own index."""
    edges = None
    for k in range(prints):
        own = nodes.select("s", F.col("fps")[k].alias("fp"))
        printed = stage_table(own.groupBy("fp").agg(F.min("s").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
        found = links(printed.select("fp"), radius)
        ends = [printed.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}")) for x in "uv"]
        across = ends[1].join(broadcast_if_small(ends[0].join(broadcast_if_small(found), "u")), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        shared = own.join(broadcast_if_small(printed.where("n > 1")), "fp").where("s <> rep").select(F.col("rep").alias("u"), F.col("s").alias("v"))
        both = across.union(shared)
        edges = both if edges is None else edges.union(both)
    return stage_table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "print_links")


def _may_link(u: str, v: str, similarity: float) -> Column:
    """Whether sizes and parity sketches (structs ``u`` and ``v`` of n and p) leave room for the similarity.  Exact: never false for a link."""
    m, n = F.col(f"{u}.n"), F.col(f"{v}.n")
    apart = sum((F.bit_count(F.col(f"{u}.p")[i].bitwiseXOR(F.col(f"{v}.p")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (F.least(m, n) >= F.ceil(similarity * F.greatest(m, n) - 1e-6)) & (apart <= (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _sketches(sets: DataFrame, node: str, sketch: str) -> DataFrame:
    return sets.select(F.col("s").alias(node), F.struct("n", "p").alias(sketch))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, bounded: bool = False) -> DataFrame:
    """The pairs (u, v) whose sets (s, n, p, items) have at least ``similarity`` of their union in common; sketches first
    (unless ``bounded``: they have been compared), so that sets travel for few pairs."""
    if not bounded:
        known = pairs.join(_sketches(sets, "u", "a"), "u").join(_sketches(sets, "v", "b"), "v")
        pairs = known.where(_may_link("a", "b", similarity)).select("u", "v")
    x, y = (sets.select(F.col("s").alias(s), F.col("items").alias(items)) for s, items in ("ux", "vy"))
    enough = F.size(F.array_intersect("x", "y")) >= F.ceil((F.size("x") + F.size("y")) * (similarity / (1 + similarity)) - 1e-6)
    return stage_table(pairs.join(x, "u").join(y, "v").where(enough).select("u", "v"), "similar")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _band_links(members: DataFrame, sets: DataFrame, known: DataFrame, similarity: float, most_joined: int = 32) -> DataFrame:
    """``known`` links and verified ones between the ``members`` (key, s, n) of shared band keys, enough of them to connect
    all that are linked.

    Buckets of up to ``most_joined`` join their members.  In a larger one a leader, the member of the largest buckets, is
    compared with all; a group of near copies is connected by that.  Components then show who is outside the bucket's
    largest one, and only these are compared with the members of other components.  Sketches decide inside both joins, so rows
    come out for pairs that nearly certainly link, and no link between two components is left out.
    """
    left, right = (members.where(F.col("n") <= most_joined).select("key", F.col("s").alias(x)) for x in "uv")
    found = known.union(_similar(left.join(right, "key").where("u < v").select("u", "v").distinct(), sets, similarity))
    hot = members.where(F.col("n") > most_joined).select("key", "s", "n")
    if hot.isEmpty():
        return found
    hot = stage_table(hot.join(_sketches(sets, "s", "a"), "s"), "hot")
    weights = hot.groupBy("s").agg(F.sum("n").alias("weight"))
    led = hot.select("key", "s").join(weights, "s").groupBy("key").agg(F.max_by("s", F.struct("weight", "s")).alias("u"))
    led = stage_table(led.join(_sketches(sets, "u", "b"), "u"), "leaders")
    tried = hot.join(broadcast_if_small(led), (hot["key"] == led["key"]) & _may_link("a", "b", similarity)).select("u", F.col("s").alias("v"))
    found = found.union(_similar(_ordered(tried), sets, similarity, bounded=True))
    roots = stage_table(components(found), "roots")
    placed = hot.join(broadcast_if_small(roots), F.col("s") == F.col("node"), "left").select("key", "s", "a", F.coalesce("root", "s").alias("root"))
    placed = stage_table(placed, "placed")
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    home = shares.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("home"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    outside = placed.join(broadcast_if_small(stage_table(home, "home")), "key").where("root <> home")
    outside = stage_table(outside.select(F.col("key").alias("own_key"), F.col("s").alias("u"), F.col("a").alias("b"), F.col("root").alias("own_root")), "outside")
    apart = (F.col("key") == F.col("own_key")) & (F.col("root") != F.col("own_root")) & _may_link("a", "b", similarity)
    across = placed.join(broadcast_if_small(outside), apart).select("u", F.col("s").alias("v"))
    more = _similar(_ordered(across), sets, similarity, bounded=True)
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)


def _kept(docs: DataFrame, printed: DataFrame, id_col: str, text_col: str, shingle: int, prints: int, radius: int, similarity: float, repeats: bool) -> DataFrame:
    """(__id, __t) of the first row, by (none, id, t), of each component of the shingle sets of ``printed`` (id, t, s, fps, keys); repeats: whether rows repeat an (id, t)."""
    nodes = stage_table(printed.groupBy("s").agg(F.min(_first("id", "t")).alias("first"), F.min("fps").alias("fps"), F.min("keys").alias("keys")), "sets")
    near = _print_links(nodes, prints, radius)
    keys = nodes.select(F.explode("keys").alias("key"), "s")
    shared = stage_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stage_table(keys.join(broadcast_if_small(shared), "key"), "members")
    # the texts of candidates, one a set, are read once more for their shingles
    ends = members.select("s").union(near.select("u")).union(near.select("v")).distinct()
    wanted = stage_table(nodes.join(ends, "s").select("s", F.col("first.id").alias("__id"), F.col("first.t").alias("__t")), "wanted")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _text_hash(text_col).alias("t"))
    texts = texts.join(broadcast_if_small(wanted), texts["id"].eqNullSafe(wanted["__id"]) & (texts["t"] == wanted["__t"]))
    sets = texts.select("s", shingle_sets("text", shingle).alias("x")).select("s", "x.*")
    sets = stage_table(sets.dropDuplicates(["s"]) if repeats else sets, "shingles")
    roots = stage_table(components(_band_links(members, sets, _similar(near, sets, similarity), similarity)), "roots")
    linked = nodes.select("s", "first").join(broadcast_if_small(roots), F.col("s") == F.col("node"), "left")
    best = linked.groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("first").alias("best"))
    return best.select(F.col("best.id").alias("__id"), F.col("best.t").alias("__t"))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def keep_first(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, prints: int = 1, similarity: float = 0.8
) -> DataFrame:
    """One row of each component of ``docs``, with its columns: the one of least id, then of least text hash.

    Texts link if their sets of distinct shingles have at least ``similarity`` in common.  Candidates are texts of which one of
    ``prints`` fingerprints lies within ``radius`` bits, and texts that share one of BANDS MinHash bands of the set, which
    finds nearly every pair of that similarity; each candidate is verified on the sets.
    The rows to drop are named by (id, text hash).  Few of them are broadcast, so that texts don't move; beyond the bound
    the join shuffles.  Rows repeated in id and text are reduced to the one whose JSON is least.
    """
    text_hash = _text_hash(text_col)
    printed = docs.select(F.col(f"`{id_col}`").alias("id"), text_hash.alias("t"), signatures(F.col(f"`{text_col}`"), shingle, prints).alias("x"))
    printed = stage_table(printed.select("id", "t", "x.*"), "prints")
    rows = stage_table(printed.groupBy("id", "t").agg(F.count(F.lit(1)).alias("n")), "rows")
    repeats = not rows.where("n > 1").isEmpty()
    kept = _kept(docs, printed, id_col, text_col, shingle, prints, radius, similarity, repeats).withColumn("kept", F.lit(True))
    ruled = rows.join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left").select(
        F.col("id").alias("__id"), F.col("t").alias("__t"), "n", F.coalesce("kept", F.lit(False)).alias("kept")
    )
    ruled = stage_table(ruled.where("n > 1 or not kept"), "ruled")
    keyed = docs.withColumn("__text_hash", text_hash)
    same = lambda other: F.col(f"`{id_col}`").eqNullSafe(other["__id"]) & (F.col("__text_hash") == other["__t"])
    once = keyed.join(broadcast_if_small(ruled), same(ruled), "left_anti")
    if not repeats:
        return once.drop("__text_hash")
    repeated = ruled.where("kept")
    again = keyed.join(broadcast_if_small(repeated), same(repeated), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    firsts = again.groupBy(f"`{id_col}`", "__text_hash").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.drop("__text_hash").union(firsts.select("__row.*"))
