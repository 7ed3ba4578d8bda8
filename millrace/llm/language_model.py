"""LM scoring with a log-frequency Bloom filter.

Counting: each partition counts its training tokens and token pairs; the counts travel as blocks, one a segment of the hash
space, and each segment is added up in one task.  Filter: a pair or token counted c times is entered under each level from
1 to 1 + floor(log2 c), in the segment of its hash; levels are probed upwards until one is missing.  The filter's size
follows the number of entries, and the number of segments follows the text, so the error rate and the memory of a segment are
alike at every size.  A filter of up to ``max_filter_bytes`` is broadcast.  A larger one stays in a table: texts are dealt into
chunks, a chunk sends its distinct hashes to groups of segments, where they are probed, and gets the levels back; scores are the
same.  Blocks are chunks times groups, both of megabytes, so that a block holds thousands of hashes.

Score: tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z in lower case, then one end.  With the counts that
probing gives, P(w | h) = (c(h, w) + m P(w)) / (max(c(h), c(h, w)) + m) and P(w) = (c(w) + 1) / (N + V + 1); h is the token
before, or the start.

Base score: exact token counts.  The most frequent tokens (at most ``most_frequent``) are broadcast; a document's other tokens
meet their counts in a join, where no key is frequent.

Null texts count as empty: one end token.  Rows with a null id train (their remainder is null, not 2) and are scored.  Equal
rows are scored alike and each kept.  Long texts are scored whole.  No training rows: N = V = 0, every probability is that
of an unseen token.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, own_columns, remainder, stage_table, text_bytes

#: Bytes of training text that a segment stands for, and most tasks that segments are dealt to.
SEGMENT_BYTES = 4 << 20
MOST_TASKS = 8192
#: Beyond the broadcast: bytes of text that ask together, and of the filter that answer together.
CHUNK_BYTES = 8 << 20
GROUP_BYTES = 8 << 20
PROBED_TOGETHER = 200_000
BLOCK_BITS = 512
PROBES = 5
BITS_PER_ENTRY = 12
MAX_FILTER_BYTES = 128 << 20
MOST_FREQUENT = 1 << 17
#: A frequent token of more bytes is not broadcast, so that the table has a bound.
FREQUENT_BYTES = 64
#: Entries that a counting task holds before it passes them on: about 150 MB with the copies that merging makes.
FLUSH_PAIRS = 1_500_000
WAITING_PAIRS = 750_000
#: Tokens that a task numbers before it starts anew.
INDEX = 250_000
END = b""
START_HASH = np.uint64(0x51A7C0DE51A7C0DE)
SMOOTHING = 4.0
#: The count that a level stands for: level k holds counts from 2^(k-1) to 2^k - 1, of which the lower ones are more frequent.
LEVEL_COUNTS = np.array([0.0, 1.0] + [1.4 * 2.0 ** (k - 1) for k in range(2, 64)])

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * _U(0x9E3779B97F4A7C15) + after)


def token_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 7)


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


class Tokens:
    """Numbers tokens in order of appearance and keeps their hashes; ``full`` beyond INDEX tokens, when the owner resets it."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.index = _Numbers({END: 0})
        self.hashes = np.array([token_hash(END)], _U)

    def full(self) -> bool:
        return len(self.index) > INDEX

    def number(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(all tokens, their numbers, where each text ends) of some texts."""
        words: list[bytes] = []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words += text.lower().split()
            words.append(END)
            ends[i] = len(words)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > len(self.hashes):
            fresh = list(islice(self.index, len(self.hashes), None))
            self.hashes = np.concatenate([self.hashes, np.array([token_hash(w) for w in fresh], _U)])
        return words, numbers, ends

    def pairs(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the context, hash of the pair) of each token."""
        own = self.hashes[numbers]
        before = np.concatenate([[START_HASH], own[:-1]])
        before[ends[:-1]] = START_HASH
        return before, pair_hash(before, own)


def _groups(column: pa.Array, most: int = 1_000_000) -> Iterator[pa.Array]:
    """Slices of a text column of about ``most`` bytes, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(column)]):
        if b > a:
            yield column.slice(a, b - a)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes >> _U(20)).astype(np.int64) % segments


#: Bytes of a hash that tell entries of a segment apart: a segment has some hundred thousand of 2^40.
KEY_BYTES = 5
_KEY = _U((1 << 8 * KEY_BYTES) - 1)


def packed(hashes: np.ndarray) -> bytes:
    """The low KEY_BYTES of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(_U, copy=False)


def _cut(data: bytes, bounds: np.ndarray) -> pa.Array:
    """``data`` as binary values, one from each bound to the next."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _joined(values: pa.Array) -> bytes:
    return b"".join(v for v in values.to_pylist() if v)


COUNTS = "segment int, hashes binary, counts binary, tokens binary, token_counts binary"


def _count_partitions(segments: int):
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def by_segment(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments that have some, order by segment, where each of them begins and the last ends)."""
        where = segment_of(hashes, segments)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(segments + 1))
        seen = np.flatnonzero(np.diff(bounds))
        return seen, order, np.concatenate([[0], bounds[seen + 1]])

    def block(seen: np.ndarray, *values: pa.Array | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.nulls(len(seen), pa.binary()) if v is None else v for v in values)], names)

    def pair_blocks(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen, order, at = by_segment(hashes)
        yield block(seen, _cut(packed(hashes[order]), at * KEY_BYTES), _cut(counts[order].astype(np.uint32).tobytes(), at * 4), None, None)

    def token_blocks(numbering: Tokens, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(counts)
        spelled = list(numbering.index)
        seen, order, at = by_segment(mix(numbering.hashes[used]))
        own = used[order]
        words = [spelled[i] for i in own.tolist()]
        yield block(seen, None, None, pa.array([b" ".join(words[a:b]) for a, b in zip(at, at[1:])], pa.binary()), _cut(counts[own].tobytes(), at * 8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering, tokens = Tokens(), np.zeros(1, np.int64)
        waiting: list[np.ndarray] = []
        n = 0
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in _groups(batch.column("text")):
                if numbering.full():
                    yield from token_blocks(numbering, tokens)
                    numbering.reset()
                    tokens = np.zeros(1, np.int64)
                _, numbers, ends = numbering.number(text_bytes(part))
                here = np.bincount(numbers, minlength=len(numbering.hashes))
                here[: len(tokens)] += tokens
                tokens = here
                waiting.append(numbering.pairs(numbers, ends)[1])
                n += len(waiting[-1])
                if n >= WAITING_PAIRS:
                    fresh = _counted(waiting)
                    merged = [_added([*merged, fresh]) if merged else fresh]
                    waiting, n = [], 0
                    if len(merged[0][0]) >= FLUSH_PAIRS:
                        yield from pair_blocks(*merged.pop())
        if waiting:
            fresh = _counted(waiting)
            merged = [_added([*merged, fresh]) if merged else fresh]
        if merged:
            yield from pair_blocks(*merged[0])
        yield from token_blocks(numbering, tokens)

    return count


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, rising, and how often each occurs."""
    hashes = np.concatenate(parts)
    hashes.sort()
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(np.concatenate([first, [len(hashes)]]))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes added up, also those of one part."""
    hashes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """Slices of rows that follow one another with an equal key."""
    keys = batch.column(key).to_pylist()
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield keys[a], batch.slice(a, b - a)


MERGED = "segment int, hashes binary, levels binary, n_entries bigint, tokens array<binary>, token_counts array<bigint>"


def _merge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks of each segment, which come one after another."""

    def result(segment: int, pairs: list, tokens: dict[bytes, int]) -> pa.RecordBatch:
        hashes, counts = _added(pairs) if pairs else (np.zeros(0, _U), np.zeros(0, np.int64))
        # tokens are entered in the filter too, each under its own hash
        names = list(tokens)
        own = mix(np.array([token_hash(t) for t in names], _U)) & _KEY if names else np.zeros(0, _U)
        totals = np.array([tokens[t] for t in names], np.int64)
        every, times = np.concatenate([hashes, own]), np.concatenate([counts.astype(np.int64), totals])
        levels = (np.floor(np.log2(np.maximum(times, 1))) + 1).astype(np.uint8)
        arrays = [
            pa.array([segment], pa.int32()),
            pa.array([packed(every)], pa.binary()),
            pa.array([levels.tobytes()], pa.binary()),
            pa.array([int(levels.sum())], pa.int64()),
            pa.array([names], pa.list_(pa.binary())),
            pa.array([totals.tolist()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in MERGED.split(", ")])

    now, pairs, tokens, n = None, [], {}, 0
    for batch in batches:
        for segment, part in _runs(batch, "segment"):
            if segment != now:
                if now is not None:
                    yield result(now, pairs, tokens)
                now, pairs, tokens, n = segment, [], {}, 0
            hashes = unpacked(_joined(part.column("hashes")))
            if len(hashes):
                pairs.append((hashes, np.frombuffer(_joined(part.column("counts")), np.uint32).astype(np.int64)))
                n += len(hashes)
                if n >= WAITING_PAIRS:
                    pairs, n = [_added(pairs)], 0
            for names, totals in zip(part.column("tokens").to_pylist(), part.column("token_counts").to_pylist()):
                if totals:
                    for t, k in zip(names.split(b" "), np.frombuffer(totals, np.int64).tolist()):
                        tokens[t] = tokens.get(t, 0) + k
    if now is not None:
        yield result(now, pairs, tokens)


@dataclass
class Filter:
    """Bits of all segments, one after another; each is a whole number of blocks."""

    bits: np.ndarray
    blocks: int  # of a segment
    segments: int

    @staticmethod
    def places(hashes: np.ndarray, level: int | np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(block within the segment, bits within the block) of entries."""
        with np.errstate(over="ignore"):
            x = mix((hashes & _KEY) + _U(0xD1B54A32D192ED03) * np.asarray(level).astype(_U))
        block = ((x >> _U(32)) * _U(blocks)) >> _U(32)
        y = mix(x)
        return block.astype(np.int64), [((y >> _U(9 * k)) & _U(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES)]

    def _set(self, base: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return (self.bits[base + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1

    def levels(self, hashes: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The highest level of each hash that is present along with all below it; 0: none."""
        found = np.zeros(len(hashes), np.int64)
        if not len(self.bits):
            return found
        alive = np.arange(len(hashes))
        level = 1
        while len(alive) and level < 64:
            block, spots = self.places(hashes[alive], level, self.blocks)
            base = (segment[alive] * self.blocks + block) * (BLOCK_BITS // 8)
            hit = np.flatnonzero(self._set(base, spots[0]))  # most absent entries fail here
            base, alive = base[hit], alive[hit]
            for spot in spots[1:]:
                hit = hit[(on := self._set(base, spot[hit]))]
                base, alive = base[on], alive[on]
            found[alive] = level
            level += 1
        return found


def _segment_bits(blocks: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = unpacked(batch.column("hashes")[row].as_py())
                levels = np.frombuffer(batch.column("levels")[row].as_py(), np.uint8)
                bits = np.zeros(blocks * BLOCK_BITS, bool)
                for level in range(1, int(levels.max(initial=0)) + 1):
                    block, spots = Filter.places(hashes[levels >= level], level, blocks)
                    for spot in spots:
                        bits[block * BLOCK_BITS + spot] = True
                yield pa.RecordBatch.from_pydict({"segment": batch.column("segment").slice(row, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return build


@dataclass
class Model:
    counts: DataFrame  # staged (token, n) of all training tokens
    frequent: dict[bytes, int]
    bits: DataFrame  # staged (segment, bits) of the filter
    blocks: int
    segments: int
    n_bytes: int
    train_tokens: int
    distinct: int
    starts: int  # training documents

    def filter(self) -> Filter:
        """The whole filter in one piece, for a broadcast."""
        width = self.blocks * BLOCK_BITS // 8
        out = np.zeros(self.segments * width, np.uint8)
        for row in self.bits.toLocalIterator(prefetchPartitions=False) if self.n_bytes > (64 << 20) else self.bits.collect():
            out[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
        return Filter(out, self.blocks, self.segments)


def train(docs: DataFrame, *, text_col: str = "text", most_frequent: int = MOST_FREQUENT, segments: int | None = None) -> Model:
    """A model from every row of ``docs``."""
    source = own_columns(docs, text=text_col)
    if segments is None:
        segments = max(64, (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SEGMENT_BYTES)
    parts = source.mapInArrow(_count_partitions(segments), COUNTS)
    dealt = parts.repartition(min(segments, MOST_TASKS), "segment").sortWithinPartitions("segment")
    merged = stage_table(dealt.mapInArrow(_merge_segments, MERGED), "merged")
    entries = merged.agg(F.sum("n_entries")).first()[0] or 0
    blocks = max(1, -(-entries * BITS_PER_ENTRY // (segments * BLOCK_BITS)))
    bits = stage_table(merged.select("segment", "hashes", "levels").mapInArrow(_segment_bits(blocks), "segment int, bits binary"), "filter")
    counts = stage_table(merged.select(F.explode(F.arrays_zip("tokens", "token_counts")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.token_counts").alias("n")), "counts")
    drop_table(merged)
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.length("token") == 0, F.col("n"))).alias("ends")).first()
    # the least count from which all tokens fit the broadcast table: counts of counts, in eighths of a power of two
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    short = counts.where(F.octet_length("token") <= FREQUENT_BYTES)
    taken, least = 0, None
    for row in short.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("g")).collect():
        if taken + row["k"] > most_frequent:
            break
        taken, least = taken + row["k"], row["g"]
    frequent = {bytes(r["token"]): r["n"] for r in short.where(grade >= least).collect()} if least is not None else {}
    return Model(counts, frequent, bits, blocks, segments, segments * blocks * BLOCK_BITS // 8, totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0)


SCORED = "n_tokens bigint, known bigint, frequent_sum double, score double, text_hash bigint, rare array<binary>, times array<bigint>"


Levels = Callable[[np.ndarray], np.ndarray]


class Scorer:
    """Scores slices of documents; ``levels`` gives the level of each hash."""

    def __init__(self, frequent: dict[bytes, int], train_tokens: int, distinct: int, starts: int, smoothing: float):
        self.frequent, self.starts, self.smoothing = frequent, starts, smoothing
        self.total = train_tokens + distinct + 1
        self.numbering = Tokens()
        self.forget()

    def forget(self) -> None:
        """Numbers tokens anew."""
        self.numbering.reset()
        self.spelled: list[bytes] = []
        self.unigrams, self.known, self.sums = np.zeros(0), np.zeros(0, bool), np.zeros(0)

    def score(self, part: pa.RecordBatch, levels: Levels) -> pa.RecordBatch:
        """One row per document of ``part`` (id, held_out, text): id, held_out and SCORED."""
        if self.numbering.full():
            self.forget()
        return self.rate(part, *self.numbering.number(text_bytes(part.column("text")))[1:], levels)

    def score_all(self, parts: list[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
        """``score`` of each part, with one call of ``levels`` for all: each token's hash, then the pairs'."""
        self.forget()
        read = [self.numbering.number(text_bytes(p.column("text")))[1:] for p in parts]
        pairs = [self.numbering.pairs(*r)[1] for r in read]
        found = levels(np.concatenate([mix(self.numbering.hashes), *pairs]))
        given = iter(np.split(found, np.cumsum([len(self.numbering.hashes), *map(len, pairs)])[:-1]))
        for part, (numbers, ends) in zip(parts, read):
            yield self.rate(part, numbers, ends, lambda _: next(given))

    def rate(self, part: pa.RecordBatch, numbers: np.ndarray, ends: np.ndarray, levels: Levels) -> pa.RecordBatch:
        texts, numbering = text_bytes(part.column("text")), self.numbering
        if len(self.unigrams) < len(numbering.hashes):
            fresh = list(islice(numbering.index, len(self.unigrams), None))
            self.spelled += fresh
            exact = np.array([self.frequent.get(w, 0) for w in fresh], np.float64)
            own = LEVEL_COUNTS[levels(mix(numbering.hashes[len(self.unigrams) :]))]
            self.unigrams = np.concatenate([self.unigrams, own])
            self.known = np.concatenate([self.known, exact > 0])
            self.sums = np.concatenate([self.sums, np.log10(exact + 1)])
        together = LEVEL_COUNTS[levels(numbering.pairs(numbers, ends)[1])]
        own = self.unigrams[numbers]
        context = np.concatenate([[0.0], own[:-1]])
        begins = np.concatenate([[0], ends[:-1]])
        context[begins] = self.starts
        chance = (own + 1) / self.total
        p = np.log10((together + self.smoothing * chance) / (np.maximum(context, together) + self.smoothing))
        frequent_here = self.known[numbers]
        counts = np.diff(np.concatenate([[0], ends]))
        rare_at = np.flatnonzero(~frequent_here)
        owner = np.searchsorted(ends, rare_at, side="right")
        width = len(numbering.hashes) + 1
        codes, first, times = np.unique(owner * width + numbers[rare_at], return_index=True, return_counts=True)
        lists = pa.array(np.searchsorted(codes // width, np.arange(len(texts) + 1)).astype(np.int32))
        spelled = pa.array([self.spelled[i] for i in numbers[rare_at[first]].tolist()], pa.binary())
        columns = [
            part.column("id"),
            part.column("held_out"),
            pa.array(counts),
            pa.array(np.add.reduceat(frequent_here.astype(np.int64), begins)),
            pa.array(np.add.reduceat(self.sums[numbers], begins) - counts * np.log10(self.total)),
            pa.array(np.add.reduceat(p, begins)),
            pa.array(np.array([xxhash.xxh64_intdigest(t or b"") for t in texts], _U).view(np.int64)),
            pa.ListArray.from_arrays(lists, spelled),
            pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "held_out", *(x.split()[0] for x in SCORED.split(", "))])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at = 0
    for texts in _groups(batch.column("text")):
        yield batch.slice(at, len(texts))
        at += len(texts)


def _scored_by_broadcast(source: DataFrame, model: Model, smoothing: float, schema: str) -> DataFrame:
    """Every task probes the whole filter."""
    shared = source.sparkSession.sparkContext.broadcast((model.frequent, model.filter()))
    numbers = (model.train_tokens, model.distinct, model.starts, smoothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, filter = shared.value
        scorer = Scorer(frequent, *numbers)
        for batch in batches:
            for part in _parts(batch):
                yield scorer.score(part, lambda hashes: filter.levels(hashes, segment_of(hashes, filter.segments)))

    rows = stage_table(source.mapInArrow(run, schema), "scored")
    shared.destroy()
    return rows


def _by_segment(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of rising hashes by segment and hash, where each segment begins and the last ends)."""
    where = segment_of(hashes, segments)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(segments + 1))


def _scored_by_segment(source: DataFrame, model: Model, smoothing: float, schema: str) -> DataFrame:
    """Chunks of texts send their distinct hashes to groups of the filter's segments and get levels back.

    Both sides derive a chunk's hashes from its rows, in whatever order these come; the texts are dealt out once.
    """
    numbers = (model.train_tokens, model.distinct, model.starts, smoothing)
    segments, blocks = model.segments, model.blocks
    width = blocks * BLOCK_BITS // 8
    per_group = max(1, min(GROUP_BYTES // width, -(-segments // 32)))
    groups = -(-segments // per_group)
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, n_bytes // CHUNK_BYTES)
    block = "chunk bigint, part int, segment int, data binary"
    names = [x.split()[0] for x in block.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of(chunk: int, tokens: Tokens, hashes: list[np.ndarray]) -> pa.RecordBatch:
            distinct = np.unique(np.concatenate([*hashes, mix(tokens.hashes)]))
            order, bounds = _by_segment(distinct, segments)
            sent, sizes = packed(distinct[order]), np.diff(bounds).astype(np.uint32)
            cuts = [*range(0, segments, per_group), segments]
            # of each group: how many hashes each of its segments gets, then the hashes
            data = [sizes[a:b].tobytes() + sent[bounds[a] * KEY_BYTES : bounds[b] * KEY_BYTES] for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array([chunk] * groups, pa.int64()), pa.array(range(groups), pa.int32()), pa.nulls(groups, pa.int32()), pa.array(data, pa.binary())], names)

        now, tokens, hashes = None, Tokens(), []
        for batch in batches:
            for chunk, rows in _runs(batch, "chunk"):
                if chunk != now:
                    if hashes:
                        yield blocks_of(now, tokens, hashes)
                    now, hashes = chunk, []
                    tokens.reset()
                for part in _groups(rows.column("text")):
                    _, at, ends = tokens.number(text_bytes(part))
                    hashes.append(np.unique(tokens.pairs(at, ends)[1]))
        if hashes:
            yield blocks_of(now, tokens, hashes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(part: int, asked: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            own, hashes, where = zip(*asked)
            levels = filter.levels(np.concatenate(hashes), np.concatenate(where)).astype(np.uint8).tobytes()
            data = _cut(levels, np.cumsum([0, *map(len, hashes)]))
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([part] * len(own), pa.int32()), pa.nulls(len(own), pa.int32()), data], names)

        now, filter = None, None
        for batch in batches:
            for part, rows in _runs(batch, "part"):
                first = part * per_group
                here = min(per_group, segments - first)
                if part != now:
                    now, filter = part, Filter(np.zeros(here * width, np.uint8), blocks, here)
                asked, n = [], 0
                for chunk, segment, data in zip(rows.column("chunk").to_pylist(), rows.column("segment").to_pylist(), rows.column("data")):
                    if chunk is None:
                        filter.bits[(segment - first) * width : (segment - first + 1) * width] = np.frombuffer(data.as_buffer(), np.uint8)
                        continue
                    sizes = np.frombuffer(data.as_buffer(), np.uint32, here)
                    asked.append((chunk, unpacked(data.as_buffer()[4 * here :]), np.repeat(np.arange(here), sizes)))
                    n += len(asked[-1][1])
                    if n >= PROBED_TOGETHER:
                        yield answer(part, asked)
                        asked, n = [], 0
                if asked:
                    yield answer(part, asked)

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        answered = np.frombuffer(_joined(found.sort_by("part").column("data")), np.uint8)

        def levels(hashes: np.ndarray) -> np.ndarray:
            distinct, inverse = np.unique(hashes, return_inverse=True)
            if len(distinct) != len(answered):
                raise RuntimeError("the rows of a chunk have changed between two reads of the input")
            rising = np.empty(len(distinct), np.int64)
            rising[_by_segment(distinct, segments)[0]] = answered
            return rising[inverse]

        parts = [p for b in rows.select(["id", "held_out", "text"]).to_batches() for p in _parts(b)]
        return pa.Table.from_batches(Scorer(shared.value, *numbers).score_all(parts, levels))

    tasks = min(chunks, MOST_TASKS)
    # copies of a row go apart by the partition they come from
    chunk = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)).alias("chunk")
    dealt = source.select(chunk, "id", "held_out", "text").repartition(tasks, "chunk")
    shared = source.sparkSession.sparkContext.broadcast(model.frequent)
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(ask, block)
    bits = model.bits.select(F.lit(None).cast("long").alias("chunk"), F.floor(F.col("segment") / per_group).cast("int").alias("part"), "segment", F.col("bits").alias("data"))
    # bits have no chunk, and so come before the blocks that probe them
    met = bits.union(asked).repartition(min(groups, MOST_TASKS), "part").sortWithinPartitions("part", F.asc_nulls_first("chunk")).mapInArrow(probe, block)
    answers = met.select("chunk", "part", "data").repartition(tasks, "chunk")
    rows = stage_table(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema), "scored")
    shared.destroy()
    return rows


def score(
    docs: DataFrame,
    model: Model,
    held_out: Column | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    smoothing: float = SMOOTHING,
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    source = own_columns(docs, id=id_col, text=text_col).withColumn("held_out", F.lit(False) if held_out is None else held_out)
    kind = source.schema["id"].dataType.simpleString()
    scored = _scored_by_broadcast if model.n_bytes <= max_filter_bytes else _scored_by_segment
    rows = scored(source, model, smoothing, f"id {kind}, held_out boolean, {SCORED}")
    rare = rows.select("id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", "text_hash", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    met = rare.join(model.counts, "token").select("id", "text_hash", (F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"), "times")
    # one row of each text, with how many rows it stands for, and the sums of its rare tokens; no row is joined by id
    none = lambda t: F.lit(None).cast(t)
    plain = rows.select("id", "text_hash", "held_out", "n_tokens", "known", "frequent_sum", "score", F.lit(1).alias("copies"), F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("times"))
    gains = met.select("id", "text_hash", none("boolean").alias("held_out"), none("long").alias("n_tokens"), none("long").alias("known"), none("double").alias("frequent_sum"), none("double").alias("score"), F.lit(0).alias("copies"), "gain", "times")
    both = plain.union(gains).groupBy("id", "text_hash").agg(*(F.max(c).alias(c) for c in ("held_out", "n_tokens", "known", "frequent_sum", "score")), *(F.sum(c).alias(c) for c in ("copies", "gain", "times")))
    each = both.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("times") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("frequent_sum") + F.col("gain") / F.col("copies")).alias("base_score"),
        "score",
    )


def score_held_out(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, max_filter_bytes: int = MAX_FILTER_BYTES, **options
) -> DataFrame:
    """Trains on the rows whose crc32(id) mod ``modulus`` is not ``held`` and scores all."""
    out = F.coalesce(remainder(id_col, modulus) == held, F.lit(False))
    model = train(docs.where(~out), text_col=text_col, **options)
    held_out = F.coalesce(remainder("id", modulus) == held, F.lit(False))
    return score(docs, model, held_out, id_col=id_col, text_col=text_col, max_filter_bytes=max_filter_bytes)
