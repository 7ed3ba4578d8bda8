"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

Texts are cut into marked words (a run of word marks and what follows up to the next mark), which pieces never cross.  The
distinct words of a batch are sorted, which lays their trie out depth-first: each word keeps the forward states of the
prefix that it shares with the word before and computes only the rest.

Both kinds of model go through the same Viterbi trellis: a state a prefix, with the last piece of the best path to it; the path
back from a word's end is its encoding, and a shared prefix's states are those of every word that has it.  They differ in
what best means.  A unigram model adds up scores.  A BPE model orders paths by its merges, not by a sum: a path is the
encoding exactly if no merge would have joined or crossed two of its neighbours first, that is if the merges leave the text
q + p of each pair of neighbours as (q, p).  Every other path scores minus infinity, so one path survives at each prefix, and
the step tests pairs where a unigram model's step compares sums.  Either way the result is what the model's own merges or
scores give, which tests hold against the library.

Null and empty texts have no tokens.  Long texts are encoded whole; words of any length stream through the same states.
Known words are kept from batch to batch up to ``CACHE`` words and then anew.  Decoding undoes the marks; unknown
characters go through byte pieces, so every text comes back except that U+2581 itself returns as a space.  Only the named
columns are read; each row has a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

MARK = "▁"
CACHE = 800_000
PAIRS = 500_000
CHARS = 1 << 24  # above every piece id
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Model:
    """Pieces and scores of a model file; bytes: piece ids by byte; unknown: the id for characters without any."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    unigram: bool
    longest: int = 1
    pairs: dict[int, bool] = field(default_factory=dict)
    texts: dict[int, str] = field(default_factory=dict)
    reach: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.texts = {i: piece for piece, i in self.ids.items()}
        for piece in self.ids:  # by the end of a piece: no longer piece ends so
            end = piece[-2:]
            self.reach[end] = max(self.reach.get(end, 1), len(piece))

    @classmethod
    def load(cls, path: str) -> Model:
        """Read with the sentencepiece library, on the driver; the model then travels with the task."""
        import sentencepiece

        with open(path, "rb") as file:
            content = file.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = sp.get_piece_size()
        byte_ids, ids, scores = [0] * 256, {}, [sp.get_score(i) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                ids[piece] = i
        return cls(ids, scores, byte_ids, sp.unk_id(), _model_type(content) == 1, max(map(len, ids), default=1))

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if any(self.byte_ids) else [self.unknown]

    def piece_bytes(self) -> list[bytes]:
        """What each id contributes to a text, marks already spaces."""
        out = [b""] * len(self.scores)
        for piece, i in self.ids.items():
            out[i] = piece.replace(MARK, " ").encode("utf-8")
        for b, i in enumerate(self.byte_ids):
            if i:
                out[i] = bytes([b])
        return out

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the model's merges: the neighbours with the best joint piece first, leftmost of equals."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether merges leave the two pieces apart and each whole (before -1: piece alone)."""
        left, right = self.text_of(before) if before >= 0 else "", self.text_of(piece)
        return self.merged(left + right) == ([left, right] if left else [right])

    def text_of(self, piece: int) -> str:
        return self.texts[piece] if piece < CHARS else chr(piece - CHARS)

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Token ids of each of the sorted distinct ``words``.

        A state is (start, piece) of the last piece of a prefix.  A word asks for its end's state; a state asks for those
        it may build on, so prefixes at which no piece can start are never worked out.  Characters that are no piece
        have their code point plus CHARS as a piece number.
        """
        ids, longest, pairs, scores = self.ids, self.longest, self.pairs, self.scores
        unigram, pair_shift = self.unigram, CHARS + 0x110000
        least = min(scores, default=0.0) - 10.0
        get_id, get_pair, get_reach = ids.get, pairs.get, self.reach.get
        word = last = ""
        states: list[tuple[int, int] | None] = [(0, -1)]
        best = [0.0]

        def state(i: int) -> tuple[int, int]:
            j = i - get_reach(word[i - 2 : i] if i > 1 else word[0], 1)
            for j in range(j if j > 0 else 0, i):
                piece = get_id(word[j:i])
                if piece is None:
                    if j < i - 1:
                        continue
                    piece = CHARS + ord(word[j])
                before = states[j]
                if before is None:
                    before = state(j)
                key = before[1] * pair_shift + piece
                fits = get_pair(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.may_follow(before[1], piece)
                if fits:
                    found = states[i] = (j, piece)
                    return found
            raise AssertionError(f"no piece ends {word[:i]!r}")

        for word in words:
            n, k = len(word), 0
            top = min(n, len(last))
            while k < top and word[k] == last[k]:
                k += 1
            del states[k + 1 :]
            if unigram:
                del best[k + 1 :]
                for i in range(k + 1, n + 1):
                    score, found = -np.inf, (i - 1, CHARS + ord(word[i - 1]))
                    for j in range(max(0, i - longest), i):
                        p = get_id(word[j:i])
                        s = best[j] + (scores[p] if p is not None else least if j == i - 1 else -np.inf)
                        if s > score:
                            score, found = s, (j, p if p is not None else CHARS + ord(word[j]))
                    best.append(score)
                    states.append(found)
            else:
                states.extend([None] * (n - k))
                if n - k > 200:  # long words go forward, so that states never nest deeply
                    for i in range(k + 1, n):
                        if states[i] is None:
                            state(i)
                if states[n] is None:
                    state(n)
            last = word
            out: list[int] = []
            i = n
            while i:
                i, piece = states[i]
                if piece < CHARS:
                    out.append(piece)
                else:
                    out.extend(reversed(self.fallback(chr(piece - CHARS))))
            out.reverse()
            yield out


def _model_type(content: bytes) -> int:
    """Field 2.3 (trainer_spec.model_type) of the model's protocol buffer: 1 unigram, 2 BPE."""

    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
                if b < 128:
                    return value

        while at < len(data):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number()
            else:
                n = number() if kind == 2 else 8 if kind == 1 else 4
                yield key >> 3, data[at : at + n]
                at += n

    spec = next((v for k, v in fields(content) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


def marked_words(text: str) -> list[str]:
    """The words of a text: each from a run of marks up to the next, or without its mark where that is a single one."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] if len(w) > 1 and w[1] != MARK else w for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Encoder:
    """Encodes texts in groups; keeps the tokens of known words as slices of one array."""

    def __init__(self, model: Model):
        self.model, self.spans, self.flat, self.size = model, {}, np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: set[str]) -> None:
        if len(self.spans) + len(words) > CACHE:
            self.spans, self.size = {}, 0
        new = sorted(w if w[0] == MARK else MARK + w for w in words - self.spans.keys())
        for word, tokens in zip(new, self.model.encode_words(new)):
            word = word[1:] if len(word) > 1 and word[1] != MARK else word
            k, n = len(self.spans), len(tokens)
            while self.size + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            if k >= len(self.starts):
                self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
            self.flat[self.size : self.size + n] = tokens
            self.starts[k], self.lengths[k], self.spans[word] = self.size, n, k
            self.size += n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of the texts."""
        cut = [marked_words(t or "") for t in texts]
        words = list(chain.from_iterable(cut))
        if not words:
            return np.zeros(len(texts) + 1, np.int32), np.zeros(0, np.int32)
        new = set(words).difference(self.spans)
        if new:
            self.learn(new if len(new) + len(self.spans) <= CACHE else set(words))
        picked = np.array(list(map(self.spans.__getitem__, words)), np.int64)
        lengths, starts = self.lengths[picked], self.starts[picked]
        ends = np.cumsum(lengths)
        tokens = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        bounds = np.cumsum([len(own) for own in cut])
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[bounds]])
        return offsets.astype(np.int32), tokens.astype(np.int32)


def decode_tokens(pieces: list[bytes], tokens: list[int]) -> str:
    """The text of some tokens: pieces joined, the leading mark's space taken off."""
    text = b"".join([pieces[t] for t in tokens]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


GROUP_CHARS = 1_000_000


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most GROUP_CHARS bytes, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """id, n_tokens, tokens of every text; check: and round_trip, whether decoding gives the text back (marks as spaces)."""
    source = own_columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    shared = source.sparkSession.sparkContext.broadcast(model)  # as large as the model file's vocabulary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = shared.value
        encoder, pieces = Encoder(own), own.piece_bytes() if check else []
        for batch in batches:
            for start, stop in _groups(batch.column("text")):
                part = batch.slice(start, stop - start)
                texts = part.column("text").to_pylist()
                offsets, tokens = encoder.encode(texts)
                columns = [part.column("id"), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))]
                if check:
                    listed = tokens.tolist()
                    columns.append(pa.array([decode_tokens(pieces, listed[a:b]) == (t or "").replace(MARK, " ") for t, a, b in zip(texts, offsets, offsets[1:])], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "tokens", *["round_trip"] * check])

    out = source.mapInArrow(rows, f"id {kind}, n_tokens bigint, tokens array<int>" + ", round_trip boolean" * check)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model, *, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its tokens; null tokens give a null text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(model.piece_bytes())

    @F.arrow_udf("string")
    def text(tokens: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decode_tokens(pieces.value, t) for t in tokens.to_pylist()], pa.string())

    return encoded.withColumn(text_col, text(F.col(f"`{tokens_col}`")))
