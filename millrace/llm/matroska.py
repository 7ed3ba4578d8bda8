"""Media columns in Matroska: a writer and a parser of EBML, and packet tables over a column of files.

The parser walks variable-length EBML elements (sizes of one to eight bytes, unknown sizes included), reads tracks,
clusters, simple blocks and block groups with any lacing (none, Xiph, fixed, EBML) and cues, and gives one packet for each
frame: track, timestamp, key flag, byte range.  The writer stores bytes losslessly as 8-bit PCM.

Null media give no packets, and a null payload is stored as an empty one; bytes that are no Matroska give one packet row
with only ``error`` set, never a failed job.  Long payloads take as many blocks and clusters as they need.  Only the id
and media columns are read.  Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import own_columns, text_bytes

# Element ids of the Matroska specification (RFC 9559).
EBML, VOID, CRC = 0x1A45DFA3, 0xEC, 0xBF
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or segment of unknown size.
TOP = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE_HZ = 8000
FRAME = 192  # bytes, and samples, of a frame: 24 ms
LACED = 8  # frames of a laced block
BLOCKS = 16  # blocks of a cluster


def size_bytes(n: int, width: int = 0) -> bytes:
    """A length as an EBML variable-length integer, the shortest unless ``width`` is given."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if width > 8:
            raise ValueError("too long for EBML")
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(kind: int, x: float) -> bytes:
    return element(kind, np.array([x], ">f8").tobytes())


def write(payload: bytes) -> bytes:
    """An audio file of one 8-bit PCM track whose frames are ``payload``, cut every FRAME bytes; the last may be shorter.

    Blocks hold LACED frames: equal frames take fixed lacing, a block with a short last frame EBML lacing.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks = [frames[i : i + LACED] for i in range(0, len(frames), LACED)]
    ms = 1000 * FRAME // RATE_HZ
    head = element(
        EBML,
        number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2),
    )
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, 1000 * len(payload) / RATE_HZ) + element(MUXER, b"millrace") + element(WRITER, b"millrace"))
    tracks = element(
        TRACKS,
        element(
            TRACK,
            number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT")
            + number(DEFAULT_DURATION, ms * 1_000_000) + element(AUDIO, real(RATE, RATE_HZ) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
        ),
    )
    at, body, cues = len(info) + len(tracks), [info, tracks], []
    for c in range(0, len(blocks), BLOCKS):
        start = c * LACED * ms
        parts = [number(CLUSTER_TIME, start)]
        for k, laced in enumerate(blocks[c : c + BLOCKS]):
            sizes = [len(f) for f in laced]
            if len(laced) == 1:
                flags, lace = 0x80, b""
            elif len(set(sizes)) == 1:
                flags, lace = 0x84, bytes([len(laced) - 1])
            else:
                steps = (size_bytes(b - a + 63, 1) if abs(b - a) < 63 else size_bytes(b - a + 8191, 2) for a, b in zip(sizes, sizes[1:-1]))
                flags, lace = 0x86, bytes([len(laced) - 1]) + size_bytes(sizes[0]) + b"".join(steps)
            parts.append(element(SIMPLE_BLOCK, size_bytes(1) + (k * LACED * ms).to_bytes(2, "big", signed=True) + bytes([flags]) + lace + b"".join(laced)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACKS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


class Malformed(ValueError):
    """The bytes are no Matroska that this parser can read."""


@dataclass
class Parsed:
    packets: list[tuple[int, int, bool, int, int, int, int]] = field(default_factory=list)
    """(track, timestamp in ns, key, first byte, bytes, cluster number, lacing)"""
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (ns, track, byte position of the cluster)
    clusters: list[int] = field(default_factory=list)  # byte positions
    scale: int = 1_000_000


def varint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, next position, width); keep: with the length marker, as ids have it."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"the data end within an integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep else value & ((1 << 7 * width) - 1), at + width, width


def elements(data: bytes, at: int, end: int, ends: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end) of the elements in a range.  One of unknown size reaches to the range's end."""
    while at < end:
        start = at
        kind, at, _ = varint(data, at, keep=True)
        n, at, width = varint(data, at)
        stop = end if n == (1 << 7 * width) - 1 else at + n
        if stop > end:
            raise Malformed(f"element {kind:#x} at {start} is longer than what holds it")
        if n == (1 << 7 * width) - 1 and kind == CLUSTER:
            stop = at
            while stop < end:  # until the next element of the segment's own level
                k, b, _ = varint(data, stop, keep=True)
                m, b, w = varint(data, b)
                if k in TOP:
                    break
                stop = min(end, b + m)
        yield kind, start, at, stop
        at = stop


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(bytes of each frame, position of the first frame) of a laced block: 1 Xiph, 2 fixed, 3 EBML."""
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise Malformed("frames of fixed lacing differ in size")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            n, at, width = varint(data, at)
            n = n if not i else sizes[-1] + n - ((1 << 7 * width - 1) - 1)
        sizes.append(n)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Malformed("laced frames are longer than their block")
    return [*sizes, last], at


def parse(data: bytes) -> Parsed:
    out, head, offset = Parsed(), False, 0

    def block(at: int, end: int, time: int, key: bool | None) -> None:
        track, at, _ = varint(data, at)
        if at + 3 > end:
            raise Malformed("a block without a header")
        relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        at, lacing = at + 3, flags >> 1 & 3
        sizes, at = lace_sizes(data, at, end, lacing) if lacing else ([end - at], at)
        step = out.tracks.get(track, {}).get("frame_ns", 0)
        first = (time + relative) * out.scale
        if track >= 1 << 31 or not -(1 << 63) <= first <= first + step * len(sizes) < 1 << 63:
            raise Malformed("a track number or a time out of range")
        for i, n in enumerate(sizes):
            out.packets.append((track, (time + relative) * out.scale + i * step, bool(flags & 0x80) if key is None else key, at, n, len(out.clusters) - 1, lacing))
            at += n

    for kind, _, at, end in elements(data, 0, len(data)):
        head |= kind == EBML
        if kind != SEGMENT:
            continue
        offset = at
        for top, start, a, b in elements(data, at, end):
            if top == INFO:
                for k, _, x, y in elements(data, a, b):
                    out.scale = unsigned(data, x, y) if k == TIMESTAMP_SCALE else out.scale
            elif top == TRACKS:
                for k, _, x, y in elements(data, a, b):
                    if k == TRACK:
                        own = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                        if TRACK_NUMBER in own:
                            out.tracks[unsigned(data, *own[TRACK_NUMBER])] = {
                                "codec": data[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace"),
                                "type": unsigned(data, *own.get(TRACK_TYPE, (0, 0))),
                                "frame_ns": unsigned(data, *own.get(DEFAULT_DURATION, (0, 0))),
                            }
            elif top == CLUSTER:
                out.clusters.append(start - offset)
                time = 0
                for k, _, x, y in elements(data, a, b):
                    if k == CLUSTER_TIME:
                        time = unsigned(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        block(x, y, time, None)
                    elif k == BLOCK_GROUP:
                        own = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                        if BLOCK in own:
                            block(*own[BLOCK], time, REFERENCE not in own)
            elif top == CUES:
                for k, _, x, y in elements(data, a, b):
                    if k == CUE_POINT:
                        time = 0
                        for i, _, p, q in elements(data, x, y):
                            if i == CUE_TIME:
                                time = unsigned(data, p, q)
                            elif i == CUE_TRACKS:
                                own = {j: (r, s) for j, _, r, s in elements(data, p, q)}
                                if CUE_TRACK in own and CUE_CLUSTER in own:
                                    out.cues.append((time * out.scale, unsigned(data, *own[CUE_TRACK]), unsigned(data, *own[CUE_CLUSTER])))
    if not head:
        raise Malformed("no EBML header")
    return out


def payload(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The bytes of a track's packets, read at their byte ranges."""
    return b"".join(data[at : at + n] for t, _, _, at, n, _, _ in parsed.packets if t == track)


def features(parsed: Parsed, samples: bytes) -> str:
    """Counts of packets, keys, clusters, cues that hit a cluster, lacing; last timestamp; mean and power of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n = max(1, len(x))
    clusters = set(parsed.clusters)
    hits = sum(c in clusters for *_, c in parsed.cues)
    lacings = "/".join(str(sum(p[6] == k for p in parsed.packets)) for k in range(4))
    return (
        f"packets={len(parsed.packets)};keys={sum(p[2] for p in parsed.packets)};clusters={len(parsed.clusters)};cues={hits};lacing={lacings};"
        f"last_ns={max((p[1] for p in parsed.packets), default=0)};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n}"
    )


PACKETS = "track int, timestamp_ns bigint, is_key boolean, first_byte bigint, n_bytes bigint, cluster int, lacing int, error string"


def packet_table(files: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of each file: id and PACKETS."""
    source = own_columns(files, id=id_col, media=media_col)
    kind = source.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("media")[i].as_py()
                if data is None:
                    continue
                try:
                    found = [(t, ts, key, at, n, c, lace, None) for t, ts, key, at, n, c, lace in parse(data).packets]
                except (Malformed, IndexError) as e:
                    found = [(None,) * 7 + (str(e),)]
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))]
                    ids = batch.column("id").take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *(x.split()[0] for x in PACKETS.split(", "))])

    return source.mapInArrow(rows, f"id {kind}, {PACKETS}").withColumnRenamed("id", id_col)


def pad(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of FRAME bytes."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b" ")


DIGESTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each whole text as a Matroska file of 8-bit samples, read back through its packets: id and DIGESTS (and media).

    A file whose packets don't give the payload back, byte for byte, fails the job.
    """
    source = own_columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_media)]
            for text in text_bytes(batch.column("text")):
                text = text or b""
                sent = pad(text)
                media = write(sent)
                parsed = parse(media)
                back = payload(media, parsed)
                if back != sent:
                    raise AssertionError("the stored form lost bytes")
                values = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(parsed, back))
                for column, v in zip(out, values + (media,) * with_media):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(out, kinds))], ["id", *(x.split()[0] for x in DIGESTS.split(", ")), *["media"] * with_media]
            )

    return source.mapInArrow(rows, f"id {kind}, {DIGESTS}" + ", media binary" * with_media).withColumnRenamed("id", id_col)
