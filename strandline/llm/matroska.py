"""Media columns: Matroska files of 8-bit audio, written, parsed and read back.

A file is a tree of EBML elements: an id and a size of variable length, then data. write_file() makes one audio track
of unsigned 8-bit PCM at RATE samples a second: blocks of BLOCK samples in clusters of CLUSTER blocks, small blocks
laced with fixed sizes, and cues to the clusters. parse() reads any file of this container: elements of known and of
unknown size, clusters, simple blocks and block groups, all four kinds of lacing, tracks and cues; it gives a table
of packets, each with its track, time in nanoseconds, and range of bytes in the file.

The column operators keep a file a row. store() makes a column of files, which the query writes as a table to the shared folder; all that
it returns is computed from the bytes that it reads back from there, so an executor that is lost costs its own rows only. seek()
goes by the cues: it parses the head, the cues and the one cluster that holds a time. Memory is a few times the longest file.

Defined results: each row is a file of its own, so rows that repeat, and null ids, are rows of the result, and equal texts give equal
files; a text of any length is stored whole; other columns, whatever their names, aren't looked at; a null medium has no packets; bytes that are no EBML, a size beyond its parent, or broken lacing raise
ValueError; an empty payload is stored as 64 zero bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordscan as ws
from strandline.llm.common import written

RATE, BLOCK, CLUSTER, UNIT = 8000, 4096, 32, 64

# Element ids of the Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, LACING_FLAG = 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK_ID, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, MUXING_APP, WRITING_APP = 0x4282, 0x4D80, 0x5741


# -- writing ----------------------------------------------------------------------------------------------------


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, length: int | None = None) -> bytes:
    """A number of variable length: as many leading zeros as bytes follow, then a one. All ones mean an unknown size."""
    n = length or next(i for i in range(1, 9) if x < (1 << 7 * i) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, data: bytes) -> bytes:
    return _id(name) + vint(len(data)) + data


def _uint(name: int, x: int) -> bytes:
    return element(name, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_INFO = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"strandline") + element(WRITING_APP, b"strandline"))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING_FLAG, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, UNIT * 1_000_000_000 // RATE) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def write_file(samples: bytes) -> bytes:
    """A file of the samples. Their number is a multiple of UNIT; each block is laced into frames of UNIT samples."""
    clusters, cues, at = [], [], len(_INFO) + len(_TRACKS)
    for c in range(0, len(samples), BLOCK * CLUSTER):
        time = c * 1000 // RATE
        body = [_uint(TIMESTAMP, time)]
        for b in range(c, min(c + BLOCK * CLUSTER, len(samples)), BLOCK):
            data = samples[b : b + BLOCK]
            frames = len(data) // UNIT
            # fixed-size lacing (flags 0x04) where a block has several frames
            lace = bytes([0x84, frames - 1]) if frames > 1 else b"\x80"
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", b * 1000 // RATE - time) + lace + data))
        cluster = element(CLUSTER_ID, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        clusters.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, _INFO + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


# -- parsing ----------------------------------------------------------------------------------------------------


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frame_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    #: (track, time in ns, first byte, length, key frame)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    #: (time in ns, track, first byte of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _number(b, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """A variable-length number, the place after it, and whether it is all ones."""
    if at >= end or not b[at]:
        raise ValueError("no variable-length number")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise ValueError("a number goes beyond its parent")
    raw = int.from_bytes(b[at : at + n], "big")
    low = raw & (1 << 7 * n) - 1
    return (raw if keep else low), at + n, low == (1 << 7 * n) - 1


_PARENTS = {SEGMENT, CLUSTER_ID}
#: What ends a cluster or segment of unknown size: an element that can't be inside.
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


def _elements(b, at: int, end: int, of: int = 0):
    """(id, first byte, end) of each element; one of unknown size ends where an element begins that can't be in it."""
    while at < end:
        name, p, _ = _number(b, at, end, keep=True)
        size, p, unknown = _number(b, p, end)
        if unknown:
            if name not in _PARENTS:
                raise ValueError("an element of unknown size that is no segment or cluster")
            stop = _end_of_unknown(b, p, end, name)
        else:
            stop = p + size
            if stop > end:
                raise ValueError("an element goes beyond its parent")
        yield name, p, stop
        at = stop


def _end_of_unknown(b, at: int, end: int, name: int) -> int:
    while at < end:
        inner, p, _ = _number(b, at, end, keep=True)
        if inner in ({EBML, SEGMENT} if name == SEGMENT else _TOP):
            return at
        size, p, unknown = _number(b, p, end)
        at = _end_of_unknown(b, p, end, inner) if unknown else p + size
    return end


def _value(b, at: int, stop: int) -> int:
    return int.from_bytes(b[at:stop], "big")


def _real(b, at: int, stop: int) -> float:
    return struct.unpack(">f" if stop - at == 4 else ">d", b[at:stop])[0] if stop > at else 0.0


def _block(b, at: int, stop: int, time: int, media: Media, simple: bool) -> None:
    track, at, _ = _number(b, at, stop)
    if at + 3 > stop:
        raise ValueError("a block without a head")
    shift = int.from_bytes(b[at : at + 2], "big", signed=True)
    flags = b[at + 2]
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        sizes = [stop - at]
    else:
        if at >= stop:
            raise ValueError("lacing without a count")
        n = b[at] + 1
        at += 1
        if kind == 2:  # fixed sizes
            if (stop - at) % n:
                raise ValueError("fixed-size lacing doesn't divide its block")
            sizes = [(stop - at) // n] * n
        elif kind == 1:  # sizes as sums of bytes, the last one by what is left
            sizes = []
            for _ in range(n - 1):
                size = 0
                while True:
                    if at >= stop:
                        raise ValueError("lacing goes beyond its block")
                    x = b[at]
                    size, at = size + x, at + 1
                    if x != 255:
                        break
                sizes.append(size)
            sizes.append(stop - at - sum(sizes))
        else:  # the first size, then signed differences
            size, at, _ = _number(b, at, stop) if n > 1 else (stop - at, at, False)
            sizes = [size]
            for _ in range(n - 2):
                p = at
                x, at, _ = _number(b, at, stop)
                sizes.append(sizes[-1] + x - ((1 << 7 * (at - p) - 1) - 1))
            if n > 1:
                sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > stop:
        raise ValueError("laced frames go beyond their block")
    begin = (time + shift) * media.scale
    each = media.tracks[track].frame_ns if track in media.tracks else 0
    for i, size in enumerate(sizes):
        media.packets.append((track, begin + i * each, at, size, bool(flags & 0x80) or not simple))
        at += size


def _cluster(b, at: int, stop: int, media: Media) -> None:
    time = 0
    for n, p, q in _elements(b, at, stop):
        if n == TIMESTAMP:
            time = _value(b, p, q)
        elif n == SIMPLE_BLOCK:
            _block(b, p, q, time, media, True)
        elif n == BLOCK_GROUP:
            for m, r, s in _elements(b, p, q):
                if m == BLOCK_ID:
                    _block(b, r, s, time, media, False)


def parse(b: bytes, clusters: bool = True) -> Media:
    """The tracks, packets and cues of a file; without ``clusters``, its packets are passed over."""
    media, seen = Media(), False
    for name, at, stop in _elements(b, 0, len(b)):
        if name == EBML:
            seen = True
        elif name == SEGMENT:
            base = at
            for name, at, stop in _elements(b, at, stop):  # noqa: B020, PLW2901
                if name == INFO:
                    for n, p, q in _elements(b, at, stop):
                        if n == TIMESTAMP_SCALE:
                            media.scale = _value(b, p, q)
                elif name == TRACKS:
                    for n, p, q in _elements(b, at, stop):
                        if n == TRACK_ENTRY:
                            t = _track(b, p, q)
                            media.tracks[t.number] = t
                elif name == CLUSTER_ID and clusters:
                    _cluster(b, at, stop, media)
                elif name == CUES:
                    for n, p, q in _elements(b, at, stop):
                        if n == CUE_POINT:
                            _cue(b, p, q, base, media)
    if not seen:
        raise ValueError("no EBML head")
    return media


def _track(b, at: int, stop: int) -> Track:
    t = Track()
    for n, p, q in _elements(b, at, stop):
        if n == TRACK_NUMBER:
            t.number = _value(b, p, q)
        elif n == TRACK_TYPE:
            t.kind = _value(b, p, q)
        elif n == CODEC_ID:
            t.codec = bytes(b[p:q]).rstrip(b"\0").decode()
        elif n == DEFAULT_DURATION:
            t.frame_ns = _value(b, p, q)
        elif n == AUDIO:
            for m, r, s in _elements(b, p, q):
                if m == SAMPLING_FREQUENCY:
                    t.rate = _real(b, r, s)
                elif m == CHANNELS:
                    t.channels = _value(b, r, s)
                elif m == BIT_DEPTH:
                    t.bits = _value(b, r, s)
    return t


def _cue(b, at: int, stop: int, base: int, media: Media) -> None:
    time = 0
    for n, p, q in _elements(b, at, stop):
        if n == CUE_TIME:
            time = _value(b, p, q) * media.scale
        elif n == CUE_POSITIONS:
            got = {m: _value(b, r, s) for m, r, s in _elements(b, p, q)}
            media.cues.append((time, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))


def payload(b: bytes, track: int = 1, media: Media | None = None) -> bytes:
    """The bytes of a track's packets, in order of the file."""
    return b"".join(b[at : at + n] for t, _, at, n, _ in (media or parse(b)).packets if t == track)


def features(media: Media, samples: bytes) -> str:
    """Of the samples read back: packets, milliseconds, mean, mean square around 128, and crossings of the mean."""
    x = np.frombuffer(samples, np.uint8)
    total, power = int(x.sum(dtype=np.int64)), int(np.square(x.astype(np.int32) - 128).sum(dtype=np.int64))
    n = max(1, len(x))
    above = x > total // n
    crossings = int((above[1:] != above[:-1]).sum())
    return f"packets={len(media.packets)};ms={len(x) * 1000 // RATE};mean={total * 1000 // n};power={power * 1000 // n};crossings={crossings}"


# -- columns ----------------------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and ``media``: a file of its bytes, filled up with zeros to a multiple of UNIT."""

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch, "text", 2 << 20):
                body, at = ws.flat(part.column("text"))
                raw = body.tobytes()
                files = [write_file(raw[a:b] + bytes(-(b - a) % UNIT if b > a else UNIT)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """A row a packet: key, track, codec, packet (number), time_ns, start and length (bytes of the file), key_frame."""
    from pyspark.sql import types as T

    schema = T.StructType([media.schema[key], *T._parse_datatype_string("track int, codec string, packet int, time_ns long, start long, length long, key_frame boolean").fields])

    def run(batches):
        for batch in batches:
            for i, b in enumerate(batch.column(column)):
                if b.as_py() is None:
                    continue
                m = parse(b.as_py())
                for k in range(0, len(m.packets), 10_000):
                    some = m.packets[k : k + 10_000]
                    track, time, at, n, whole = zip(*some)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(key).take(pa.array([i] * len(some))), pa.array(track, pa.int32()), pa.array([m.tracks[t].codec if t in m.tracks else None for t in track], pa.string()), pa.array(range(k, k + len(some)), pa.int32()), pa.array(time, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.bool_())],
                        names=schema.names,
                    )

    return media.select(key, column).mapInArrow(run, schema)


def read_back(media: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and, from the stored bytes: payload, feature. Each cue must name a cluster of its own."""
    from pyspark.sql import types as T

    schema = T.StructType([*media.select(*columns).schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch, "media", 2 << 20):
                data, feature = [], []
                for b in part.column("media").to_pylist():
                    m = parse(b) if b is not None else None
                    if m and any(b[at : at + 4] != _id(CLUSTER_ID) for _, _, at in m.cues):
                        raise ValueError("a cue that points at no cluster")
                    data.append(payload(b, 1, m) if m else None)
                    feature.append(features(m, data[-1]) if m else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(data, pa.binary()), pa.array(feature, pa.string())], names=[*columns, "payload", "feature"])

    return media.mapInArrow(run, schema)


def seek(b: bytes, time_ns: int, track: int = 1) -> list[tuple[int, int, int, int, bool]]:
    """The packets of the cluster that a track's cues name for a time: the last that begins by then, or else the first. Other clusters are passed over."""
    head = parse(b, clusters=False)
    cues = sorted((t, at) for t, n, at in head.cues if n == track)
    if not cues:
        return []
    _, at = max((c for c in cues if c[0] <= time_ns), default=cues[0])
    name, p, stop = next(_elements(b, at, len(b)))
    if name != CLUSTER_ID:
        raise ValueError("a cue that points at no cluster")
    part = Media(head.scale, head.tracks)
    _cluster(b, p, stop, part)
    return [x for x in part.packets if x[0] == track]


def op9_matroska(spark, sf_dir: str) -> DataFrame:
    media = written(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    back = read_back(media, ["doc_id", "n_bytes", "media"])
    size = F.octet_length("payload")
    tail = F.substring("payload", -UNIT, UNIT)
    return back.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature"
    )


def op9_matroska_payload(spark, sf_dir: str) -> DataFrame:
    """What of op9_matroska SQL can express: the payload."""
    return op9_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


OP9_PAYLOAD_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n FROM d),
p AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS pad, b FROM n)
SELECT doc_id, n AS n_bytes, (n + pad)::BIGINT AS payload_bytes, sha256(b || unhex(repeat('00', pad::INTEGER))) AS payload_sha256 FROM p
"""
