"""Context-triggered piecewise hashing: fingerprints of texts that stay alike where the texts do.

A hash rolls over the last WINDOW bytes. A piece of a text ends where that hash is -1 modulo the block size, 3 * 2 ** k, so
where pieces end depends on what is there and not on how far in it stands: an edit changes the pieces around it, and the others
come out as before. Each piece gives one of 64 characters. The block size is the smallest that leaves at most MOST pieces. A
fingerprint is the block size and the signatures at it and at twice of it, `3:abc:de`; two fingerprints whose sizes are equal or one the double of the other are
compared at the sizes that both have.

Likeness is 1 less the edit distance (a character inserted or removed counts 1) over the length of both signatures, the best of the
compatible sizes; signatures without a common run of RUN characters have likeness 0, as short runs are shared by chance; equal fingerprints have 1.
Signatures fit one machine word, so distances come from a bit-parallel longest common subsequence over all rows of a batch.

The query needs each document's next one. Texts are dealt out by range of doc_id, once, and read in order; the last row of a partition
is finished by a join with the first one of the next partition, so no text but these two a partition travels again.

Defined results: a null text counts as empty (one piece, of nothing); null ids come last; rows of one doc_id are in the order of a hash of their text, equal
rows told apart by the place they were read from; the next one after the last row is the first, for a single row it is the row itself; an empty table
gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import wordscan as ws
from strandline.llm.common import free_name, input_bytes, written

WINDOW, LEAST, MOST, RUN = 7, 3, 64, 4
#: Characters of signatures: fixed values, those of base 64.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_STEP = 1 << 20
_CODE = np.full(256, 64, np.uint8)
_CODE[list(ALPHABET)] = np.arange(64)


# -- fingerprints ------------------------------------------------------------------------------------------------


def levels(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each byte of texts that begin at ``start``: how many of the block sizes LEAST * 2 ** k, from k = 0 up, have a piece end after it. The
    window holds a text's own bytes only. Works through long texts in steps, with one byte a byte kept."""
    out = np.zeros(len(body), np.uint8)
    for a in range(0, len(body), _STEP):
        b = min(len(body), a + _STEP)
        low = max(0, a - WINDOW + 1)
        seen = body[low:b].astype(np.uint32) + np.uint32(1)
        rolled = np.zeros(b - low, np.uint32)
        for k in range(min(WINDOW, b - low)):
            # each byte is mixed on its own and multiplied by a power of an odd number, so its place in the window counts
            part = seen[: b - low - k] * np.uint32(0x9E3779B1)
            part = (part ^ (part >> np.uint32(15))) * np.uint32(pow(0x01000193, k + 1, 1 << 32))
            # bytes before a text's start aren't its own
            if k:
                own = np.ones(b - low, bool)
                for s in range(k):
                    near = start[(start + s >= low) & (start + s < b)] + s - low
                    own[near] = False
                rolled[k:] += np.where(own[k:], part, np.uint32(0))
            else:
                rolled += part
        rolled ^= rolled >> np.uint32(16)
        rolled *= np.uint32(0x85EBCA6B)
        rolled ^= rolled >> np.uint32(13)
        after = rolled[a - low :].astype(np.int64) + 1
        whole = after % LEAST == 0
        third = after[whole] // LEAST
        # trailing zero bits, plus one for LEAST itself
        out[a:b][whole] = 1 + np.log2((third & -third).astype(np.float64)).astype(np.uint8)
    return out


def signatures(data: bytes, level: np.ndarray) -> tuple[int, bytes, bytes]:
    """k of the block size, and the signatures at it and at twice of it."""
    at = np.flatnonzero(level)
    high = level[at]
    held = np.bincount(high, minlength=2)[::-1].cumsum()[::-1]  # held[j]: ends of a level of j or more
    k = int(np.argmax(held[1:] < MOST)) if (held[1:] < MOST).any() else len(held) - 1
    parts = []
    for need in (k + 1, k + 2):
        cut = [0, *(at[high >= need] + 1).tolist(), len(data)]
        if len(cut) > 2 and cut[-2] == len(data):
            cut.pop()
        view = memoryview(data)
        parts.append(bytes(ALPHABET[zlib.crc32(view[a:b]) & 63] for a, b in zip(cut[:-1], cut[1:])))
    return k, parts[0], parts[1]


def written_out(k: int, fine: bytes, coarse: bytes) -> str:
    return f"{LEAST << k}:{fine.decode()}:{coarse.decode()}"


def fingerprints(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    start = np.append(0, np.cumsum([len(t) for t in texts]))
    level = levels(np.frombuffer(b"".join(texts), np.uint8), start[:-1].astype(np.int64))
    return [signatures(t, level[a:b]) for t, a, b in zip(texts, start[:-1].tolist(), start[1:].tolist())]


# -- likeness ----------------------------------------------------------------------------------------------------


def _codes(signs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as rows of codes, 64 beyond their end, and their lengths."""
    size = np.array([len(s) for s in signs], np.int64)
    out = np.full((len(signs), MOST), 64, np.uint8)
    flat = _CODE[np.frombuffer(b"".join(signs), np.uint8)]
    row = np.repeat(np.arange(len(signs)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(size))[:-1], size)] = flat
    return out, size


def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The likeness of signatures at one block size, pair by pair; 0 where they share no run of RUN characters."""
    if not a:
        return np.zeros(0)
    x, m = _codes(a)
    y, n = _codes(b)
    rows = np.arange(len(a))
    # bit i of places[row, c]: character c stands at i
    places = np.zeros((len(a), 65), np.uint64)
    for i in range(MOST):
        places[rows, x[:, i]] |= np.uint64(1 << i)
    places[:, 64] = 0
    common, run = np.zeros(len(a), bool), [np.zeros(len(a), np.uint64)] * RUN
    free = np.full(len(a), ~np.uint64(0))  # bits of x not yet the end of a longer common subsequence
    for j in range(MOST):
        here = places[rows, y[:, j]]
        hit = free & here
        free = (free + hit) | (free & ~hit)
        run = [here, *(here & (r << np.uint64(1)) for r in run[: RUN - 1])]
        common |= run[-1] != 0
    length = np.bitwise_count(~free).astype(np.int64)
    distance = m + n - 2 * length
    return np.where(common, 1 - distance / np.maximum(m + n, 1), 0.0)


def likeness(a: list[tuple[int, bytes, bytes]], b: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """The likeness of fingerprints, pair by pair, from 0 to 1."""
    out = np.zeros(len(a))
    for shift, one, other in ((0, 1, 1), (0, 2, 2), (1, 1, 2), (-1, 2, 1)):
        rows = [i for i, (p, q) in enumerate(zip(a, b)) if p[0] == q[0] + shift]
        if rows:
            out[rows] = np.maximum(out[rows], alike([a[i][one] for i in rows], [b[i][other] for i in rows]))
    return np.where([p == q for p, q in zip(a, b)], 1.0, out) if a else out


def parsed(fingerprint: str) -> tuple[int, bytes, bytes]:
    """The inverse of written_out."""
    size, fine, coarse = fingerprint.split(":")
    k = (int(size) // LEAST).bit_length() - 1
    if LEAST << k != int(size) or max(len(fine), len(coarse)) > MOST:
        raise ValueError("not a fingerprint")
    return k, fine.encode(), coarse.encode()


def compare(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """A table with the likeness of two columns of fingerprints; null where one is null."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(a).to_pylist(), batch.column(b).to_pylist()
            both = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            out = np.full(len(x), np.nan)
            out[both] = likeness([parsed(x[i]) for i in both], [parsed(y[i]) for i in both])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=[*batch.schema.names, name])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())]))


# -- a table's texts ---------------------------------------------------------------------------------------------


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The table with the fingerprint of each text as a last column."""
    name = free_name(docs, "fingerprint")

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch):
                found = fingerprints([(t or "").encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([written_out(*f) for f in found], pa.string())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = "part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ENDS = ", text string, following string, is_first boolean, is_last boolean"


def _finished(part: list[int], ids: list, texts: list[str], following: list[str], known=None) -> list[list]:
    """Columns of _ROWS. ``known``: fingerprints of the texts and of those that follow, where these are at hand."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    own = known[0] if known else fingerprints([t.encode() for t in texts])
    after = known[1] if known else fingerprints([t.encode() for t in following])
    new = fingerprints(changed)
    return [
        part, ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], [written_out(*f) for f in own], [written_out(*f) for f in new],
        likeness(own, new).tolist(), likeness(own, after).tolist(),
    ]


def _batch(columns: list[list], ends: list[list] | None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text", "following", "is_first", "is_last"]
    whole = [*columns, *(ends or [])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(whole, kinds)], names=names[: len(whole)])


def _in_order(batches):
    """Rows of a partition in order, each with its next one; the first row and the last one keep their text, and the last one has no results yet."""
    held, first = None, True
    for batch in batches:
        for piece in ws.slices(batch, "text", 2 << 20):
            part, ids, texts = (piece.column(c).to_pylist() for c in ("part", "doc_id", "text"))
            texts = [t or "" for t in texts]
            found = fingerprints([t.encode() for t in texts])
            rows = list(zip(part, ids, texts, found))
            rows = [held, *rows] if held else rows
            if len(rows) > 1:
                cols = list(zip(*rows))
                done = _finished(list(cols[0][:-1]), list(cols[1][:-1]), list(cols[2][:-1]), list(cols[2][1:]), (list(cols[3][:-1]), list(cols[3][1:])))
                n = len(rows) - 1
                yield _batch(done, [[cols[2][0] if first else None] + [None] * (n - 1), [None] * n, [first] + [False] * (n - 1), [False] * n])
                first = False
            held = rows[-1]
    if held:
        part, i, text, _ = held
        yield _batch([[part], [i], *([None] for _ in range(6))], [[text], [None], [first], [True]])


def _last_rows(batches):
    for batch in batches:
        for piece in ws.slices(batch, "text", 2 << 20):
            yield _batch(_finished(*(piece.column(c).to_pylist() for c in ("part", "doc_id", "text", "following"))), None)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash").asc(), F.col("row").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (32 << 20))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    out = written(dealt.mapInArrow(_in_order, _ROWS + _ENDS), "piecewise")

    # a row a partition: the number of the next partition with rows; after the last one, the first
    known = out.where("is_first").select("part")
    turn = Window.orderBy("part")
    after = known.select(F.col("part").alias("p"), F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    firsts = out.where("is_first").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = out.where("is_last").select("part", "doc_id", "text").join(after, F.col("part") == F.col("p")).join(firsts, "next").select("part", "doc_id", "text", "following")
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    return out.where("NOT is_last").select(*columns).unionByName(last.mapInArrow(_last_rows, _ROWS)).drop("part")


def op13_piecewise(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
