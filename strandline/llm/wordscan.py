"""Vectorised scanning of Arrow text columns: words, lines, hashes and word windows, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so the bytes of the UTF-8 text are scanned as they are.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
#: The C library's own, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, int(base)
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % 2**64
    return out


_POW = _powers(int(_BASE), _CHUNK + 1)
_INV = _powers(pow(int(_BASE), -1, 2**64), _CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and n + 1 offsets. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    at = edge[(edge > 0) & (edge < len(inside))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans are in order and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    i, n = 0, len(start)
    while i < n:
        low = start[i]
        j = int(np.searchsorted(end, low + _CHUNK, "right"))
        if j <= i:  # one span longer than a chunk: add up its pieces
            total, shift = 0, 1
            for at in range(int(low), int(end[i]), _CHUNK):
                piece = body[at : min(at + _CHUNK, int(end[i]))].astype(np.uint64) + np.uint64(1)
                total = (total + int(np.sum(piece * _POW[: len(piece)], dtype=np.uint64)) * shift) % 2**64
                shift = shift * pow(int(_BASE), len(piece), 2**64) % 2**64
            out[i] = total
            i += 1
            continue
        piece = body[low : end[j - 1]].astype(np.uint64)
        piece += np.uint64(1)
        piece *= _POW[: len(piece)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _INV[s]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * _STEP))


class Words:
    """The words of a column of texts: their spans, their hashes and, for each text, the range of its words."""

    def __init__(self, column):
        self.body, self.offsets = flat(column)
        self.space = SPACE[self.body]
        self.start, self.end = spans(~self.space, self.offsets)
        self.range = np.searchsorted(self.start, self.offsets)
        self.hash = hashes(self.body, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.range)

    def doc(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.range) - 1), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of so many words within a text, and a hash of each window."""
        return windows(self.hash, self.range, size)


def windows(hashed: np.ndarray, ranges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashed)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # by doubling: a window of 2 k elements is two windows of k; the size's bits put the windows together
    total, done, part, k = np.zeros(n + 1, np.uint64), 0, hashed, 1
    while done < size:
        if size & k:
            total = total[: n - done - k + 1] * np.uint64(pow(int(_STEP), k, 2**64)) + part[done:][: n - done - k + 1]
            done += k
        k, part = 2 * k, part[: len(part) - k] * np.uint64(pow(int(_STEP), k, 2**64)) + part[k:]
    ok = np.ones(n, bool)
    for i in range(1, size):
        at = ranges[1:] - i
        ok[at[at >= ranges[:-1]]] = False
    at = np.flatnonzero(ok[: n - size + 1])
    return at, mix(total[at])


def covered(n: int, first: np.ndarray, size: int) -> np.ndarray:
    """For n words, whether a window of the given first words covers each."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1) if len(first) < 1000 else np.add(change, np.bincount(first, minlength=n + 1), out=change, casting="unsafe")
    stop = np.bincount(first + size, minlength=n + 1) if len(first) else 0
    return np.cumsum(change - stop)[:n] > 0


def pack(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array, as a column of binary values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * width, np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpack(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of pack: all values, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(body.tobytes(), dtype), (at - at[0]) // np.dtype(dtype).itemsize


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Cut a batch so that the texts (or binary values) of each piece have about so many bytes at most; one longer text is a piece.
    After the last piece the process's free memory goes back to the system."""
    texts = batch.column(column)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"") if pa.types.is_binary(texts.type) else pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, size[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()


def release() -> None:
    """Give freed memory back: Spark keeps a Python process for the stages to come, which would hold it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between the cuts."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[cuts[1:]] - total[cuts[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ranked = keys[order]
        twin = ranked[1:] == ranked[:-1]
        out[order[1:][twin]] = True
        out[order[:-1][twin]] = True
    return out
