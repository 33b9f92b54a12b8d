"""Cutting texts where no token can cross, so that each distinct piece of text is encoded once.

The tokenizers' pattern never joins white space to a character before it, so a text falls into segments, each a run of
white space and the run of other characters after it, that are encoded alike wherever they stand. Segments are found
and told apart on whole Arrow columns; only the distinct ones become Python strings.
"""

from __future__ import annotations

import numpy as np

from strandline.llm import wordscan as ws

#: White space beyond ASCII: no cut is made right after these, the pattern may run on across them.
_WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Their UTF-8 bytes, as numbers.
_WIDE_BYTES = np.array([int.from_bytes(chr(c).encode(), "big") for c in _WIDE])


def ends_wide(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes before each place end in white space beyond ASCII."""
    back = lambda k: body[np.maximum(at - k, 0)].astype(np.int64) * (at >= k)
    two = back(2) << 8 | back(1)
    return np.isin(two, _WIDE_BYTES) | np.isin(back(3) << 16 | two, _WIDE_BYTES)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after another."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    at = np.repeat(start - before, length)
    at += np.arange(total)
    return flat[at]


class Segments:
    """The segments of a column of texts: ``which`` has for each its number among the distinct ones."""

    def __init__(self, column):
        body, offsets = ws.flat(column)
        space = ws.SPACE[body]
        cut = np.zeros(len(body), bool)
        cut[1:] = space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        cut[at[ends_wide(body, at)]] = False
        first = offsets[:-1][np.diff(offsets) > 0]
        cut[first] = True
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], len(body)) if len(self.start) else self.start
        self.range = np.searchsorted(self.start, offsets)
        self.body = body
        self.hash, where, self.which = np.unique(ws.hashes(body, self.start, self.end), return_index=True, return_inverse=True)
        self._where = where

    def spans(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chosen distinct segments in ``body``."""
        at = self._where[chosen]
        return self.start[at], self.end[at]

    def distinct(self, chosen: np.ndarray) -> list[str]:
        """The strings of the chosen distinct segments."""
        raw, (start, end) = self.body.tobytes(), self.spans(chosen)
        return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]


class Dictionary:
    """Ids of distinct segments by hash, over the batches of a worker; emptied when it is full, so memory is bounded. ``encode``
    takes Segments and the chosen ones, and gives their ids one after another, and offsets. Kept are those of up to ``short`` ids, or by default those that a batch
    has twice or more."""

    def __init__(self, encode, most: int = 150_000, short: int | None = None):
        self.encode, self.most, self.short = encode, most, short
        self._clear()

    def _clear(self) -> None:
        self.hash, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, s: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct segments one after another, and offsets."""
        at = np.searchsorted(self.hash, s.hash)
        at[at == len(self.hash)] = 0
        known = self.hash[at] == s.hash if len(self.hash) else np.zeros(len(s.hash), bool)
        new = np.flatnonzero(~known)
        flat, cuts = self.encode(s, new)
        # all segments' places in the known ids followed by the new ones
        begin, size = np.empty(len(s.hash), np.int64), np.empty(len(s.hash), np.int64)
        begin[known], size[known] = self.begin[at[known]], self.size[at[known]]
        begin[new], size[new] = cuts[:-1] + len(self.flat), np.diff(cuts)
        both = np.concatenate([self.flat, flat.astype(np.int32, copy=False)])
        out = gather(both, begin, size)
        chosen = size[new] <= self.short if self.short else np.bincount(s.which, minlength=len(s.hash))[new] > 1
        kept = new[chosen] if len(new) else new
        if len(self.hash) + len(kept) > self.most:
            self._clear()
        else:
            self._keep(s.hash[kept], gather(both, begin[kept], size[kept]), size[kept])
        return out, np.append(0, np.cumsum(size))

    def _keep(self, hashed: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        begin = np.cumsum(size) - size + len(self.flat)
        hashed, begin, size = np.append(self.hash, hashed), np.append(self.begin, begin), np.append(self.size, size)
        order = np.argsort(hashed)
        self.hash, self.begin, self.size, self.flat = hashed[order], begin[order], size[order], np.append(self.flat, ids)

    def column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and offsets."""
        s = Segments(column)
        flat, at = self.ids(s)
        size = np.diff(at)[s.which]
        return gather(flat, at[:-1][s.which], size), np.append(0, np.cumsum(size))[s.range]
