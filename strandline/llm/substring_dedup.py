"""Substring dedup by seed and extend.

Anchors are winnowed from the hashes of SEED consecutive words: of every window of ``length`` words the rightmost
smallest hash is kept, so two equal windows always keep the same anchor at the same place. Documents are joined on
their anchors, each with the first document that has one. From a shared anchor the match is extended both ways, as far as a window
around it may reach: where all places of an anchor go on alike to both sides, the match with the first document is told
from two hashes of what stands around it. Where they don't (at the ends of passages, and around edits), the windows at
this anchor are compared one by one among all documents that have it. Overlapping matches make the maximal repeats, each of
``length`` words or more; a word goes if it lies in one that repeats an earlier document.

Only anchors are joined, and only windows at anchors that go on differently travel. Nothing is paired: an anchor or window
travels once for each block of documents, not once for each document or pair, so a passage that a third of all documents
hold costs as much as one that few hold. Rows between the steps are packed arrays, one for each pair of a block of
documents and a range of hashes that it has any of.

Defined results: a null text has no words; texts under ``length`` words lose nothing; of equal texts the smallest id
keeps its words; rows that repeat a doc_id are one document for the comparison of ids, each row with its own words; a
null doc_id counts as larger than all others; other columns, whatever their names, aren't looked at; a text of any length is taken
whole. Windows are the same if their 64-bit hashes and those of their anchors are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordscan as ws
from strandline.llm.common import block_count, block_of, docs_of, written

LENGTH, SEED = 13, 7
_LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    column = table.column("doc_id")
    return column.fill_null(_LAST).to_numpy()


class Anchors:
    """The windows of ``length`` words of a column of texts (first word, hash, number of their anchor), and their anchors: the gram's
    hash, the text, the first and last window that hold the gram, and a hash of all that stands in these."""

    def __init__(self, words: ws.Words, length: int, seed: int):
        self.words, self.length = words, length
        self.at, self.window = words.windows(length)
        if not len(self.at):
            self.of, self.hash, self.doc, self.low, self.high, self.wide = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
            return
        _, grams = ws.windows(words.hash, np.array([0, len(words.hash)]), seed)  # also across texts: those aren't looked up
        best, place = grams[self.at], self.at.copy()
        for i in range(1, length - seed + 1):
            gram = grams[self.at + i]
            less = gram <= best
            best[less], place[less] = gram[less], self.at[less] + i
        # the rightmost smallest never goes back, so windows of one anchor stand together
        new = np.append(True, place[1:] != place[:-1])
        self.of, place = np.cumsum(new) - 1, place[new]
        self.hash = ws.mix(best[new] + np.uint64(1))  # smallest hashes are small: spread them, as ranges of hashes are dealt out
        self.doc = words.doc()[place]
        self.low = np.maximum(place - (length - seed), words.range[self.doc])
        self.high = np.minimum(place, words.range[self.doc + 1] - length)
        # the outermost windows cover all words that any window with this gram has
        ends = [self.window[np.searchsorted(self.at, x)] for x in (self.low, self.high)]
        shape = (place - self.low).astype(np.uint64) * np.uint64(64) + (self.high - self.low).astype(np.uint64)
        self.wide = ws.mix(ws.mix(ends[0] + shape) + ends[1] * np.uint64(0x9E3779B97F4A7C15))

    def covered(self, windows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The words in the given windows, and in all windows with the given anchors: maximal repeats are the runs of these."""
        begin = np.concatenate([self.at[windows], self.low[places]])
        end = np.concatenate([self.at[windows], self.high[places]]) + self.length
        n = len(self.words.start) + 1
        return np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0


def _by_bucket(bucket_count: int, key: np.ndarray, *columns: np.ndarray):
    """Cut sorted keys into ranges of hashes, one for each bucket."""
    cut = np.searchsorted(key, np.arange(bucket_count, dtype=np.uint64) * np.uint64((2**64 - 1) // bucket_count))
    at = np.append(cut, len(key))
    full = np.flatnonzero(np.diff(at))
    offsets = np.append(at[full], len(key))
    return full, [ws.pack(c, offsets) for c in (key, *columns)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


_MANY, _MIXED = 1, 2


def _seeds(length: int, seed: int, buckets: int):
    """Of a block's documents each distinct anchor, with the first document that has it, what stands around it there, and whether
    several documents have it and whether it goes on differently."""

    def one(table: pa.Table) -> pa.Table:
        a = Anchors(ws.Words(table.column("text")), length, seed)
        doc = _ids(table)[a.doc]
        order = np.lexsort((doc, a.hash))
        key, doc, wide = a.hash[order], doc[order], a.wide[order]
        begin = _groups(key)
        size = np.diff(np.append(begin, len(key)))
        many = doc[begin] != doc[begin + size - 1]
        mixed = np.bitwise_or.reduceat(wide != np.repeat(wide[begin], size), begin) if len(begin) else many
        full, (keys, docs, wides, flags) = _by_bucket(buckets, key[begin], doc[begin], wide[begin], (many * _MANY + mixed * _MIXED).astype(np.uint8))
        block = table.column("block")[0].as_py() if len(table) else 0
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "keys": keys, "docs": docs, "wides": wides, "flags": flags})

    return one


def _join_seeds(table: pa.Table) -> pa.Table:
    """Of each block's anchors those that another document has too: ``keys`` and ``firsts`` (the first document) of those that go on alike
    everywhere, and ``rest``."""
    key, at = ws.unpack(table.column("keys"), np.uint64)
    doc, wide, flags = (ws.unpack(table.column(c), t)[0] for c, t in (("docs", np.int64), ("wides", np.uint64), ("flags", np.uint8)))
    block = table.column("block").to_numpy()
    order = np.lexsort((doc, key))
    begin = _groups(key[order])
    size = np.diff(np.append(begin, len(key)))
    whole = lambda x: np.repeat(np.bitwise_or.reduceat(x, begin), size) if len(begin) else x
    first, its = np.repeat(doc[order][begin], size), np.repeat(wide[order][begin], size)
    shared = np.repeat(size > 1, size) | whole((flags[order] & _MANY) > 0)
    differs = whole(((flags[order] & _MIXED) > 0) | (wide[order] != its))
    back = np.empty(len(key), np.int64)
    back[order] = np.arange(len(key))
    first, shared, differs = first[back], shared[back], differs[back]
    alike = shared & ~differs & ((doc > first) | ((flags & _MANY) > 0))
    rest = shared & differs
    cuts = lambda keep: np.append(0, np.cumsum(keep))[at]
    out = pa.table({"block": pa.array(block, pa.int32()), "keys": ws.pack(key[alike], cuts(alike)), "firsts": ws.pack(first[alike], cuts(alike)), "rest": ws.pack(key[rest], cuts(rest))})
    return out.filter(pa.array((np.diff(cuts(alike)) + np.diff(cuts(rest))) > 0))


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is among sorted keys, and whether it is."""
    if not len(sorted_keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == x


def _open(a: Anchors, seeds: pa.Table) -> np.ndarray:
    """The windows at anchors that go on differently."""
    rest = np.sort(ws.unpack(seeds.column("rest"), np.uint64)[0])
    return np.flatnonzero(_find(rest, a.hash)[1][a.of]) if len(a.at) else a.at


def _extend(length: int, seed: int, buckets: int):
    """Those windows, each with the first of the block's documents that has it."""

    def one(key, texts: pa.Table, seeds: pa.Table) -> pa.Table:
        a = Anchors(ws.Words(texts.column("text")), length, seed)
        some = _open(a, seeds)
        window, anchor, doc = a.window[some], a.hash[a.of[some]], _ids(texts)[a.doc[a.of[some]]]
        order = np.lexsort((doc, anchor, window))
        first = order[_groups(window[order], anchor[order])]
        full, (keys, anchors, docs) = _by_bucket(buckets, window[first], anchor[first], doc[first])
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()), "keys": keys, "anchors": anchors, "docs": docs})

    return one


def _first_of(table: pa.Table) -> pa.Table:
    """Of each block's windows, those that start in a document with a smaller id than all of the block's that have it."""
    key, at = ws.unpack(table.column("keys"), np.uint64)
    anchor, doc = ws.unpack(table.column("anchors"), np.uint64)[0], ws.unpack(table.column("docs"), np.int64)[0]
    order = np.lexsort((doc, anchor, key))
    begin = _groups(key[order], anchor[order])
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(doc[order][begin], np.diff(np.append(begin, len(key))))
    gone = least < doc
    cuts = np.append(0, np.cumsum(gone))[at]
    return pa.table({"block": table.column("block"), "gone": ws.pack(key[gone], cuts)}).filter(pa.array(np.diff(cuts) > 0))


def _cut(length: int, seed: int, texts_out: bool):
    def one(key, texts: pa.Table, known: pa.Table) -> pa.Table:
        words = ws.Words(texts.column("text"))
        a = Anchors(words, length, seed)
        ids = _ids(texts)
        # anchors that go on alike in the first document and here
        keys, firsts = ws.unpack(known.column("keys"), np.uint64)[0], ws.unpack(known.column("firsts"), np.int64)[0]
        order = np.argsort(keys)
        at, found = _find(keys[order], a.hash)
        places = np.flatnonzero(found & (ids[a.doc] > firsts[order][at] if len(keys) else found))
        # windows at the other ones, that an earlier document of another block has, or of this one
        some = _open(a, known)
        window, anchor, doc = a.window[some], a.hash[a.of[some]], ids[a.doc[a.of[some]]]
        gone = np.sort(ws.unpack(known.column("gone"), np.uint64)[0])
        hit = _find(gone, window)[1]
        order = np.lexsort((doc, anchor, window))
        begin = _groups(window[order], anchor[order])
        hit[order] |= doc[order] > np.repeat(doc[order][begin], np.diff(np.append(begin, len(order))))
        gone_words = a.covered(some[hit], places)
        out = {"doc_id": texts.column("doc_id"), "n_words": pa.array(words.counts, pa.int64())}
        total = np.append(0, np.cumsum(gone_words))
        out["n_removed"] = pa.array(total[words.range[1:]] - total[words.range[:-1]], pa.int64())
        kept_text = _joined(words, ~gone_words)
        if texts_out:
            out["text"] = pa.array([x.decode() for x in kept_text], pa.string())
        else:
            out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept_text], pa.string())
        return pa.table(out)

    return one


def _joined(words: ws.Words, keep: np.ndarray) -> list[bytes]:
    """For each text, its kept words joined by one space."""
    start, end = words.start[keep], words.end[keep]
    kept = np.append(0, np.cumsum(keep))[words.range]
    width = end - start + 1
    to = np.append(0, np.cumsum(width))
    take = np.ones(len(words.body) + 1, np.int8)
    # bytes of kept words stay, and one space after each
    mark = np.zeros(len(words.body) + 2, np.int32)
    np.add.at(mark, start, 1) if len(start) < 1000 else mark.__setitem__(start, mark[start] + 1)
    mark[end] -= 1
    take = np.cumsum(mark)[: len(words.body)] > 0
    body = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    body[inside] = words.body[take]
    out = body.tobytes()
    cut = to[kept]
    return [out[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the text of the kept words, or with texts=False its sha256 (``kept_sha256``)."""
    n = block_count(docs)
    blocks = docs_of(docs).withColumn("block", block_of(F.coalesce("doc_id", F.xxhash64("text")), n))  # rows without an id are dealt out by their texts
    found = blocks.groupBy("block").applyInArrow(_seeds(length, seed, n), "bucket int, block int, keys binary, docs binary, wides binary, flags binary")
    seeds = written(found.groupBy("bucket").applyInArrow(_join_seeds, "block int, keys binary, firsts binary, rest binary"), "substring-seeds")
    windows = blocks.groupBy("block").cogroup(seeds.select("block", "rest").groupBy("block")).applyInArrow(_extend(length, seed, n), "bucket int, block int, keys binary, anchors binary, docs binary")
    firsts = windows.groupBy("bucket").applyInArrow(_first_of, "block int, gone binary")
    none = F.lit(None).cast("binary")
    known = seeds.withColumn("gone", none).unionByName(firsts.select("block", none.alias("keys"), none.alias("firsts"), none.alias("rest"), "gone"))
    out = "doc_id long, n_words long, n_removed long, " + ("text string" if texts else "kept_sha256 string")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_cut(length, seed, texts), out)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM x),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
h AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m USING (s) WHERE m.least < g.doc_id),
c AS (SELECT doc_id, list(p) AS gone FROM h GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
