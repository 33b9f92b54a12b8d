"""Vectors of words and texts learnt from the corpus: a randomised eigendecomposition of the matrix of positive pointwise mutual
information between words that stand near one another.

The matrix is stored once. In its products with narrow blocks of vectors the vectors of the words with most entries are sent to all tasks (matrix.HEAD bytes), where a word's
entries with these are one row; entries with rarer words are joins and sums. Else only Gram matrices of the block's width, whatever the corpus, come to the driver.
No word is left out for being rare. Results depend on the corpus and the parameters; the starting block is made of hashes of words.

Nulls and texts without a word add nothing. Repeated texts count as often as they stand. Columns other than the text's are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators.matrix import Stored
from strandline.operators.shared import materialised

#: Bytes of vectors up to which they are sent to all tasks.
SMALL = 64 << 20
#: The weight of a word in a text is this over this plus the word's share of the corpus.
COMMON = 1e-3
#: Words whose pairs a task counts at a time, about; bytes of counted pairs of a block, about; pairs of a row.
TOKENS, BLOCK, ROW = 4_000_000, 48 << 20, 250_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_pairs(docs: DataFrame, window: int = 4) -> DataFrame:
    """(a, b, n): how often b stands within so many words of a, both ways; a word's distance to itself may be that of two of its places."""
    near = lambda w: F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.lit(window)), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    pairs = docs.select(F.explode(F.flatten(F.transform(F.array(words_of(F.col("text"))), near))).alias("p")).select("p.*")
    once = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return once.select(F.explode(both).alias("p")).select("p.*")


def information(pairs: DataFrame) -> DataFrame:
    """(a, b, x): the logarithm of how much oftener two words meet than by chance, where that is positive. pairs: from word_pairs, stored."""
    each = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    total = each.agg(F.sum("na").alias("total"))
    x = pairs.join(each, "a").join(each.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").crossJoin(F.broadcast(total))  # one row
    return x.select("a", "b", F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb"))).alias("x")).where("x > 0")


# -- the same in blocks: pairs of two classes of words are counted and weighed together ---------------------------


def _key(word, seed: int) -> Column:
    """64 bits that stand for a word; counted_words takes the first seed by which no two words of the corpus have the same."""
    return F.xxhash64(F.lit(seed), word)


def counted_words(docs: DataFrame, window: int = 4) -> tuple[DataFrame, int]:
    """(h, word, n, near), stored, and the seed of the keys h: how often a word stands, and how many places stand within the window of it, which is the sum of its pairs."""
    with_near = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), (F.least(i, F.lit(window)) + F.least(F.size(w) - 1 - i, F.lit(window))).alias("near")))
    each = docs.select(F.explode(F.flatten(F.transform(F.array(words_of(F.col("text"))), with_near))).alias("x")).select("x.*")
    words, seed = materialised(each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near")), "word-counts"), 0
    while not words.groupBy(_key(F.col("word"), seed).alias("h")).count().where("count > 1").isEmpty():
        seed += 1
    return words.select(_key(F.col("word"), seed).alias("h"), "word", "n", "near"), seed


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """Lists of words of about TOKENS words in all, across batches."""
    held, n = [], 0
    for batch in batches:
        lists, at = batch.column(0), 0
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
        while at < len(lists):
            before = ends[at - 1] if at else 0
            to = min(len(lists), int(np.searchsorted(ends, before + TOKENS - n)) + 1)
            held.append(lists.slice(at, to - at))
            n, at = n + int(ends[to - 1] - before), to
            if n >= TOKENS:
                yield pa.concat_arrays(held)
                held, n = [], 0
    if held:
        yield pa.concat_arrays(held)


def _count_pairs(window: int, classes: int):
    """Of lists of keys: (i, j, a, runs, b, n), for two classes i <= j of words their pairs, each once: a in order, each with a run of as many b, and how often they stand together."""

    def run(batches):
        for lists in _pieces(batches):
            words, code = np.unique(np.asarray(lists.flatten(), np.int64), return_inverse=True)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            by_class = np.lexsort((words, words % classes))
            rank = np.empty(len(words), np.int64)
            rank[by_class] = np.arange(len(words))
            words, code = words[by_class], rank[code]
            kind, n = words % classes, len(words)
            keys = []
            for d in range(1, window + 1):
                x, y = (c[doc[:-d] == doc[d:]] for c in (code[:-d], code[d:]))
                keys.append(np.minimum(x, y) * n + np.maximum(x, y))
            keys = np.concatenate(keys)
            if not len(keys):
                continue
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            times, keys = np.diff(np.append(first, len(keys))), keys[first]
            a, b = np.divmod(keys, n)
            block = kind[a] * classes + kind[b]
            order = np.argsort(block, kind="stable")
            block = block[order]
            begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for p, q in zip(begins, np.append(begins[1:], len(block))):
                for r in range(p, q, ROW):
                    at = order[r : min(q, r + ROW)]
                    x = a[at]
                    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    lists_ = (pa.array(words[x[starts]]), pa.array(np.diff(np.append(starts, len(x))).astype(np.int32)), pa.array(words[b[at]]), pa.array(times[at]))
                    i, j = divmod(int(block[p]), classes)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists_)], names=["i", "j", "a", "runs", "b", "n"])

    return run


def _weigh(classes: int, total: float, f: Callable, empty: pa.Table):
    """Of the pairs of two classes, and the words of both: what ``f`` makes of (keys of i, keys of j, places of a and b in these, in order, information)."""

    def run(key, pairs: pa.Table, words: pa.Table) -> pa.Table:
        if not len(pairs):
            return empty
        i, j = (k.as_py() for k in key[:2])
        h, near = (words.column(c).to_numpy() for c in ("h", "near"))
        order = np.argsort(h)
        h, near = h[order], near[order]
        (hi, ni), (hj, nj) = ((h[h % classes == k], near[h % classes == k].astype(np.float64)) for k in (i, j))
        a, runs, b, n = (np.concatenate([np.asarray(c.flatten(), np.int64) for c in pairs.column(name).chunks]) for name in ("a", "runs", "b", "n"))
        keys = np.repeat(np.searchsorted(hi, a), runs) * len(hj) + np.searchsorted(hj, b)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(n[order], first)
        a, b = np.divmod(keys[first], len(hj))
        if i == j:
            n = np.where(a == b, 2 * n, n)  # both ways
        x = np.log(n * total / (ni[a] * nj[b]))
        return f(hi, hj, a[x > 0], b[x > 0], x[x > 0])

    return run


def weighed(docs: DataFrame, f: Callable, names: str, window: int = 4) -> tuple[DataFrame, DataFrame]:
    """The words of a corpus (counted_words), and what ``f`` makes of the information of their pairs, as ``information`` has it, block by block.

    Words are dealt to classes by their keys, pairs to blocks by both classes. A task counts the pairs of some 4 million places at a time; these counts, as lists
    of keys, are all that is shuffled. A block's pairs are added and weighed where they meet, so pairs are neither stored nor joined with words. There are as many
    classes as make a block BLOCK bytes, so a frequent word's pairs are in many blocks."""
    words, seed = counted_words(docs, window)
    stats = words.agg(F.sum("n").alias("n"), F.sum("near").alias("near")).first()
    classes = max(1, int(np.ceil(np.sqrt(2 * (stats["n"] or 0) * window * 6 / BLOCK))))
    keys = docs.select(F.transform(words_of(F.col("text")), lambda w: _key(w, seed)).alias("w"))
    pairs = keys.mapInArrow(_count_pairs(window, classes), "i int, j int, a array<long>, runs array<int>, b array<long>, n array<long>")
    kind, other = F.pmod("h", F.lit(classes)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    known = words.where("near > 0").select("h", "near", kind.alias("k"), other.alias("o")).select(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "h", "near")
    empty = f(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0))
    return words, pairs.groupBy("i", "j").cogroup(known.groupBy("i", "j")).applyInArrow(_weigh(classes, float(stats["near"] or 0), f, empty), names)


def _entries(hi, hj, a, b, x) -> pa.Table:
    """Pairs both ways, one of a word with itself once."""
    two = ~((len(hi) == len(hj)) & (hi[a] == hj[b])) if len(x) else np.zeros(0, bool)
    return pa.table({"a": np.append(hi[a], hj[b][two]), "b": np.append(hj[b], hi[a][two]), "x": np.append(x, x[two])})


def _partners(hi, hj, a, b, x) -> pa.Table:
    """(h, partners, strongest, information) of the words of a block."""
    two = hi[a] != hj[b]
    b_, x_ = b[two], x[two]
    order = np.argsort(b_, kind="stable")
    parts = []
    for h, at, v in ((hi, a, x), (hj, b_[order], x_[order])):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        sums = [np.maximum.reduceat(v, first), np.add.reduceat(v, first)] if len(at) else [v, v]
        parts.append((h[at[first]], np.diff(np.append(first, len(at))), *sums))
    return pa.table(dict(zip(("h", "partners", "strongest", "information"), map(np.concatenate, zip(*parts)))))


def word_partners(docs: DataFrame, window: int = 4) -> DataFrame:
    """(word, partners, strongest, information): how many words stand near a word oftener than by chance, the most and the sum of their information."""
    words, parts = weighed(docs, _partners, "h long, partners long, strongest double, information double", window)
    whole = parts.groupBy("h").agg(F.sum("partners").alias("partners"), F.max("strongest").alias("strongest"), F.sum("information").alias("information"))
    return whole.join(words.select("h", "word"), "h").select("word", "partners", "strongest", "information")


# -- decomposition -----------------------------------------------------------------------------------------------


def _gram(rows: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    """The sum over all rows of left' right, a matrix of the block's width; each task sends one."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x, y = (np.asarray(c.flatten(), np.float64).reshape(-1, width) for c in batch.columns)
            total += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    sums = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r["at"]] = r["s"]
    return out.reshape(width, width)


def _turned(rows: DataFrame, *by: np.ndarray) -> DataFrame:
    """Every vector times small matrices, one after the other."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, by[0].shape[0])
            for m in by:
                x = x @ m
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["word", "vec"])

    return rows.select("word", "vec").mapInArrow(run, f"word {dict(rows.dtypes)['word']}, vec array<double>")


def _basis(rows: DataFrame, width: int) -> tuple[list[np.ndarray], int]:
    """Small matrices that turn a block of this width into a basis of its span, and the basis's width: directions that are nothing but rounding are left out.
    Two of them, as a Gram matrix squares the spread of the directions. The basis itself isn't stored; it is made where it is read."""
    by: list[np.ndarray] = []
    while width and len(by) < 2:
        e, v = np.linalg.eigh(_gram(_turned(rows, *by) if by else rows, "vec", "vec", width))
        kept = e > max(e.max(initial=0.0) * 1e-12, 1e-300)
        by.append(v[:, kept] / np.sqrt(e[kept]))
        width = int(kept.sum())
    return by, width


def principal(matrix: DataFrame, dim: int = 32, extra: int = 10, rounds: int = 3) -> tuple[np.ndarray, DataFrame]:
    """The eigenvalues of largest magnitude of a symmetric matrix (a, b, x), and (word, vec) of its eigenvectors' entries, at most ``dim``.

    A block of dim + extra random directions is multiplied by the matrix so many times and made orthonormal after each; the
    matrix is then decomposed within its span."""
    width = dim + extra
    stored = Stored(matrix, width)
    signs = stored.words.select("word", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(F.xxhash64("word", j) < 0, -1.0).otherwise(1.0)).alias("vec"))
    image = materialised(stored.times(signs, width), "vector-block")
    for _ in range(rounds + 1):
        by, width = _basis(image, width)
        if not width:
            return np.zeros(0), image.select("word", F.array().cast("array<double>").alias("vec"))
        block = _turned(image, *by)
        image = materialised(stored.times(block, width), "vector-block")
    both = block.join(image.withColumnRenamed("vec", "image"), "word")
    inner = _gram(both, "vec", "image", width)
    e, v = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(e), kind="stable")[:dim]
    e, v = e[order], v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)
    return e, materialised(_turned(block, v), "vector-words")


def learn_word_vectors(docs: DataFrame, dim: int = 32, window: int = 4, extra: int = 10, rounds: int = 3) -> DataFrame:
    """(word, n, vec) of all words that meet another: eigenvectors times the root of their eigenvalues' magnitude."""
    words, entries = weighed(docs, _entries, "a long, b long, x double", window)
    values, vectors = principal(materialised(entries, "word-information"), dim, extra, rounds)
    scale = F.array(*(F.lit(float(x)) for x in np.sqrt(np.abs(values)))) if len(values) else F.array().cast("array<double>")
    vectors = vectors.withColumnRenamed("word", "h").join(words.select("h", "word", "n"), "h")
    return materialised(vectors.select("word", "n", F.zip_with("vec", scale, lambda v, s: v * s).alias("vec")), "word-vectors")


def embed_learned(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, vec) of distinct texts, as alignment.with_vectors takes them: the unit vector of the sum of the words' vectors, common
    words weighing less. A text without a known word has a null vector.

    words: from learn_word_vectors; sent to all tasks if its vectors take at most SMALL bytes, else met by a shuffle."""
    stats = words.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total"), F.max(F.size("vec")).alias("dim")).first()
    dim, total = stats["dim"] or 0, float(stats["total"] or 1)
    distinct = texts.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    if not dim:
        return distinct.select("text", F.lit(None).cast("array<float>").alias("vec"))
    keyed = distinct.withColumn("_key", F.sha2("text", 256))
    each = keyed.select("_key", F.explode(words_of(F.col("text"))).alias("word"))
    weighed = words.select("word", "vec", (COMMON / (COMMON + F.col("n") / total)).alias("w"))
    weighed = F.broadcast(weighed) if stats["words"] * dim * 8 <= SMALL else weighed
    sums = each.join(weighed, "word").groupBy("_key").agg(F.array(*(F.sum(F.col("w") * F.get("vec", F.lit(j))) for j in range(dim))).alias("s"))
    return keyed.join(sums, "_key", "left").select("text", A.unit(F.col("s")).cast("array<float>").alias("vec"))
