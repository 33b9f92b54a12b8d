"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are ratios of counts (quality_rules.py) and more of the same kind. The trees are grown
leaf by leaf on 64-bin histograms of a bounded sample of labelled rows, with logistic loss; then they are flattened
into arrays, level by level, so that scoring is a few numpy gathers a tree for a whole batch of documents.

Labels are learnt only from rows that ``learns`` allows; no label, language, source or id goes into a score.

Defined results: a null or empty text has statistics of zeros and a score; without labels, or with labels of one kind,
every score is the share of label 1 among them (0.5 without any); null labels are left out; of a repeated id the smallest of its texts is
learnt from and each row is scored by its own; texts of any length are read whole; given columns may have any name but ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import wordscan as ws
from strandline.llm.common import free_name
from strandline.llm.quality_rules import RATIOS, labelled, ratios, statistics

#: The trees see this many labelled rows at most, those of the lowest hashes.
SAMPLE = 20_000
TREES, LEAVES, BINS, RATE, LEAST, RIDGE = 60, 8, 64, 0.12, 10, 1.0
THRESHOLD = 0.7


def features(texts) -> np.ndarray:
    """A row of numbers for each text of an Arrow column."""
    counts = statistics(texts)
    body, at = ws.flat(texts)
    size = np.maximum(np.diff(at), 1)
    more = [ws.per_text(what, at) / size for what in (body >= 0x80, (body == 0x2E) | (body == 0x2C), body == 0x0A, (body == 0x22) | (body == 0x27), (body == 0x3D) | (body == 0x2D) | (body == 0x5F), body == 0x20)]
    return np.column_stack([ratios(counts), np.log1p(counts["word_chars"]), *more])


N_FEATURES = len(RATIOS) + 7


@dataclass
class Forest:
    """Trees as arrays: for each tree and node the feature (-1: a leaf), threshold, left child (right is next) and value."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = self.feature[t][node]
                right = x[row, np.maximum(f, 0)] > self.threshold[t][node]
                node = np.where(f < 0, node, self.left[t][node] + right)
            total += self.value[t][node]
        return 1 / (1 + np.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
    """One tree, its best leaf split again and again; returns nodes, and the leaf of each row."""
    n_f = binned.shape[1]
    offset = np.arange(n_f) * BINS
    feature, threshold, left, value, depth = [-1], [0.0], [0], [0.0], [0]
    rows_of = {0: np.arange(len(g))}

    def best_split(rows):
        flat = (binned[rows] + offset).ravel()
        shape = (n_f, BINS)
        hg = np.bincount(flat, np.repeat(g[rows], n_f), n_f * BINS).reshape(shape)
        hh = np.bincount(flat, np.repeat(h[rows], n_f), n_f * BINS).reshape(shape)
        hn = np.bincount(flat, minlength=n_f * BINS).reshape(shape)
        lg, lh, ln = hg.cumsum(1), hh.cumsum(1), hn.cumsum(1)
        G, H, N = lg[0, -1], lh[0, -1], len(rows)
        gain = lg**2 / (lh + RIDGE) + (G - lg) ** 2 / (H - lh + RIDGE) - G**2 / (H + RIDGE)
        gain = np.where((ln >= LEAST) & (N - ln >= LEAST), gain, -np.inf)
        k = int(np.argmax(gain))
        return gain.flat[k], k // BINS, k % BINS

    open_leaves = {0: best_split(rows_of[0])}
    while len(rows_of) < LEAVES:
        leaf = max(open_leaves, key=lambda i: (open_leaves[i][0], -i), default=None)
        if leaf is None or open_leaves[leaf][0] <= 1e-6:
            break
        _, f, b = open_leaves.pop(leaf)
        rows = rows_of.pop(leaf)
        up = binned[rows, f] > b
        feature[leaf], threshold[leaf], left[leaf] = f, edges[f][b], len(feature)
        for part in (rows[~up], rows[up]):
            i = len(feature)
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0), depth.append(depth[leaf] + 1)
            rows_of[i] = part
            open_leaves[i] = best_split(part)
    for i, rows in rows_of.items():
        value[i] = -RATE * g[rows].sum() / (h[rows].sum() + RIDGE)
    return feature, threshold, left, value, max(depth), rows_of


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nothing = Forest(base, 0, np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 1), np.int32), np.zeros((0, 1)))
    if len(np.unique(y)) < 2:
        return nothing
    edges, binned = [], np.zeros(x.shape, np.int64)
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        v = np.unique(x[:, j])
        # between values, so that a threshold isn't a value that rounding may miss
        e = np.unique([(v[i] + v[min(i + 1, len(v) - 1)]) / 2 for i in np.searchsorted(v, e)])
        edges.append(np.append(e, [np.inf] * (BINS - len(e))))
        binned[:, j] = np.searchsorted(e, x[:, j], "left")
    trees, f = [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        *nodes, depth, rows_of = _grow(binned, edges, p - y, p * (1 - p))
        for i, rows in rows_of.items():
            f[rows] += nodes[3][i]
        trees.append((nodes, depth))
    size = max(len(t[0][0]) for t in trees)
    fill = lambda k, kind, what: np.array([t[0][k] + [what] * (size - len(t[0][k])) for t in trees], kind)
    return Forest(base, max(d for _, d in trees), fill(0, np.int32, -1), fill(1, float, 0.0), fill(2, np.int32, 0), fill(3, float, 0.0))


def learns(doc_id: Column) -> Column:
    """Rows that may be learnt from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def _features_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    text = free_name(docs, "_text")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch, text):
                x = features(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists], names=[*columns, "x"])

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees learnt from at most ``sample`` labelled rows that may be learnt from."""
    known = labelled(docs, labels.where(learns(F.col("doc_id"))), sample)
    rows = _features_of(known, ["doc_id", "_quality"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    return train(x, np.array([r["_quality"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, columns: list[str]) -> DataFrame:
    """The given columns and ``score``."""
    text = free_name(docs, "_text")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(forest.score(features(part.column(text))))], names=[*columns, "score"])

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, forest, ["doc_id"])
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
