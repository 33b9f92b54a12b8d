"""Whitening of embeddings, with exact integer moments from float64 matrix products.

Each entry c becomes the integer floor(256 c); equal vectors count once. With n such vectors and their sums S, the
centred integers y = n x - S are cut into digits of DIGIT bits. Products of digit matrices over at most BLOCK rows stay
below 2 ** 53, so BLAS multiplies them exactly; the products of each digit position are put together as big integers,
and the blocks' and partitions' integers are merged, which gives the sum of y y' to the last bit in whatever order.
Its eigenvectors, computed in float64, whiten every row, and the whitened fit list is measured.

Two small tables go through the driver: n and S, and the Gram matrix, whose size is the dimension squared whatever the
number of rows. Vectors are never collected.

Defined results: rows whose vector is null, or holds null or a non-finite entry, are dropped. Entries beyond the range of a long take
its nearest end. A vector shorter than the longest one counts as ending in zeros. A null vec_id and rows that repeat are
kept. A component without variance (at most ZERO of the largest) has ``whitened`` null and ``explained`` 0; a
deviation that doesn't fit a long is null. Fewer dimensions give fewer components; an empty table, or vectors without entries, no rows. Other columns,
whatever their names, aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written

SCALE = 256
#: Rows of a block and bits of a digit: BLOCK * 4 ** DIGIT <= 2 ** 53.
BLOCK, DIGIT = 4096, 20
COMPONENTS, ZERO = 4, 1e-13
_LONG = 2.0**63


# -- vectors -----------------------------------------------------------------------------------------------------


def integers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a column of lists: which rows remain, these rows' integers one after another, and their offsets."""
    n = len(column)
    size = np.asarray(pc.list_value_length(column).fill_null(-1)).astype(np.int64)
    flat = column.flatten()  # without what null rows hide
    value = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    at = np.append(0, np.cumsum(np.maximum(size, 0)))
    bad = np.append(0, np.cumsum(~np.isfinite(value)))
    keep = (size >= 0) & (bad[at[1:]] == bad[at[:-1]])
    whole = np.floor(value[np.repeat(keep, np.maximum(size, 0))] * scale)
    inside = np.abs(whole) < _LONG
    x = np.where(inside, whole, 0).astype(np.int64)
    x[~inside] = np.where(whole[~inside] < 0, np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    return keep, x, np.append(0, np.cumsum(size[keep])) if n else np.zeros(1, np.int64)


def pack(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each vector as bytes, alike for equal ones: the width of its integers, then these without the zeros it ends in."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        row = np.trim_zeros(x[a:b], "b")
        low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        out.append(bytes([kind(0).itemsize]) + row.astype(kind).tobytes())
    return out


def matrix(packed: list[bytes], d: int) -> np.ndarray:
    """Packed vectors as rows of longs."""
    out = np.zeros((len(packed), d), np.int64)
    for i, b in enumerate(packed):
        row = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[i, : len(row)] = row
    return out


# -- exact products ----------------------------------------------------------------------------------------------


def digits(x: np.ndarray, bits: int = DIGIT) -> list[np.ndarray]:
    """Integers (of any size) as float64 digits, the lowest first: x is the sum of digit k times 2 ** (bits k). The last one
    carries the sign."""
    out, mask = [], (1 << bits) - 1
    while True:
        if not x.size or (int(x.max()) < 1 << (bits - 1) and int(x.min()) >= -(1 << (bits - 1))):
            return [*out, x.astype(np.float64)]
        out.append((x & mask).astype(np.float64))
        x = x >> bits


def gram(y: np.ndarray, bits: int = DIGIT) -> np.ndarray:
    """The sum over rows of y y', exact, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    block = min(BLOCK, 1 << max(0, 53 - 2 * bits))
    for i in range(0, len(y), block):
        part = digits(y[i : i + block], bits)
        for a in range(len(part)):
            for b in range(a, len(part)):
                product = (part[a].T @ part[b]).astype(np.int64)
                # the transposed product is that of the digits the other way round
                whole = product if a == b else product + product.T
                total += whole.astype(object) << (bits * (a + b))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as longs where all of it fits and as Python integers where not."""
    most = max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
    if most * n + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _to_bytes(row) -> bytes:
    """Integers of any size as bytes: the width that all of them fit, then each."""
    width = max((int(v).bit_length() for v in row), default=0) // 8 + 1
    return bytes([width]) + b"".join(int(v).to_bytes(width, "little", signed=True) for v in row)


def _of_bytes(raw: bytes) -> list[int]:
    width = raw[0]
    return [int.from_bytes(raw[i : i + width], "little", signed=True) for i in range(1, len(raw), width)]


def _added(table: pa.Table) -> pa.Table:
    """Rows of one key as one: counts and integers added up."""
    total = [0]
    for raw in table.column("v").to_pylist():
        row = _of_bytes(raw)
        total = [a + b for a, b in zip(total, row)] if len(total) == len(row) else row
    n = sum(table.column("n").to_pylist())
    return pa.table({"i": table.column("i")[:1], "part": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "v": pa.array([_to_bytes(total)], pa.binary())})


_SUMS = "i int, part int, n long, v binary"


def _merged(partial: DataFrame, branch: int = 64) -> list:
    """Partial rows (i, n, v) of all partitions added up by i, first among every so many partitions, then these."""
    partial = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(branch)))
    first = partial.groupBy("i", "part").applyInArrow(_added, _SUMS)
    return sorted((r.i, r.n, _of_bytes(r.v)) for r in first.groupBy("i").applyInArrow(_added, _SUMS).collect())  # a row a dimension


def _moments(d: int):
    """A partition's number of vectors and their sums."""

    def run(batches):
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix(batch.column("x").to_pylist(), d)
            n += len(x)
            most = max(int(x.max()), -int(x.min())) if x.size else 0
            sums = sums + (x.sum(0) if most * len(x) < 1 << 62 else x.astype(object).sum(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([_to_bytes(sums)], pa.binary())], names=["i", "part", "n", "v"])

    return run


def _products(d: int, n: int, sums: list[int]):
    """A partition's Gram matrix of n x - S, a row a dimension."""

    def run(batches):
        total = None
        for batch in batches:
            part = gram(centred(matrix(batch.column("x").to_pylist(), d), n, sums))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([0] * d, pa.int32()), pa.array([0] * d, pa.int64()), pa.array([_to_bytes(r) for r in total], pa.binary())], names=["i", "part", "n", "v"])

    return run


# -- fitting -----------------------------------------------------------------------------------------------------


class Whitening:
    """n, sums S, the kept components as columns, their eigenvalues (0 where they have no variance), and the covariance's trace."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.axes, self.values, self.trace = n, sums, axes, values, trace

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows n x - S, whitened; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values), np.nan)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def eigen(n: int, sums: list[int], products: np.ndarray, components: int) -> Whitening:
    """The components of V, the exact Gram matrix over n ** 3, each entry rounded once."""
    d = len(sums)
    cube = n**3
    v = np.array([[int(c) / cube for c in row] for row in products], np.float64).reshape(d, d)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    # either sign is right: the largest entry is positive, so reruns agree
    top = np.argmax(np.abs(axes), 0)
    axes = axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = sum(int(products[i][i]) for i in range(d)) / cube
    return Whitening(n, sums, axes, np.where(values > ZERO * max(values[0], 0), np.maximum(values, 0), 0.0), trace)


def _whitened_moments(w: Whitening, d: int):
    def run(batches):
        k = len(w.values)
        total = np.zeros((k, k))
        for batch in batches:
            z = w.whitened(centred(matrix(batch.column("x").to_pylist(), d), w.n, w.sums))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k)), pa.array(total.ravel())], names=["a", "b", "v"])

    return run


def fit(spark, vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """From the table of distinct packed vectors (x, d): the whitening, and the largest entry by which the covariance of the whitened fit list
    differs from the identity. None where there is nothing to fit."""
    d = vectors.agg(F.max("d")).first()[0]
    if not d:
        return None
    ((_, n, sums),) = _merged(vectors.select("x").mapInArrow(_moments(d), _SUMS))
    products = np.array([row for _, _, row in _merged(vectors.select("x").mapInArrow(_products(d, n, sums), _SUMS))], object)
    w = eigen(n, sums, products, components)
    held = vectors.select("x").mapInArrow(_whitened_moments(w, d), "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    # the fit list is centred exactly, so its whitened mean is 0
    error = [abs(r.v / n - (r.a == r.b)) for r in held.collect() if w.values[r.a] > 0 and w.values[r.b] > 0]  # components squared rows
    return w, max(error, default=0.0)


# -- rows --------------------------------------------------------------------------------------------------------


def _packed(scale: int):
    def run(batches):
        for batch in batches:
            _, x, at = integers(batch.column("embedding"), scale)
            yield pa.RecordBatch.from_arrays([pa.array(pack(x, at), pa.binary()), pa.array(np.diff(at).astype(np.int32))], names=["x", "d"])

    return run


def distinct_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each integer vector once (packed, ``x``) with the longest length it came in (``d``), as a written table. Equal vectors of a
    partition are merged before the shuffle, so a very common one travels once for each."""
    return written(rows.select("embedding").mapInArrow(_packed(scale), "x binary, d int").groupBy("x").agg(F.max("d").alias("d")), "whitening")


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None where it doesn't fit a long."""
    most = max(int(y.max()), -int(y.min())) if y.size else 0
    if most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    whole = y.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (whole * whole).sum(1)]


def _rows(w: Whitening, error: float, scale: int):
    k, d = len(w.values), len(w.sums)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                keep, flat, at = integers(part.column("embedding"), scale)
                x = np.zeros((len(at) - 1, d), np.int64)
                size = np.diff(at)
                x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
                y = centred(x, w.n, w.sums)
                z = w.whitened(y)
                m = len(x)
                ids = part.column("vec_id").filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)),
                        pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel(), from_pandas=True),
                        pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (1 to ``components``, by falling variance), n, deviation, whitened, explained, identity_error: one row for
    each remaining row and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = fit(spark, distinct_vectors(rows, scale), components)
    if found is None:
        return spark.createDataFrame([], _OUT)
    return rows.mapInArrow(_rows(*found, scale), _OUT)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
