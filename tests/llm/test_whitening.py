"""Whitening against plain numpy and Python integers, and its defined cases."""

import numpy as np
import pytest

from strandline.llm import whitening as W
from strandline.llm.common import written

SCHEMA = "vec_id long, embedding array<float>, label int, x binary, n long, component string, i int"


def plain(vectors):
    """n, S, covariance and deviations of integer rows, with Python integers."""
    fit = sorted({tuple(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    y = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    return n, sums, cov, [sum((n * v[k] - sums[k]) ** 2 for k in range(d)) for v in vectors]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = [[int(np.floor(256.0 * float(c))) for c in v] for v in rows["embedding"]]
    n, sums, cov, deviation = plain(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
    got = W.op12_whitening(spark, sf_dir).toPandas()
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    signs = np.sign((table * want).sum(0))
    assert np.abs(table * signs - want).max() < 1e-9
    assert got[got["component"] == 1].set_index("vec_id").loc[rows["vec_id"], "deviation"].tolist() == deviation
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), values / np.trace(cov), rtol=1e-10)


@pytest.mark.parametrize("bits", [4, 13, 20, 26])
def test_digit_products_are_exact(bits):
    rng = np.random.RandomState(bits)
    for big in (3, 2**19, 2**40, 2**63 - 1):
        x = rng.randint(-big, big, (90, 5))
        y = W.centred(x, 10**6 + 1, [int(v) for v in rng.randint(-big, big, 5)])
        assert sum(int(d[0, 0]) << (bits * k) for k, d in enumerate(W.digits(y, bits))) == int(y[0, 0])
        exact = y.astype(object)
        assert (W.gram(y, bits) == exact.T @ exact).all()


def test_blocks_and_merges_agree(monkeypatch):
    y = np.random.RandomState(2).randint(-(2**40), 2**40, (500, 4))
    whole = W.gram(y)
    monkeypatch.setattr(W, "BLOCK", 7)
    assert (W.gram(y) == whole).all() and (W.gram(y[:100]) + W.gram(y[100:]) == whole).all()
    assert W._of_bytes(W._to_bytes([0, -1, 2**200, -(2**130)])) == [0, -1, 2**200, -(2**130)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [1.0, None], [nan, 1.0], [1.0, inf], [0.5], [0.5, 0.0], [], [-0.0, 0.0], [1.0, 2.0], [3.0, -4.0], [1.0009, 2.0]]
    rows = [(i if i else None, v, None, b"x", 1, "c", 2) for i, v in enumerate(vectors)]
    df = written(spark.createDataFrame(rows, SCHEMA), "vectors")
    got = W.whiten(df).collect()
    kept = [0, 5, 6, 7, 8, 9, 10, 11]
    x = [[int(np.floor(256 * c)) for c in vectors[i]] + [0] * (2 - len(vectors[i])) for i in kept]
    n, _, cov, deviation = plain(x)
    assert n == 4 and sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == sorted((i, c, n, v) for i, v in zip(kept, deviation) for c in (1, 2))
    assert all(r.identity_error < 1e-9 for r in got) and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    one = W.whiten(written(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 5, "vec_id long, embedding array<double>"), "one")).collect()
    assert len(one) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in one)
    assert W.whiten(written(spark.createDataFrame([], SCHEMA), "none")).count() == 0
    assert W.whiten(written(spark.createDataFrame([(1, None), (2, [nan]), (3, [])], "vec_id long, embedding array<double>"), "bare")).count() == 0


def test_entries_of_any_size(spark):
    vectors = [[1e30, 0.0, 2.0**40], [-1e30, 1.0, 5.0], [1e300, 3.0, -(2.0**50)], [7.0, 8.0, 9.0]]
    got = W.whiten(written(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), "large"), components=3).collect()
    assert len(got) == 12 and all(r.deviation is None for r in got) and all(r.identity_error < 1e-9 for r in got)
    top = {r.vec_id: r.whitened for r in got if r.component == 1}
    assert abs(top[0] - top[2]) < 1e-2 and abs(top[0]) > 0.5


def test_a_common_vector_counts_once(spark):
    rows = [(i, [0.25, 0.5] if i % 3 else [i / 8, 1.0 - i / 16]) for i in range(600)]
    df = written(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "common")
    assert {r.n for r in W.whiten(df).collect()} == {201} and W.distinct_vectors(df).count() == 201
