"""The Merkle manifest against a plain recursive build, and its defined cases."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle as M
from strandline.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, part string, at long, _part int"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(nodes):
    """The root, and for each leaf the pairs (place, run) up to it."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for p, k in zip(paths, range(len(at))):
            p.append((at[k] % 8, runs[at[k] // 8]))
        at, nodes = [k // 8 for k in at], [H(*r) for r in runs]
    return nodes[0], paths


def plain(rows, tampers=lambda d: zlib.crc32(str(d).encode()) % 3 == 0):
    rows = [r.asDict() for r in rows]
    for r in rows:
        r["leaf"] = plain_leaf(r, r["text"])
        lower = r["text"] if r["text"] is None or r["doc_id"] is None or not tampers(r["doc_id"]) else re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        r["altered"] = plain_leaf(r, lower)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == k), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["leaf"])) for k in langs]
    trees = [plain_tree([r["leaf"] for r in g]) for g in groups]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(group, paths):
            fold, siblings = r["altered"], []
            for k, run in path + top:
                siblings += run[:k] + run[k + 1 :]
                fold = H(*run[:k], fold, *run[k + 1 :])
            out.append((r["doc_id"], r["leaf"], subroot, root, H(*siblings), fold, fold == root))
    return out


def same(got, want):
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query(spark, sf_dir):
    want = plain(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = M.op11_merkle(spark, sf_dir).collect()
    same(got, want)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def odd(n_langs):
    langs = [None, "", "é", "z", "Z", "en"] + [f"l{i}" for i in range(n_langs)]
    rows = [(i if i % 50 else None, None if i % 11 == 0 else f"Text {i} of ÄÖ MANY" * (i % 5), langs[min(i * i % 97, len(langs) - 1)], None if i % 13 == 0 else "s", None if i % 17 == 0 else i, "d", 1, "p", 2, 3) for i in range(700)]
    return rows + [rows[5]] * 40 + [(None, None, None, None, None, None, None, None, None, None)] * 30 + [(7, "other TEXT with the id", "en", "s", 1, None, None, None, None, None)]


@pytest.mark.parametrize("n_langs,fan", [(0, 64), (80, 2)])
def test_odd_rows(spark, monkeypatch, n_langs, fan):
    """Null fields, repeated rows and ids, one and many languages, trees of one leaf; with more rounds of reshuffling."""
    monkeypatch.setattr(M, "FAN", fan)
    if n_langs:
        monkeypatch.setattr(M, "_PART", 400)  # many partitions, also of the tree over the languages
    df = written(spark.createDataFrame(odd(n_langs), SCHEMA).repartition(7), "odd")
    trees, proofs = M.manifest(df)
    want = plain(df.collect())
    same(proofs.collect(), want)
    assert {(r.subroot, r.root) for r in trees.collect()} == {(w[2], w[3]) for w in want} and trees.agg(F.sum("n")).first()[0] == len(want)


def test_small_tables(spark):
    for n in (1, 2, 8, 9, 64, 65):
        df = written(spark.createDataFrame([(i, "A", "x", "s", 1, None, None, None, None, None) for i in range(n)], SCHEMA), "few")
        same(M.manifest(df)[1].collect(), plain(df.collect()))
    assert M.manifest(written(spark.createDataFrame([], SCHEMA), "none"))[1].count() == 0
    long = written(spark.createDataFrame([(1, "W" * 10_000_000, "x", "s", 1, None, None, None, None, None), (2, "b", "x", "s", 1, None, None, None, None, None)], SCHEMA), "long")
    same(M.manifest(long, tampers=F.lit(True))[1].collect(), plain(long.collect(), lambda d: True))


def test_events_in_any_order():
    """A parent is emitted when its last child comes, whichever that is; what stays open is the frontier."""
    leaves = [bytes([i]) * 32 for i in range(75)]
    want, _ = plain_tree([x.hex() for x in leaves])
    for order in (range(75), range(74, -1, -1), [(i * 29) % 75 for i in range(75)]):
        c = M.Combiner()
        for i in order:
            c.add(1, 75, 0, i, leaves[i])
        assert [x[3].hex() for x in c.roots] == [want] and not list(c.frontier()) and len(c.links) == 10 + 2 + 1
    first, second, end = M.Combiner(), M.Combiner(), M.Combiner()
    for i in range(75):
        (first if i < 30 else second).add(1, 75, 0, i, leaves[i])
    open_ = [*first.frontier(), *second.frontier()]
    assert len(open_) < 30
    for t, n, level, at, node in reversed(open_):
        end.add(t, n, level, at, node)
    assert [x[3].hex() for x in end.roots] == [want]
