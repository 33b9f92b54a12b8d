"""Learnt vectors against numpy's decomposition, and what they are for: words used alike are alike."""

import math
import random
from collections import Counter

import numpy as np

from strandline.operators import vectors as V


def corpus(seed: int = 3, n: int = 80):
    rng = random.Random(seed)
    animals, tools = ["cat", "dog", "cow", "hen"], ["saw", "axe", "awl", "file"]
    near = {"a": ["eats", "runs", "sleeps", "barn"], "t": ["cuts", "sharp", "steel", "bench"]}
    out = []
    for _ in range(n):
        kind = rng.choice("at")
        out.append(" ".join(w for _ in range(rng.randint(2, 6)) for w in ("the", rng.choice(animals if kind == "a" else tools), *rng.sample(near[kind], 2))) + ".")
    return out


def plain_matrix(texts, window):
    met = Counter()
    for t in texts:
        w = t.lower().replace(".", "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + window + 1)):
                met[w[i], w[j]] += 1
                met[w[j], w[i]] += 1
    words = sorted({a for a, _ in met})
    each, total = Counter(), sum(met.values())
    for (a, _), n in met.items():
        each[a] += n
    m = np.zeros((len(words), len(words)))
    for (a, b), n in met.items():
        m[words.index(a), words.index(b)] = max(0.0, math.log(n * total / (each[a] * each[b])))
    return words, m


def test_matrix_and_its_decomposition(spark):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words, want = plain_matrix(texts, 3)
    matrix = V.materialised(V.information(V.materialised(V.word_pairs(docs, 3), "p")), "m")
    got = np.zeros_like(want)
    for r in matrix.collect():
        got[words.index(r["a"]), words.index(r["b"])] = r["x"]
    assert np.allclose(got, want, atol=1e-12)

    dim = 5
    e, rows = V.principal(matrix, dim, extra=8, rounds=4)
    true, vectors = np.linalg.eigh(want)
    order = np.argsort(-np.abs(true))[:dim]
    assert np.allclose(e, true[order], rtol=1e-4)
    found = {r["word"]: r["vec"] for r in rows.collect()}
    x = np.array([found[w] for w in words])
    assert np.allclose(x.T @ x, np.eye(dim), atol=1e-9)
    assert np.all(np.abs(np.sum(x * vectors[:, order], 0)) > 0.999)


def test_words_used_alike_are_alike(spark):
    docs = spark.createDataFrame([(t, 1) for t in corpus()] + [(None, 2), ("", 3)], "text string, word int")
    words = V.learn_word_vectors(docs, dim=4, window=3)
    v = {r["word"]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in words.collect()}
    assert min(v["cat"] @ v["dog"], v["saw"] @ v["axe"]) > max(v["cat"] @ v["saw"], v["dog"] @ v["axe"])
    texts = ["the cat runs", "A DOG sleeps!", "sharp axe", "the saw cuts", "unknown", "", None, "the cat runs"]
    got = {r["text"]: r["vec"] for r in V.embed_learned(spark.createDataFrame([(t,) for t in texts], "text string"), words).collect()}
    assert len(got) == 6 and got["unknown"] is None and got[""] is None
    x = {t: np.array(u) for t, u in got.items() if u}
    assert all(abs(np.linalg.norm(u) - 1) < 1e-3 for u in x.values())
    assert x["the cat runs"] @ x["A DOG sleeps!"] > x["the cat runs"] @ x["sharp axe"] < x["sharp axe"] @ x["the saw cuts"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(None,), ("",), ("alone",)], "text string")
    words = V.learn_word_vectors(docs, dim=3)
    assert words.count() == 0
    assert [r["vec"] for r in V.embed_learned(docs, words).collect()] == [None, None]


def test_pairs_in_blocks(spark, monkeypatch):
    """Blocks give what the joins of pairs with words give, whatever the classes and pieces are, and no two words have one key."""
    from pyspark.sql import functions as F

    texts = [*corpus(n=30), None, "", "alone", "twice twice", "x y x x", *corpus(n=5)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    want = {(r.a, r.b): r.x for r in V.information(V.materialised(V.word_pairs(docs, 3), "p")).collect()}
    key = V._key
    # by the first seed, all words have few keys
    monkeypatch.setattr(V, "_key", lambda word, seed: key(word, seed) % 5 if seed == 0 else key(word, seed))
    for tokens, block, row in ((4_000_000, 48 << 20, 250_000), (40, 500, 7)):
        monkeypatch.setattr(V, "TOKENS", tokens), monkeypatch.setattr(V, "BLOCK", block), monkeypatch.setattr(V, "ROW", row)
        words, entries = V.weighed(docs, V._entries, "a long, b long, x double", 3)
        name = {r.h: r.word for r in words.collect()}
        rows = entries.collect()
        assert len(rows) == len(want) and {(name[r.a], name[r.b]): round(r.x, 9) for r in rows} == {k: round(x, 9) for k, x in want.items()}
        got = {r.word: (r.partners, round(r.strongest, 9), round(r.information, 6)) for r in V.word_partners(docs, 3).collect()}
        of = {a: [x for (c, _), x in want.items() if c == a] for a, _ in want}
        assert got == {a: (len(x), round(max(x), 9), round(sum(x), 6)) for a, x in of.items()}
    assert ("x", "x") in want or ("twice", "twice") in want
    assert V.word_partners(docs.where("false"), 3).count() == 0
    plan = V.word_partners(docs, 3)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin [a" not in plan


def test_bases_are_not_stored(spark, monkeypatch):
    """A decomposition writes a block for each product and its result, and keys of words are numbers."""
    names, right = [], V.materialised
    monkeypatch.setattr(V, "materialised", lambda df, name: names.append((name, dict(df.dtypes))) or right(df, name))
    V.learn_word_vectors(spark.createDataFrame([(t,) for t in corpus(n=20)], "text string"), dim=3, window=2, extra=2, rounds=1)
    assert [n for n, _ in names] == ["word-counts", "word-information", *["vector-block"] * 3, "vector-words", "word-vectors"]
    assert names[1][1] == {"a": "bigint", "b": "bigint", "x": "double"} and names[2][1]["word"] == "bigint"


def test_products_shuffle_no_entry_with_the_head(spark, monkeypatch):
    """Entries with the words of the head stay where they are stored; entries with others are added to them. Whatever the head's size is, the product is the matrix's."""
    from strandline.operators import matrix as S

    rng = np.random.default_rng(6)
    m = np.triu(np.where(rng.random((60, 60)) < 0.2, rng.random((60, 60)), 0))
    m = m + m.T
    m[7] = m[:, 7] = 0  # without an entry
    entries = spark.createDataFrame([(f"w{i}", f"w{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))], "a string, b string, x double")
    v = rng.standard_normal((60, 3))
    block = spark.createDataFrame([(f"w{i}", v[i].tolist()) for i in range(60) if m[i].any()], "word string, vec array<double>")
    for size in (1, 10, 1000):
        monkeypatch.setattr(S, "HEAD", size * 8 * 3)
        stored = S.Stored(entries, 3)
        out = stored.times(block, 3)
        got = {r.word: r.vec for r in out.collect()}
        assert got.keys() == {f"w{i}" for i in range(60) if m[i].any()}
        assert all(np.allclose(x, m[int(w[1:])] @ v, atol=1e-12) for w, x in got.items())
        assert (stored.rest is None) == (size == 1000)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
