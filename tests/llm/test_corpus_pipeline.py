"""The pipeline's stages against what their operators say, and on odd and empty tables."""

import zlib
from collections import Counter

import corpus_pipeline as cp
import pytest
from strandline.llm.common import written

import public_tokenizers as P
from test_ops import SCHEMA, brute_links, brute_lines, odd_rows, words


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, docs, sf_dir):
    from strandline.llm.quality_rules import learn_rules, quality_rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(cp.STAGES)
    assert [k for k, _ in cp.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "bpe"]
    kept = written(stages["quality_rules"](spark, docs, sf_dir), "t1")
    judged = quality_rules(docs, learn_rules(docs, labels), ["doc_id"]).select("doc_id", "_quality.kept").collect()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged if r.kept}
    lines = written(stages["line_dedup"](spark, kept, sf_dir), "t2")
    before = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {d: t for (d, o), t in zip(before, brute_lines(before)) if words(t) or not words(o)}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    near = written(stages["jaccard_join"](spark, lines, sf_dir), "t3")
    links = brute_links(sorted((r.doc_id, r.text) for r in lines.collect()))
    assert {str(r.doc_id) for r in near.collect()} == {d for d, c, _ in links if d == c}
    mixed = written(stages["mixing"](spark, near, sf_dir), "t4")
    n = Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 3 and set(n) <= {r.doc_id for r in near.collect()} and mixed.columns == docs.columns
    size = sum(len(words(r.text)) for r in near.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - size) < 0.3 * size
    out = stages["bpe"](spark, mixed, sf_dir)
    assert out.count() == mixed.count() and out.where("NOT decodes").count() == 0
    assert Counter(r.doc_id for r in out.collect()) == n


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.where("n_tokens <> size(ids) OR NOT decodes").count() == 0 and cp.ORACLE_SQL is None


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_odd_and_empty(spark, sf_dir, name, stage):
    odd = written(spark.createDataFrame(odd_rows(), SCHEMA), "odd")
    out = stage(spark, odd, sf_dir)
    if name != "bpe":
        assert out.columns == odd.columns
    n = out.count()
    assert 0 < n <= 3 * odd.count()
    if name == "mixing":
        assert max(Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in out.collect()).values()) <= 6
    assert stage(spark, written(spark.createDataFrame([], SCHEMA), "none"), sf_dir).count() == 0
    assert P.PATTERN


def test_near_duplicates_of_repeated_ids(spark, sf_dir):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, b + " tail"), (None, "c d e"), (7, None), (8, "")]
    docs = written(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), "ids")
    got = {(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == {(3, a), (5, b), (None, "c d e"), (7, None), (8, "")}
