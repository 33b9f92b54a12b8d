"""Queries on tables that the driver's own sizes don't have: neighbours that are alike, values that are missing, many files."""

import duckdb
import numpy as np
import pandas as pd

from strandline.plans.registry import ORACLE_SQL, QUERIES


def check(spark, name, d, *tables):
    """A query over the tables of a folder gives its SQL's rows."""
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(d)), c.sql(ORACLE_SQL[name])
    by_name = sorted(want.columns)
    assert sorted(got.columns) == by_name
    assert sorted(map(str, got.select(*by_name).toArrow().to_pylist())) == sorted(map(str, want.select(*by_name).arrow().read_all().to_pylist()))


def test_planted_alignment_of_near_neighbours(spark, tmp_path):
    """A source that is left out is hardly another than the one before it."""
    v = np.random.default_rng(5).standard_normal((230, 64)).astype(np.float32)
    v[8::23] = v[7::23] + 0.1 * v[8::23]
    pd.DataFrame({"vec_id": np.arange(230), "embedding": list(v), "label": np.arange(230) % 10}).to_parquet(tmp_path / "embeddings.parquet")
    check(spark, "vec_align_planted", tmp_path, "embeddings")


def test_to_ms_of_missing_values(spark, tmp_path):
    pd.DataFrame({"event_id": [1, 2, 3, 4], "value": [None, 0.0, 3.25, 300.0]}).to_parquet(tmp_path / "events.parquet")
    check(spark, "to_ms", tmp_path, "events")


def test_results_of_transcription_leave_in_runs(spark):
    """A run of rows ends by its bytes, so a task never holds the results of all rows that Spark sends at once."""
    from strandline.operators import models

    assert list(models._runs([5, 5, 5, 50, 5, 5], 2, 10, 40)) == [(0, 2), (2, 4), (4, 6)]
    assert list(models._runs([], 2, 10, 40)) == [] and list(models._runs([0, 0, 3], 2, 10, 40)) == [(0, 3)]
    rows = [(str(i), "x", None if i % 5 == 0 else b"a b " * i) for i in range(40)]
    got = models.transcribe_all(spark.createDataFrame(rows, "src string, tgt string, content binary").coalesce(1), "spelled", "en", batch=2, budget=100).collect()
    assert [r["src"] for r in got] == [str(i) for i in range(40)]
    assert [None if r["time_stamps"] is None else len(r["time_stamps"]) for r in got] == [None if i % 5 == 0 else 2 * i for i in range(40)]
    assert [r["error"] for r in got] == ["no content" if i % 5 == 0 else None for i in range(40)]


def test_batches_are_python_objects_in_pieces():
    import pyarrow as pa

    from strandline.functions import arrays

    seen = []

    def f(texts):
        seen.append(len(texts))
        return [(t or "").split() for t in texts]

    got = arrays.in_pieces(f, pa.list_(pa.string()), pa.array(["a b", None, "c"] * 50))
    assert got.to_pylist() == [["a", "b"], [], ["c"]] * 50 and max(seen) == 64
    spans = arrays._located(pa.array(["ab ab", None]), pa.array([["ab", "x", "ab"], None]))
    assert [[tuple(s.values()) for s in r] for r in spans.to_pylist()] == [[(0, 2), (-1, -1), (3, 5)], []]


def test_short_form_is_not_worked_out_in_a_filter(spark, sf_dir):
    plan = QUERIES["yaal_shortform"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and not any("Filter" in x.split("(")[0] and "lambda" in x for x in plan.splitlines())


def test_report_and_lines_pass_no_driver_and_no_single_task(spark, sf_dir, monkeypatch):
    def refused(*_):
        raise AssertionError("all rows in one place")

    for name in ("toLocalIterator", "coalesce"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    check(spark, "report_file", sf_dir, "conversations")
    check(spark, "text_lines", sf_dir, "orders")


def test_alignments_of_a_document_are_several_files_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandline.sources import readers, writers

    x = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").alias("aln_idx"), F.array("id").alias("src_idx"), F.array("id").alias("tgt_idx"), F.lit(0.5).alias("cost"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.alignments_text(x, str(tmp_path / "a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "a" / "doc_id=1").glob("part-*"))
    assert len(files) > 1
    assert [int(line.split("]")[0][1:]) for f in files for line in f.read_text().splitlines()] == list(range(2000))
    assert readers.alignments(spark, f"{tmp_path}/a/*").count() == 2000


def test_overlaps_travel_by_address(spark, sf_dir):
    """Texts of runs are told apart and met by 128 bits; what lists repeat, and rows of one id, stay as they are."""
    from strandline.functions import arrays as A
    from strandline.operators import alignment
    from pyspark.sql import functions as F

    lists = [["a", "b", " "], ["a", "b", " "], ["b"], [], None, ["x\ny", None, "a"], ["y" * 10_001]]
    docs = spark.createDataFrame([(i % 6 if i != 2 else None, s) for i, s in enumerate(lists)], "doc_id int, s array<string>")
    runs = [(r.doc_id, r.o.text) for r in docs.select("doc_id", F.explode(A.overlaps(F.col("s"), 2)).alias("o")).collect()]
    got = alignment.distinct_overlaps(docs, "s", 2)
    assert sorted(r.text for r in got.collect()) == sorted({t for _, t in runs}) and len(runs) > len({t for _, t in runs})
    vectors = got.where("text <> 'b' AND text <> 'PAD'").withColumn("vec", F.array(F.length("text").cast("float")))
    out = {r.doc_id: r.v for r in alignment.with_vectors(docs, vectors, "s", 2, "v").collect()}
    assert {k: (len(v.vectors), sorted(v.unknown)) for k, v in out.items()} == {k: (sum(d == k for d, _ in runs), sorted(t for d, t in runs if d == k and t in ("b", "PAD"))) for k in {d for d, _ in runs}}
    assert [x[0] if x else None for x in out[1].vectors] == [1, None, 10, None, 3, None]
    for name in ("overlaps_k", "overlap_vectors"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "keys=[text" not in plan and "hashpartitioning(text" not in plan


def test_costs_of_blocks(spark, monkeypatch):
    """A document's pairs are several groups; a vector that is null, holds null or is of another length has no costs."""
    from strandline.operators import alignment

    monkeypatch.setattr(alignment, "BLOCK", 3)
    rng = np.random.default_rng(4)
    vec = lambda n: rng.standard_normal(n).tolist()
    left = [(d, i, vec(4), 0.5 + i) for d in "ab" for i in range(8)] + [("a", 8, None, None), ("a", 9, [1.0, None, 0.0, 0.0], 1.0), ("a", 10, vec(3), 1.0), ("c", 1, vec(4), 1.0)]
    right = [(d, i, vec(4), 0.25 * i) for d in "ab" for i in range(7)] + [("a", 7, vec(3), 2.0), ("d", 1, vec(4), 1.0)]
    got = alignment.pair_costs(spark.createDataFrame(left, "doc_id string, x long, p array<double>, n0 double"), spark.createDataFrame(right, "doc_id string, y int, q array<double>, n1 double"))
    assert [t for _, t in got.dtypes] == ["string", "bigint", "int", "double"]
    whole = lambda p, q: p and q and len(p) == len(q) and None not in p
    want = {(d, x, y): 2 * (1 - float(np.dot(p, q))) / (1e-6 + m + n) if whole(p, q) else None for d, x, p, m in left for e, y, q, n in right if d == e}
    rows = got.collect()
    found = {(r.doc_id, r.x, r.y): r.cost for r in rows}
    assert len(rows) == len(want) and found.keys() == want.keys()
    assert all(v is None and found[k] is None or abs(v - found[k]) < 1e-12 for k, v in want.items())
    assert alignment.pair_costs(*(spark.createDataFrame([], f"doc_id string, {c}") for c in ("x long, p array<double>, n0 double", "y int, q array<double>, n1 double"))).count() == 0


def test_costs_copy_a_vector_a_few_times(spark, monkeypatch):
    """A side is dealt to a fixed number of shares, whatever its length is; a share's pairs are made a block at a time."""
    from strandline.operators import alignment

    assert [alignment._shares(n) for n in (0, 1, 1500, 1501, 5_128, 12_000, 61_500, 1_000_000)] == [1, 1, 1, 2, 4, 8, 8, 8]
    monkeypatch.setattr(alignment, "BLOCK", 2)
    monkeypatch.setattr(alignment, "SHARES", 2)
    rng = np.random.default_rng(9)
    left, right = ([(d, i, rng.standard_normal(4).tolist(), 0.5 + i) for d in "ab" for i in range(n)] for n in (11, 9))
    rows = alignment.pair_costs(spark.createDataFrame(left, "doc_id string, x long, p array<double>, n0 double"), spark.createDataFrame(right, "doc_id string, y int, q array<double>, n1 double")).collect()
    want = {(d, x, y): 2 * (1 - float(np.dot(p, q))) / (1e-6 + m + n) for d, x, p, m in left for e, y, q, n in right if d == e}
    assert len(rows) == len(want) and all(abs(want[r.doc_id, r.x, r.y] - r.cost) < 1e-12 for r in rows)
