"""Documents, sweeps, a whole evaluation on a small corpus, and running latency on a stream."""

import json

from pyspark.sql import functions as F

from strandline.operators import documents, perturb, sweeps
from strandline.plans.evaluate import Config, run


def test_alignment_stats(spark):
    df = spark.createDataFrame([("d", 0, 0.5), ("d", 0, 0.0), ("d", 0, 0.25), ("d", 0, None)], "doc_id string, step int, cost double")
    r = sweeps.alignment_stats(df).first()
    assert (r.avg_cost, r.zero_ratio) == (0.375, 0.25)


def test_precision(spark):
    s = "file string, src_idx array<int>, tgt_idx array<int>"
    gold = spark.createDataFrame([("f", [0], [0]), ("f", [1], [1, 2])], s)
    test = spark.createDataFrame([("f", [0], [0]), ("f", [1], [1])], s)
    r = sweeps.precision_recall(gold, test).first()
    assert (r.precision_strict, r.precision_lax, r.recall_strict, r.recall_lax, r.f1_strict, r.f1_lax) == (0.5, 1, 0.5, 1, 0.5, 1)


def test_drop_last(spark):
    df = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, seg_id int")
    kept, dropped = documents.drop_last(df, 2)
    assert kept.count() == 1 and dropped.first().dropped == [2, 3]
    assert documents.drop_last(df, 3)[0].count() == 0
    texts = spark.createDataFrame([("d", str(i)) for i in range(1, 12)], "doc_id string, seg_id string")
    kept, dropped = documents.drop_last(texts, 2)
    assert kept.count() == 9 and dropped.first().dropped == ["10", "11"]


def test_overlap_of_text_ids(spark):
    lines = spark.createDataFrame([("d", "10", 5, 10), ("d", "2", 0, 5)], "doc_id string, seg_id string, char_start int, char_end int")
    units = spark.createDataFrame([("d", i, i * 2, i * 2 + 2) for i in range(5)], "doc_id string, unit int, char_start int, char_end int")
    assert sorted((r.seg_id, r.u_start, r.u_end) for r in documents.char_overlap(lines, units).collect()) == [("10", 3, 5), ("2", 0, 3)]


def test_merges(spark):
    s = spark.createDataFrame([("d", "0", "a", "A"), ("d", "1", "b", "B"), ("d", "2", "c", "C")], "doc_id string, seg_id string, src string, tgt string")
    pairs = spark.createDataFrame([("d", 0, 1)], "doc_id string, first long, second long")
    merged = perturb.merge_pairs(s, pairs)
    assert {(r.seg_id, r.src) for r in merged.collect()} == {("0_1", "a b"), ("2", "c")}
    out = {r.seg_id: (r.src, r.tgt) for r in perturb.propagate_merges(merged, s).collect()}
    assert out == {"0": ("a b", "A B"), "1": ("a b", "A B"), "2": ("c", "C")}


def test_number_globally(spark):
    df = spark.range(100).withColumn("k", 1000 - F.col("id"))
    got = documents.number_globally(df, "k").orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(100))


def test_evaluation(spark, tmp_path):
    (tmp_path / "asr").mkdir()
    ref = ["guten morgen liebe welt.", "das ist ein kleiner test.", "vielen dank fuer alles.", "bis morgen im grossen saal.", "dort gibt es kaffee und kuchen."]
    text = " ".join(x.replace("ist", "war").replace("alles", "vieles").replace("morgen", "abend").replace("gibt", "gab") for x in ref)
    words = text.split()
    units = [{"text": w, "start_time": i * 0.5, "end_time": i * 0.5 + 0.4} for i, w in enumerate(words)]
    (tmp_path / "asr" / "a_asr.json").write_text(json.dumps({"src": "x/a.wav", "tgt": "y/a.wav", "text": text, "time_stamps": units}))
    (tmp_path / "asr" / "bad_asr.json").write_text("{")
    (tmp_path / "s.yaml").write_text("".join(f"- {{wav: a.wav, offset: {i * 1.5}, duration: 1.5}}\n" for i in range(5)))
    (tmp_path / "src.txt").write_text("\n".join(ref) + "\n")
    (tmp_path / "ref.txt").write_text("\n".join(ref) + "\n")
    out = run(spark, Config("en", "de", str(tmp_path / "asr"), str(tmp_path / "s.yaml"), str(tmp_path / "src.txt"), str(tmp_path / "ref.txt"), str(tmp_path / "out"), overlap=4))
    assert out["segments"] >= 1 and out["null_alignments"] == 0 and 20 < out["bleu"] < 100
    assert json.loads((tmp_path / "out" / "run_meta.json").read_text())["status"] == "ok"
    rows = [json.loads(x) for p in (tmp_path / "out/output_evaluation/instances.resegmented").glob("*.json") for x in p.read_text().splitlines()]
    assert sum(len(r["delays"]) for r in rows) == len(words)


def test_running_delay(spark, tmp_path):
    from strandline.streaming.latency import running_delay

    rows = [("d", i, 100.0 * i, 350.0) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id string, s int, delay double, recording_end double").select("doc_id", F.timestamp_seconds("s").alias("ts"), "delay", "recording_end")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_delay(stream).writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    r = spark.table("running").orderBy(F.col("tokens").desc()).first()
    assert (r.tokens, r.mean_delay) == (3, 200.0)


def test_reference_alignments(spark):
    """Documents end at the first size with a step that leaves nothing out; the others take the whole alignment at the last size."""
    import numpy as np

    from strandline.operators import alignment

    rng = np.random.RandomState(3)
    x = rng.standard_normal((6, 16))
    same = x.tolist()
    merged = np.stack([x[0:2].sum(0), x[2], x[3:6].sum(0)]).tolist()
    other = rng.standard_normal((1, 16)).tolist()
    kind = "doc_id string, v struct<vectors:array<array<double>>, unknown:array<string>>"
    left = spark.createDataFrame([(d, (same, [])) for d in "abc"] + [("alone", (same, []))], kind)
    right = spark.createDataFrame([("a", (same, [])), ("b", (merged, [])), ("c", (other, []))], kind)
    rows, stats = alignment.reference_alignments(left, right, sizes=(2, 4))
    got = {}
    for r in rows.orderBy("doc_id", "aln_idx").collect():
        got.setdefault((r.doc_id, r.size), []).append((r.src_idx, r.tgt_idx))
    assert got["a", 2] == [([i], [i]) for i in range(6)]
    assert got["b", 4] == [([0, 1], [0]), ([2], [1]), ([3, 4, 5], [2])]
    assert got["c", 4] == [(list(range(6)), [0])] and len(got) == 3
    assert {(r.doc_id, r.size) for r in stats.select("doc_id", "size").distinct().collect()} == {("a", 2), ("b", 4), ("c", 4)}
    assert alignment.estimate_params(rows, stats).first().conservative_overlap_size == 4
