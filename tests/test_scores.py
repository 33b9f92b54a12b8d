"""Instances with null alignments, prefix latencies, BLEU, roll-ups and sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import text as X
from strandline.operators import scores
from strandline.sources import readers, writers

SCHEMA = (
    "index long, doc_id string, seg_id string, source string, reference string, prediction string, source_length double, "
    "delays array<double>, elapsed array<double>, recording_end double, null_alignment_type string"
)
ROWS = [
    (0, "d", "1", "source sentence", "eins zwei drei vier", "eins zwei drei vier", 200.0, [100.0], [120.0], 1000.0, ""),
    (1, "d", "2", "quality only", "fuenf sechs sieben acht", "fuenf sechs sieben acht", 200.0, [], [], 1000.0, ""),
    (2, "d", "3", "source sentence", "neun zehn elf zwoelf", "", None, [], [], None, "under_translation"),
    (3, "d", "4", "", "", "zusaetzlicher text", None, [], [], None, "over_translation"),
]


def test_score_row(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    row = scores.score_row(df)
    r = row.first()
    assert row.columns[:5] == ["bleu", "ca_unaware_yaal", "ca_aware_yaal", "ending_offset", "ca_ending_offset"]
    assert (r.segments, r.valid, r.latency, r.under_translation, r.over_translation, r.null_alignments) == (4, 2, 1, 1, 1, 2)
    assert 0 < r.bleu < 100
    assert (r.ending_offset, r.ca_ending_offset, r.ca_unaware_yaal, r.ca_aware_yaal) == (-100.0, -80.0, 100.0, 120.0)
    writers.scores_tsv(row, str(tmp_path / "scores.csv"))
    head, values = (tmp_path / "scores.csv").read_text().splitlines()
    assert head.split("\t")[5] == "segments" and values.split("\t")[5] == "4.0000"


def test_empty_scores(spark):
    r = scores.score_row(spark.createDataFrame([], SCHEMA)).first()
    assert r.segments == 0 and math.isnan(r.ending_offset) and r.bleu == 0.0


def test_report(spark, tmp_path):
    df = spark.createDataFrame([ROWS[0], ROWS[2], ROWS[3]], SCHEMA)
    q = scores.quality_input(df)
    assert [r.score_override for r in q.orderBy("index").collect()] == [None, 0.0, 0.0]
    cards = writers.report_cards(q.withColumns({"first_offset": F.lit(0.25), "end_offset": F.lit(None).cast("double"), "src": F.lit("a <b> & 'c'")}))
    writers.html_report(cards, str(tmp_path / "r.html"))
    html = (tmp_path / "r.html").read_text()
    assert all(f"data-filter='{k}'" in html for k in ("normal", "under_translation", "over_translation"))
    assert "a &lt;b&gt; &amp; &#x27;c&#x27;" in html and "<dd>0.2</dd>" in html and "<dd>-</dd>" in html
    writers.jsonl(q, str(tmp_path / "q"))
    lines = [json.loads(x) for p in (tmp_path / "q").glob("*.json") for x in p.read_text().splitlines()]
    assert any("score_override" in x and x["score_override"] is None for x in lines)


@pytest.mark.parametrize(
    "delays, length, end, longform, want",
    [
        ([100.0, 200.0, 300.0, 400.0], 400.0, 1000.0, True, 100.0), ([100.0, 200.0, 300.0, 400.0], 400.0, 300.0, True, 100.0), ([1000.0, 1.0], 400.0, 1000.0, True, None),
        ([500.0], 400.0, 1000.0, False, None), ([500.0], 400.0, 1000.0, True, 500.0), ([100.0, 300.0, 200.0], 300.0, 250.0, True, 100.0), ([], 300.0, 250.0, True, None), ([100.0], 200.0, None, True, 100.0),
    ],
)
def test_yaal(spark, delays, length, end, longform, want):
    df = spark.createDataFrame([(delays, length, end)], "d array<double>, n double, e double")
    assert df.select(A.yaal(F.col("d"), F.col("n"), F.col("e"), longform=longform)).first()[0] == want


def test_unknown_type_raises(spark):
    df = spark.createDataFrame([(*ROWS[0][:-1], "odd")], SCHEMA)
    with pytest.raises(Exception, match="unknown alignment type"):
        scores.quality_input(df).collect()


def test_bleu_of_equal_texts_is_100(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), (None, None)], "hyp string, ref string")
    assert scores.corpus_bleu(df).first().bleu == pytest.approx(100.0)


def test_rollup_keeps_places(spark):
    df = spark.createDataFrame([("d", 1, "s", "m", "r"), ("d", 2, "", "m", ""), ("d", 3, "", "", "r"), ("d", 4, "s", "", "r")], "doc_id string, seg_id int, src string, mt string, ref string")
    got = scores.score_windows(df, lambda *c: F.lit(0.5), "comet").orderBy("seg_id")
    assert [r.comet for r in got.collect()] == [0.5, 0.0, -1.0, 0.0]
    r = scores.rollup(got, ["comet"]).first()
    assert (r.total_seg, r.misaligned_seg, round(r.comet, 6)) == (3, 2, 0.166667)


def test_text_columns(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"x{i} {'double' if isinstance(a, float) else 'string'}" for i, a in enumerate(v))).select(c).first()[0]
    x = F.col("x0")
    assert one(X.space_tokens(x), "It's 北京, ok!") == ["It's", "北", "京", "ok"]
    assert one(X.mixed_tokens(x), "a-b 北c") == ["a", "b", "北", "c"]
    assert one(X.fix_decimal(x), "84 . 22 and 1 . 2 . 3") == "84.22 and 1.2.3"
    assert one(X.nfkc(x), "ﬁ①") == "fi1"
    assert [one(X.words_length(x), s) for s in ("", "a  b ")] == [1, 4]
    assert [one(X.to_ms(x), s) for s in ("0", "737.44", "737440", "n/a")] == [math.inf, 737440.0, 737440.0, math.inf]
    assert one(X.doc_key(x), "a\\b/c.wav") == "c.wav" and one(X.language_pair(x), "wmt_EN_de_x") == "en-de" and one(X.language_pair(x), "q") == "unknown"
    assert one(X.segment_order(x), "12") == 12 and one(X.segment_order(x), "1_2") == 10**9 and one(X.segment_prefix(x), "14_15") == 14
    assert one(X.language_name(x), "de") == "German" and one(X.language_name(x), "fr") == "fr" and one(X.bleu_tokenizer(x), "zh") == "zh" and one(X.bleu_tokenizer(x), "de") == "13a"
    assert one(X.bleu_tokens(x), "Hello, world. 3,000-4") == ["Hello", ",", "world", ".", "3,000", "-", "4"]
    assert one(X.is_latin(x), "é1") and not one(X.is_latin(x), "北")
    assert one(X.seconds_to_ms(x), 0.0025) == 2


def test_spans(spark):
    df = spark.createDataFrame([("helloworld", ["hello", "zz", "", "world"])], "t string, u array<string>")
    assert [tuple(x) for x in df.select(A.locate_units(F.col("t"), F.col("u"))).first()[0]] == [(0, 5), (-1, -1), (-1, -1), (5, 10)]
    df = spark.createDataFrame([([0, 1, 3, 4], 1, 3)], "i array<int>, a int, b int")
    assert tuple(df.select(A.compact_to_raw(F.col("i"), F.col("a"), F.col("b"))).first()[0]) == (1, 4)
    df = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    got = df.select(A.overlaps(F.col("s"), 2)).first()[0]
    assert [r.text for r in got if r.size == 2] == ["PAD", "a b", "b c"]
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0])], "d array<double>, e array<double>")
    d, e = df.select(*[c.alias(f"x{i}") for i, c in enumerate(A.cut_to_shorter(F.col("d"), F.col("e")))]).first()
    assert d == e == [1.0, 2.0, 3.0]


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"src": "a", "tgt": "b"}\n\nnot json\n{"src": "c"}\n')
    assert readers.jsonl_lenient(spark, str(tmp_path / "m.jsonl")).count() == 1
    (tmp_path / "l.txt").write_text("x\n\n y \n")
    assert [tuple(r) for r in readers.lines(spark, str(tmp_path / "l.txt")).orderBy("row_idx").collect()] == [(0, "x"), (1, ""), (2, " y ")]
    (tmp_path / "s.yaml").write_text("- {wav: a.wav, offset: 1, duration: 2.5}\n- {wav: b.wav, offset: 0, duration: 1}\n")
    assert [r.wav for r in readers.segment_yaml(spark, str(tmp_path / "s.yaml")).orderBy("row_idx").collect()] == ["a.wav", "b.wav"]
    (tmp_path / "a.txt").write_text("[0]:[0]:0.156006\n\n[]:[1]:0.000000\n")
    got = readers.alignments(spark, str(tmp_path / "a.txt")).orderBy("cost").collect()
    assert [(r.src_idx, r.tgt_idx, r.cost) for r in got] == [([], [1], 0.0), ([0], [0], 0.156006)]
    (tmp_path / "arr.json").write_text('[{"doc_id": "d", "n": 1}]')
    assert readers.json_array(spark, str(tmp_path / "arr.json"), "doc_id string, n int").first().n == 1
    r = readers.align_params(spark).first()
    assert (r.max_jump, r.min_cost, r.overlap) == (0.15, 0.30, 10)


def test_wav(tmp_path, spark):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    assert readers.wav_seconds((tmp_path / "a.wav").read_bytes()) == 0.5 and readers.wav_seconds(b"x") == 0.0 and readers.wav_seconds(None) == 0.0
    assert readers.wav_durations(spark, str(tmp_path)).first().seconds == 0.5


def test_clipped_matches(spark):
    from collections import Counter

    rng = np.random.RandomState(6)
    rows = [(" ".join(rng.choice(list("abcd"), rng.randint(0, 30))), " ".join(rng.choice(list("abcd"), rng.randint(0, 30)))) for _ in range(60)] + [("a " * 3000, "a " * 2000), ("", ""), (None, "a b")]
    got = scores.bleu_statistics(spark.createDataFrame(rows, "hyp string, ref string").select("hyp", "ref", F.col("hyp").alias("h"), F.col("ref").alias("r"))).collect()
    grams = lambda t, n: Counter(tuple((t or "").split()[i : i + n]) for i in range(len((t or "").split()) - n + 1))
    assert all(r[f"match_{n}"] == sum((grams(r.h, n) & grams(r.r, n)).values()) for r in got for n in (1, 2, 3, 4))


def test_batches_by_size_and_failures(spark):
    from strandline import plugins
    from strandline.operators import models

    assert models.batches_by_size([3, 50, 10, 9, 200, 9], 2, 100) == [[4], [1, 2], [3, 5], [0]]
    assert models.batches_by_size([], 2, 100) == []

    def worker(contents, languages):
        if any(b"bad" in c for c in contents):
            raise RuntimeError("bad")
        return plugins.spelled(contents, languages)

    plugins.register("transcriber", "bad", worker)
    rows = [(str(i), "x", None if i == 5 else b"bad" if i in (3, 4) else f"w{i} v".encode()) for i in range(12)]
    got = models.transcribe_all(spark.createDataFrame(rows, "src string, tgt string, content binary").coalesce(1), "bad", "en").collect()
    assert [r.src for r in got] == [str(i) for i in range(12)]
    assert {r.src: r.error for r in got if r.error} == {"3": "RuntimeError: bad", "4": "RuntimeError: bad", "5": "no content"}
    assert all(r.text == f"w{r.src} v" and len(r.time_stamps) == 2 for r in got if not r.error)


def test_weighted_sums(spark):
    """Sums of a key over several batches, with null keys, vectors, weights and entries, and vectors of different lengths."""
    import math
    import random
    from collections import defaultdict

    from strandline.operators import alignment

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), [r.random() for _ in range(r.choice([2, 3]))], [r.random() for _ in range(r.choice([1, 4]))]) for _ in range(400)]
    rows += [("a", None, [1.0]), ("b", [1.0, 2.0], None), ("c", [None, 1.0], [1.0]), ("d", [], [1.0]), (None, [1.0], [])]
    want, n = defaultdict(float), defaultdict(int)
    for key, v, w in rows:
        if v and w and None not in v:
            for i, (x, y) in enumerate((x, y) for y in w for x in v):
                want[key, i] += x * y
                n[key, i] += 1
    df = spark.createDataFrame(rows, "k string, v array<double>, w array<double>").repartition(5)
    got = {(x.k, x.pos): (x.sum, x.n) for x in alignment.weighted_sums(df, "k", "v", "w").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k], rel_tol=1e-9) and got[k][1] == n[k] for k in want)
    assert alignment.weighted_sums(df.limit(0), "k", "v", "w").collect() == []
    x = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [])], "i int, v array<double>").selectExpr("i", "v")
    from strandline.functions import arrays as A

    units = {y.i: y.u for y in x.select("i", A.unit(x.v).alias("u")).collect()}
    assert units[2] is None and units[3] == [] and math.isclose(units[1][0], 3 / 5.00001)
