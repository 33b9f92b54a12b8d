"""Queries that write by a sink, read back by a source and return what came back; and those of joins, models and keys that need no
sink. They register themselves with the others (registry.py)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import text as X
from strandline.operators import alignment, documents, models, perturb, scores, sweeps
from strandline.operators.shared import shared_path
from strandline.plans.registry import _CU, _SCORED, _SEGMENTS, _SWEEP, _listed, _swept, _table, instances, query, segments, timelines
from strandline.sources import readers, writers

# -- sources and sinks -------------------------------------------------------------------------------------------


@query("SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations")
def jsonl_dump(spark, d):
    """A dump by role replaces what was written before."""
    p = shared_path(spark, "dump")
    writers.jsonl(_table(spark, d, "region"), p)
    writers.jsonl(_table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), p, ["role"])
    return readers.jsonl(spark, p, "conv_id long, turn long, text string, role string").drop("arrival")


@query("SELECT source AS src, lang AS tgt FROM documents WHERE doc_id % 3 = 2 AND lang IN ('de', 'fr')")
def jsonl_manifest(spark, d):
    p, k = shared_path(spark, "manifest"), F.col("doc_id") % 3
    whole = F.to_json(F.struct(F.col("source").alias("src"), F.col("lang").alias("tgt")))
    _table(spark, d, "documents").select(F.when(k == 0, "not {json").when(k == 1, F.to_json(F.struct(F.col("source").alias("src")))).otherwise(whole).alias("value")).write.text(p)
    there = spark.createDataFrame([("de",), ("fr",)], "path string")
    return readers.jsonl_lenient(spark, p, there).select("src", "tgt")


@query("SELECT n_name AS src, 'x' AS tgt, n_nationkey::VARCHAR AS text FROM nation WHERE n_nationkey % 5 <> 0")
def json_files(spark, d):
    p = shared_path(spark, "files")
    n = _table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("src"), F.lit("x").alias("tgt"), F.col("n_nationkey").cast("string").alias("text"), F.col("n_nationkey").alias("file"))
    writers.jsonl(n, p, ["file"])
    return readers.json_dir(spark, f"{p}/*", "src string, tgt string, text string", "*.json")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_array(spark, d):
    p = shared_path(spark, "array") + ".json"
    writers.json_pretty(_table(spark, d, "nation").select("n_nationkey", "n_name"), p)
    return readers.json_array(spark, p, "n_nationkey long, n_name string")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey::VARCHAR || ' ' || o_orderpriority AS line FROM orders")
def text_lines(spark, d):
    p = shared_path(spark, "lines")
    o = _table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("value"))
    o.orderBy("o_orderkey").select("value").write.text(p)  # files in order, a range of keys each
    return readers.lines(spark, p)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx, 'n' || n_nationkey || '.wav' AS wav, n_nationkey * 1.5::DOUBLE AS offset, 2.5::DOUBLE AS duration FROM nation")
def yaml_segments(spark, d):
    p = shared_path(spark, "yaml")
    k = F.col("n_nationkey")
    n = _table(spark, d, "nation").select(k, F.format_string("- {wav: n%d.wav, offset: %.1f, duration: 2.5}", k, k * 1.5).alias("value"))
    n.coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(p)
    return readers.segment_yaml(spark, p)


@query("SELECT n_nationkey || '.wav' AS file, n_nationkey * 100 / 8000.0::DOUBLE AS seconds FROM nation")
def wav_files(spark, d):
    p = shared_path(spark, "wav")
    for (k,) in _table(spark, d, "nation").select("n_nationkey").collect():  # 25 files
        writers.wav(spark, f"{p}/{k}.wav", bytes(200 * k))
    found = readers.wav_listing(spark, p).join(readers.wav_durations(spark, p), "path")
    return found.select(X.doc_key(F.col("path")).alias("file"), "seconds")


@query("SELECT lpad(vec_id::VARCHAR, 9, '0') AS text, len(embedding)::INTEGER AS dim, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last FROM embeddings")
def vector_files(spark, d):
    p = shared_path(spark, "vectors")
    e = _table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("text"), F.col("embedding").alias("vec"))
    writers.vectors(e, f"{p}/texts.txt", f"{p}/vectors.bin")
    back = readers.embeddings(spark, f"{p}/texts.txt", f"{p}/vectors.bin")
    at = lambda i: F.round(F.element_at("vec", i).cast("double"), 5)
    return back.select("text", F.size("vec").alias("dim"), at(1).alias("first"), at(-1).alias("last"))


@query("SELECT (l_orderkey % 90) || '|' || (l_orderkey % 90 + 1) AS src_idx, l_linenumber::VARCHAR AS tgt_idx, l_discount::DOUBLE AS cost FROM lineitem")
def alignment_files(spark, d):
    p = shared_path(spark, "alignments")
    k = F.col("l_orderkey") % 90
    x = _table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), F.col("l_linenumber").alias("aln_idx"), F.array(k, k + 1).alias("src_idx"), F.array("l_linenumber").alias("tgt_idx"), F.col("l_discount").alias("cost"), F.lit("a\nb").alias("src"), F.lit("c").alias("tgt"))
    writers.alignments_text(x, p, texts=True)
    return readers.alignments(spark, f"{p}/*").select(_listed("src_idx"), _listed("tgt_idx"), "cost")


@query("SELECT DISTINCT regexp_extract(trim(o_orderpriority), '^[^\\s]+') AS word, 1.0::DOUBLE AS score FROM orders")
def dictionary_words(spark, d):
    p = shared_path(spark, "words")
    _table(spark, d, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t1")).alias("value")).write.text(p)
    return readers.dictionary(spark, p)


@query("WITH " + _SWEEP + """, j AS (SELECT zero_ratio - lag(zero_ratio) OVER (PARTITION BY doc_id ORDER BY step) AS jump FROM st), k AS (SELECT quantile_cont(jump, 0.2) AS a, quantile_cont(jump, 0.8) AS b FROM j WHERE jump <> 0),
e AS (SELECT min(avg_cost) AS lo FROM st WHERE zero_ratio > 0 GROUP BY doc_id) SELECT (SELECT round(max(jump), 6) FROM j, k WHERE jump <> 0 AND jump BETWEEN a AND b) AS max_jump, (SELECT round(min(lo), 6) FROM e) AS min_cost, (SELECT max(doc_id % 3 * 2 + 4)::INTEGER FROM st) AS overlap""")
def align_params_file(spark, d):
    p = shared_path(spark, "params")
    stats = sweeps.alignment_stats(_swept(spark, d))
    writers.jsonl(sweeps.align_params(stats, stats.select((F.col("doc_id") % 3 * 2 + 4).alias("size"))), p)
    return readers.align_params(spark, p).select(F.round("max_jump", 6).alias("max_jump"), F.round("min_cost", 6).alias("min_cost"), "overlap")


@query("SELECT 'r' || n_regionkey AS pair, 'f' || n_nationkey % 2 AS folder, 's' || n_nationkey AS system FROM nation WHERE n_nationkey > 1")
def experiment_files(spark, d):
    p = shared_path(spark, "experiments")
    for k, r in _table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():  # 25 files
        writers.write_file(spark, f"{p}/r{r}/f{k % 2}/s{k}.jsonl", ["{}\n"])
    return readers.experiment_files(spark, p, ["s0", "s1"]).drop("path")


@query("WITH " + _SCORED + "SELECT printf('%.4f', count(*)::DOUBLE) AS segments, printf('%.4f', (count(*) FILTER (WHERE kind <> 'normal'))::DOUBLE) AS null_alignments, round((SELECT avg(n * 100 - len) FROM i), 3) AS ending_offset FROM k")
def scores_file(spark, d):
    p = shared_path(spark, "scores") + ".csv"
    writers.scores_tsv(scores.score_row(instances(spark, d)), p)
    row = spark.read.csv(p, sep="\t", header=True)
    return row.select("segments", "null_alignments", F.round(F.col("ending_offset").cast("double"), 3).alias("ending_offset"))


@query(_CU + "SELECT 0::BIGINT AS row_idx, 'doc_id' AS doc_id, 'last_delay' AS last_delay UNION ALL SELECT row_number() OVER (ORDER BY user_id::VARCHAR), user_id::VARCHAR, round(last)::BIGINT::VARCHAR FROM b")
def offsets_file(spark, d):
    p = shared_path(spark, "offsets")
    t = timelines(spark, d).withColumns({"source": F.lit("s"), "prediction": F.lit("t")})
    writers.offsets_csv(scores.offset_rows(t), p)
    field = lambda i: F.split("line", ",")[i]
    whole = F.coalesce(F.round(field(3).try_cast("double")).cast("long").cast("string"), field(3))
    return readers.lines(spark, f"{p}/*.csv").select("row_idx", field(0).alias("doc_id"), whole.alias("last_delay"))


@query("WITH " + _SEGMENTS + "SELECT count(*) AS cards, count(*) FILTER (WHERE kind = 'normal') AS normal, count(*) FILTER (WHERE kind = 'under_translation') AS under, count(*) FILTER (WHERE kind = 'over_translation') AS over_, 'all (' || count(*) || ')' AS tab FROM k")
def report_file(spark, d):
    p = shared_path(spark, "report") + ".html"
    q = scores.quality_input(instances(spark, d)).withColumns({"first_offset": F.lit(0.25), "end_offset": F.lit(None).cast("double")})
    writers.html_report(writers.report_cards(q), p)
    n = lambda what: F.regexp_count("value", F.lit(what)).cast("long")
    page = spark.read.text(p)  # by lines: the page is as large as the table
    return page.agg(F.sum(n("<article ")).alias("cards"), *(F.sum(n(f"data-kind='{k}'")).alias(a) for k, a in (("normal", "normal"), ("under_translation", "under"), ("over_translation", "over_"))), F.max(F.regexp_extract("value", r"all \([0-9]+\)", 0)).alias("tab"))


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) SELECT conv_id || ': ' || string_agg(turn::VARCHAR, ', ' ORDER BY turn) AS value FROM a WHERE c >= 3 AND r <= 2 GROUP BY conv_id")
def drop_log_file(spark, d):
    p = shared_path(spark, "drops")
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_id"))
    writers.drop_log(documents.drop_last(c, 2)[1], p)
    return spark.read.text(p)


@query("SELECT 'ok' AS status, 8::BIGINT AS overlap, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters, true AS known, 0::BIGINT AS secrets FROM documents")
def run_metadata_file(spark, d):
    """The record of a run over documents, with what the run took in."""
    p = shared_path(spark, "meta") + ".json"
    size = _table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first().asDict()
    writers.write_run_metadata(spark, p, writers.run_metadata(spark, {"overlap": 8, **size}, datetime.now(timezone.utc)))
    m = spark.read.schema("status string, config struct<overlap:long,documents:long,characters:long>, spark string, elapsed_sec double, spark_conf map<string,string>").option("multiLine", True).json(p)
    known = F.col("spark").isNotNull() & (F.col("elapsed_sec") >= 0)
    secret = F.filter(F.map_keys("spark_conf"), lambda k: k.rlike("(?i)secret|password|token|credential|key"))
    return m.select("status", "config.overlap", "config.documents", "config.characters", known.alias("known"), F.size(secret).cast("long").alias("secrets"))


@query("SELECT 36::BIGINT AS bars, count(DISTINCT user_id) AS lines FROM events")
def chart_files(spark, d):
    p = shared_path(spark, "charts")
    t = timelines(spark, d)
    writers.histogram_svg(scores.histogram(t.select((F.element_at("delays", -1) / 3e8 - 6).alias("x")), "x"), f"{p}/histogram.svg")
    writers.gap_svg(scores.offset_rows(t.withColumns({"source": F.lit("s"), "prediction": F.lit("t")})), f"{p}/gaps.svg")
    read = lambda f: spark.read.text(f"{p}/{f}.svg", wholetext=True)
    bars = read("histogram").select(F.regexp_count("value", F.lit("<rect ")).cast("long").alias("bars"))
    return bars.crossJoin(read("gaps").select(F.regexp_count("value", F.lit("<polyline ")).cast("long").alias("lines")))  # one row each


# -- keys, joins and order ---------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT n_nationkey, n_name, ['en', 'zh', 'de', 'ja', 'fr'][n_nationkey % 5 + 1] AS code, ['wmt_EN_de', 'x-ja-zh-1', 'en-es', 'none'][n_nationkey % 4 + 1] AS name FROM nation)
SELECT n_nationkey, ['English', 'Chinese', 'German', 'Japanese', 'fr'][n_nationkey % 5 + 1] AS language, ['13a', 'zh', '13a', 'ja-mecab', '13a'][n_nationkey % 5 + 1] AS tokenizer, ['en-de', 'ja-zh', 'en-es', 'unknown'][n_nationkey % 4 + 1] AS pair,
  n_nationkey % 2 = 0 AS matches, CASE WHEN n_nationkey % 3 = 0 THEN 1000000000 ELSE n_nationkey END::BIGINT AS seg_order, printf('%.1f', round_even(n_nationkey * 2.5, 0) / 10) AS tenth, (length(trim(n_name)) + 2)::INTEGER AS chars, len(string_split(n_name, ' '))::INTEGER AS words FROM k""")
def key_functions(spark, d):
    k = F.col("n_nationkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    code, name = pick(["en", "zh", "de", "ja", "fr"]), pick(["wmt_EN_de", "x-ja-zh-1", "en-es", "none"])
    doc = F.when(k % 2 == 0, F.concat(F.lit("2022.acl-long."), k.cast("string"), F.lit(".wav"))).otherwise(F.concat(k.cast("string"), F.lit("x")))
    seg = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("_1"))).otherwise(k.cast("string"))
    return _table(spark, d, "nation").select(
        k, X.language_name(code).alias("language"), X.bleu_tokenizer(code).alias("tokenizer"), X.language_pair(name).alias("pair"), X.doc_matches(doc, k.cast("string")).alias("matches"), X.segment_order(seg).cast("long").alias("seg_order"),
        X.one_decimal(k * 0.25).alias("tenth"), scores.reference_length(F.concat(F.lit(" <"), "n_name", F.lit("> ")), "char").alias("chars"), scores.reference_length(F.col("n_name")).alias("words"),
    )


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[''\\p{L}\\p{N}]+'))::INTEGER AS n, md5(array_to_string(regexp_extract_all(text, '[''\\p{L}\\p{N}]+'), ' ')) AS tokens FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{9FFF}]')")
def tokens_mixed(spark, d):
    t = _table(spark, d, "documents").where(~F.coalesce("text", F.lit("")).rlike(r"[\x{3400}-\x{9FFF}]")).select("doc_id", X.mixed_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(_CU + "SELECT user_id::VARCHAR AS doc_id, CASE WHEN user_id % 2 = 0 THEN n ELSE least(n, 3) END::INTEGER AS n, CASE WHEN user_id % 2 = 0 THEN n ELSE least(n, 3) END::INTEGER AS units FROM b")
def cut_parallel(spark, d):
    """Elapsed times of another length are replaced by the delays; delays that are shorter cut all."""
    t = timelines(spark, d).withColumn("even", F.col("doc_id").cast("long") % 2 == 0)
    delays = F.when(F.col("even"), F.col("delays")).otherwise(F.slice("delays", 1, 3))
    elapsed = F.when(F.col("even"), F.slice("elapsed", 1, 2)).otherwise(F.slice("elapsed", 1, 3))
    a, b, u = A.cut_to_shorter(delays, elapsed, F.col("delays"))
    return t.select("doc_id", F.when(F.size(a) == F.size(b), F.size(a)).alias("n"), F.size(u).alias("units"))


@query("SELECT 'in/' || s_suppkey || '.wav' AS src, 'out/x/' || s_suppkey || '.json' AS tgt FROM supplier WHERE s_suppkey % 2 = 0")
def pair_stems(spark, d):
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    src = s.select(F.concat(F.lit("in/"), "k", F.lit(".wav")).alias("path"))
    return documents.pair_by_stem(src, s.where("cast(k AS long) % 2 = 0").select(F.concat(F.lit("out/x/"), "k", F.lit(".json")).alias("path")))


def _yaml(spark, d):
    p = documents.number_globally(_table(spark, d, "part").select("p_partkey"), "p_partkey", name="row_idx")
    return p.select("row_idx", F.concat(F.lit("w"), (F.col("p_partkey") % 20).cast("string"), F.lit(".wav")).alias("wav"), F.lit(0.5).alias("offset"), F.lit(1.5).alias("duration"), "p_partkey")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, 'w' || p_partkey % 20 || '.wav' AS wav, 's' || p_partkey AS src, 'r' || p_partkey AS ref FROM part")
def zip_lines(spark, d):
    y = _yaml(spark, d)
    line = lambda c: y.select("row_idx", F.concat(F.lit(c), F.col("p_partkey").cast("string")).alias("line"))
    return documents.zip_lines(y, line("s"), line("r")).select("row_idx", "wav", "src", "ref")


@query("WITH y AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_partkey % 20 AS k FROM part) SELECT 'w' || k || '.wav' AS doc_id, min(i) AS first, 't' || k AS text FROM y WHERE k < 10 GROUP BY k")
def transcripts_of(spark, d):
    asr = spark.range(10).select(F.concat(F.lit("a/w"), F.col("id").cast("string"), F.lit(".wav")).alias("src"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    return documents.yaml_to_asr(_yaml(spark, d).drop("p_partkey"), asr).select("doc_id", "first", "text")


@query("SELECT n_name, min(s_suppkey) AS s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def first_match(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return documents.first_match(n, _table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k", "s_suppkey").select("n_name", "s_suppkey")


@query("WITH " + _SEGMENTS + "SELECT doc_id, count(*) AS n, string_agg(tgt, '|' ORDER BY turn) AS tgt FROM s WHERE doc_id::BIGINT % 2 = 0 AND doc_id::BIGINT % 3 <> 0 GROUP BY doc_id")
def usable_segments(spark, d):
    """Of documents that are listed and have units; a reference stands as its own system; a set of documents is kept."""
    s = segments(spark, d)
    k = F.col("doc_id").cast("long")
    units = s.select("doc_id").distinct().withColumn("prediction_units", F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"))))
    kept = documents.restrict(documents.usable_segments(s, s.where(k % 2 == 0), units), s)
    own = documents.ref_self(documents.merge_ref(kept, separator="|")).select("doc_id", "tgt")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(own, "doc_id")


@query("SELECT l_orderkey % 100 AS doc_id, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY 1")
def mean_score(spark, d):
    s = _table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_discount").alias("score"))
    return scores.mean_by_doc(s, "score").withColumn("score", F.round("score", 9))


@query("WITH " + _SEGMENTS + ", d AS (SELECT doc_id, list(src ORDER BY turn) AS s, list(tgt ORDER BY turn) AS t FROM s GROUP BY doc_id HAVING count(*) >= 2) SELECT doc_id, '1' AS seg_id, s[1] || ' ' || s[2] AS src, t[1] || ' ' || t[2] AS ref, t[2] AS tgt, 10::INTEGER AS mt_char_start, 20::INTEGER AS mt_char_end FROM d UNION ALL SELECT doc_id, '2', s[1], t[1], '', -1, -1 FROM d")
def gathered_segments(spark, d):
    docs = documents.merge_ref(segments(spark, d)).where(F.size("src_list") >= 2)
    docs = docs.withColumn("tgt_sentences", F.transform("ref_list", lambda t, i: F.struct(t.alias("sentence"), (i * 10).cast("int").alias("char_start"), (i * 10 + 10).cast("int").alias("char_end"))))
    ints = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    pairs = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("aln_idx"), ints(0, 1).alias("src_idx"), ints(1).alias("tgt_idx")), F.struct(F.lit(1).alias("aln_idx"), ints(0).alias("src_idx"), ints().alias("tgt_idx")))).alias("a")).select("doc_id", "a.*")
    return alignment.aligned_segments(pairs, docs).select("doc_id", "seg_id", "src", "ref", "tgt", "mt_char_start", "mt_char_end")


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM documents), o AS (SELECT doc_id, k, i, s FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM s), range(1, 4) t(k)),
x AS (SELECT doc_id, CASE WHEN i + 1 < k THEN 'PAD' ELSE left(replace(trim(array_to_string(s[i + 2 - k:i + 1], ' ')), chr(10), ' '), 10000) END AS text FROM o)
SELECT doc_id, count(*)::INTEGER AS n, (count(*) FILTER (WHERE length(text) % 2 = 1))::INTEGER AS unknown FROM x GROUP BY doc_id""")
def overlap_vectors(spark, d):
    """Vectors of the runs of 1 to 3 lines, for texts of even length; the others have none."""
    docs = _table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("s"))
    texts = alignment.distinct_overlaps(docs, "s", 3).where(F.length("text") % 2 == 0)
    v = alignment.with_vectors(docs, texts.withColumn("vec", F.array(F.length("text").cast("float"))), "s", 3, "v")
    return v.select("doc_id", F.size("v.vectors").alias("n"), F.size("v.unknown").alias("unknown"))


@query("WITH " + _SWEEP + ", z AS (SELECT doc_id, step, round(avg_cost, 9) AS avg_cost FROM st WHERE zero_ratio = 0) SELECT doc_id, arg_min(step, avg_cost * 1000000000 + step) AS step FROM z GROUP BY doc_id")
def sweep_without_zeros(spark, d):
    s = sweeps.alignment_stats(_swept(spark, d)).withColumn("avg_cost", F.round("avg_cost", 9))
    return sweeps.best_without_zeros(s).select("doc_id", "step")


@query("WITH " + _SEGMENTS + "SELECT doc_id, seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS place FROM s")
def segments_in_order(spark, d):
    from pyspark.sql import Window

    s = documents.order_segments(segments(spark, d)).withColumn("_at", F.monotonically_increasing_id())
    return s.select("doc_id", "seg_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")).cast("long").alias("place"))


# -- models ------------------------------------------------------------------------------------------------------

_F1 = "2.0 * len(list_intersect(list_distinct(list_filter(string_split({a}, ' '), lambda x: x <> '')), list_distinct(list_filter(string_split({b}, ' '), lambda x: x <> '')))) / (len(list_distinct(list_filter(string_split({a}, ' '), lambda x: x <> ''))) + len(list_distinct(list_filter(string_split({b}, ' '), lambda x: x <> ''))))"


@query("WITH " + _SEGMENTS + f"SELECT doc_id, seg_id, CASE WHEN trim(src) <> '' AND trim(tgt) <> '' THEN round({_F1.format(a='replace(tgt, chr(10), chr(32))', b='replace(src, chr(10), chr(32))')}, 6) ELSE 0.0 END AS comet, CASE WHEN trim(src) <> '' AND trim(tgt) <> '' THEN round({_F1.format(a='replace(tgt, chr(10), chr(32))', b='replace(src, chr(10), chr(32))')}, 6) ELSE 25.0 END AS metricx FROM s")
def metric_scores(spark, d):
    """Scores by a stand-in (F1 of words), with the worst value of each metric where a text is missing: 0, and 25 where lower is better."""
    s = segments(spark, d).select("doc_id", "seg_id", "src", F.col("tgt").alias("mt"), F.col("src").alias("ref"))
    out = models.score_as(models.score_as(s, "comet"), "metricx-qe")
    return out.select("doc_id", "seg_id", F.round("comet", 6).alias("comet"), F.round("metricx-qe", 6).alias("metricx"))


@query("WITH " + _SEGMENTS + "SELECT doc_id, CASE WHEN turn % 2 = 0 THEN turn || '_' || turn + 1 ELSE seg_id END AS seg_id, CASE WHEN turn % 2 = 0 THEN trim(src || ' ' || tgt) ELSE src END AS src, CASE WHEN turn % 2 = 0 THEN trim(tgt || ' ' || src) ELSE tgt END AS tgt, CASE WHEN turn % 2 = 0 THEN 3 ELSE 0 END::INTEGER AS tried FROM s")
def rewritten_merges(spark, d):
    """No rewriting is ever like enough here, so after three tries the parts' own texts stay."""
    from strandline import plugins

    plugins.register("similarity", "never", lambda a, b: 0.0)
    k = F.col("seg_id").cast("long")
    even = k % 2 == 0
    s = segments(spark, d)
    m = s.select("doc_id", F.when(even, F.concat_ws("_", "seg_id", (k + 1).cast("string"))).otherwise(F.col("seg_id")).alias("seg_id"), F.col("src").alias("src_1"), F.col("tgt").alias("src_2"), F.col("tgt").alias("tgt_1"), F.col("src").alias("tgt_2"))
    return models.rewrite_merges(m, similarity="never").withColumn("tried", F.col("tried").cast("int"))


@query("SELECT doc_id::VARCHAR AS src, md5(text) AS text, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::INTEGER AS units FROM documents WHERE text IS NOT NULL")
def transcripts(spark, d):
    """A stand-in for a model: recordings that are texts, each word half a second."""
    files = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("src"), F.lit("x").alias("tgt"), F.encode("text", "UTF-8").alias("content"))
    return models.transcribe(files, "spelled", "en").select("src", F.md5("text").alias("text"), F.size("time_stamps").alias("units"))


def _spelled_unless_sevenths(contents, languages):
    from strandline import plugins

    if any(len(c) % 7 == 0 for c in contents):
        raise ValueError("a length that 7 divides")
    return plugins.spelled(contents, languages)[: 1 if len(contents) > 6 else None]


@query(r"""SELECT doc_id::VARCHAR AS src, CASE WHEN strlen(text) % 7 > 0 THEN md5(text) END AS text, CASE WHEN text IS NULL THEN 'no content' WHEN strlen(text) % 7 = 0 THEN 'ValueError: a length that 7 divides' END AS error FROM documents""")
def transcript_failures(spark, d):
    """A stand-in that raises for some recordings, and gives too few results for batches of more than six: these alone fail, with their reason, whatever batch they were in."""
    from strandline import plugins

    plugins.register("transcriber", "sevenths", _spelled_unless_sevenths)
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src"), F.lit("x").alias("tgt"), F.encode("text", "UTF-8").alias("content"))
    return models.transcribe_all(files, "sevenths", "en", batch=9, budget=1 << 20).select("src", F.md5("text").alias("text"), "error")


@query("WITH " + _SEGMENTS + """, j AS (SELECT *, turn % 2 = 0 AS even, trim(src || ' ' || tgt) AS a, trim(tgt || ' ' || src) AS b FROM s)
SELECT doc_id, CASE WHEN even THEN turn || '_' || turn + 1 ELSE seg_id END AS seg_id, CASE WHEN NOT even THEN src WHEN length(a) % 2 = 0 THEN tgt || '; ' || src ELSE a END AS src,
CASE WHEN NOT even THEN tgt WHEN length(b) % 2 = 0 THEN src || '; ' || tgt ELSE b END AS tgt FROM j""")
def accepted_rewritings(spark, d):
    """Rewritings that are like enough where the joined text has an even length, and the parts' own texts elsewhere."""
    from strandline import plugins

    plugins.register("rewriter", "turned", lambda a, b: f"{b}; {a}")
    plugins.register("similarity", "even", lambda a, b: 1.0 if len(a) % 2 == 0 else 0.0)
    k = F.col("seg_id").cast("long")
    even = k % 2 == 0
    m = segments(spark, d).select("doc_id", F.when(even, F.concat_ws("_", "seg_id", (k + 1).cast("string"))).otherwise(F.col("seg_id")).alias("seg_id"), F.col("src").alias("src_1"), F.col("tgt").alias("src_2"), F.col("tgt").alias("tgt_1"), F.col("src").alias("tgt_2"))
    return models.rewrite_merges(m, rewriter="turned", similarity="even").select("doc_id", "seg_id", "src", "tgt")


@query("WITH " + _SEGMENTS + ", m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM s), n AS (SELECT doc_id, seg_id, row_number() OVER (ORDER BY md5(doc_id || ':' || seg_id || ':7'), doc_id, seg_id) AS r, count(*) OVER () AS n FROM m WHERE c > 1) SELECT doc_id, seg_id FROM n WHERE r <= greatest(1, ceil(round(0.1 * n * 1000000) / 1000000))")
def sample_segments(spark, d):
    return perturb.sample(segments(spark, d), 0.1, seed=7).select("doc_id", "seg_id")
