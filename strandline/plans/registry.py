"""All queries of the engine by name over the driver's tables, and the SQL of those that SQL can express.

Tables stand in for the evaluation's own: users of events are recordings whose events are timed tokens, conversations are
segments (user turns) with targets (the assistant's next turns), vectors of a label are a document's sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import text as X
from strandline.operators import alignment, documents, perturb, resegment, scores, sweeps
from strandline.operators.shared import materialised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _listed(c: str) -> F.Column:
    """A list as text, alike in every engine."""
    return F.array_join(F.col(c).cast("array<string>"), "|").alias(c)


# -- latency -----------------------------------------------------------------------------------------------------


def timelines(spark: SparkSession, d: str) -> DataFrame:
    """A recording for each user: delays in ms since the first event, elapsed times, and lengths."""
    e = _table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    per = per.withColumn("delays", F.expr("transform(x, e -> timestampdiff(MICROSECOND, x[0].ts, e.ts) / 1000.0D)"))
    last = F.element_at("delays", -1)
    return per.select(
        F.col("user_id").cast("string").alias("doc_id"), F.lit("1").alias("seg_id"), "delays", F.zip_with("delays", "x", lambda t, v: t + v["value"]).alias("elapsed"),
        F.greatest(F.lit(1.0), last * 0.5).alias("source_length"), (last * 0.8).alias("recording_end"),
    )


_EVENTS = """
e AS (SELECT user_id, event_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
b AS (SELECT user_id, max(t) AS last, count(*) AS n FROM e GROUP BY user_id),
p AS (SELECT e.*, n, last, greatest(1.0::DOUBLE, last * 0.5::DOUBLE) AS src, last * 0.8::DOUBLE AS fin, {x} AS d FROM e JOIN b USING (user_id)),
c AS (SELECT user_id, coalesce(min(i) FILTER (WHERE {cut}), any_value(n)) AS tau FROM p GROUP BY user_id),
y AS (SELECT user_id, avg(d - i * (src / n)) AS yaal FROM p JOIN c USING (user_id) WHERE i < tau GROUP BY user_id)
"""
_CU = "WITH " + _EVENTS.format(x="t", cut="d >= fin")
_CA = "WITH " + _EVENTS.format(x="t + value", cut="d >= fin")
_SHORT = "WITH " + _EVENTS.format(x="t", cut="d >= fin OR d >= src")


@query(_CU + "SELECT user_id::VARCHAR AS doc_id, round(yaal, 3) AS yaal FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN y USING (user_id)")
def yaal_by_doc(spark, d):
    t = timelines(spark, d)
    return t.select("doc_id", F.round(A.yaal(F.col("delays"), F.col("source_length"), F.col("recording_end")), 3).alias("yaal"))


@query(_CU + "SELECT round(avg(yaal), 3) AS yaal, count(yaal) AS docs FROM y")
def yaal_corpus(spark, d):
    t = timelines(spark, d).select(A.yaal(F.col("delays"), F.col("source_length"), F.col("recording_end")).alias("y"))
    return t.agg(F.round(F.avg("y"), 3).alias("yaal"), F.count("y").alias("docs"))


@query(_CA + "SELECT round(avg(yaal), 3) AS yaal, count(yaal) AS docs FROM y")
def ca_yaal_corpus(spark, d):
    t = timelines(spark, d).select(A.yaal(F.col("elapsed"), F.col("source_length"), F.col("recording_end")).alias("y"))
    return t.agg(F.round(F.avg("y"), 3).alias("yaal"), F.count("y").alias("docs"))


@query(_SHORT + "SELECT user_id::VARCHAR AS doc_id, round(yaal, 3) AS yaal FROM y")
def yaal_shortform(spark, d):
    t = timelines(spark, d)
    y = F.round(A.yaal(F.col("delays"), F.col("source_length"), F.col("recording_end"), longform=False), 3)
    # left out by a generator: a filter would be pushed below the columns, which are then worked out anew for each element of a fold
    return t.select("doc_id", F.explode(F.filter(F.array(y), lambda v: v.isNotNull())).alias("yaal"))


@query(_CA + "SELECT user_id::VARCHAR AS doc_id, round(last - any_value(src), 5) AS ending_offset, round(max_by(d, i) - any_value(src), 5) AS ca_ending_offset, round(min_by(d, i) - any_value(src), 5) AS first_offset FROM p GROUP BY user_id, last")
def ending_offset(spark, d):
    t = timelines(spark, d)
    n = F.col("source_length")
    return t.select("doc_id", F.round(A.ending_offset(F.col("delays"), n), 5).alias("ending_offset"), F.round(A.ending_offset(F.col("elapsed"), n), 5).alias("ca_ending_offset"), F.round(F.try_element_at("elapsed", F.lit(1)) - n, 5).alias("first_offset"))


@query(_CU + "SELECT user_id::VARCHAR AS doc_id, '1' AS seg_id, 0.0::DOUBLE AS first_delay, round(last, 5) AS last_delay, round(last * 0.8, 5) AS recording_end, round(last, 5) AS delay_span, round(last - last * 0.8, 5) AS gap, round(last - last * 0.8, 5) AS diff_ms_span FROM b")
def offset_rows(spark, d):
    t = timelines(spark, d).withColumns({"source": F.lit("s"), "prediction": F.lit("t")})
    out = scores.offset_rows(t)
    return out.select("doc_id", "seg_id", *(F.round(c, 5).alias(c) for c in out.columns[2:]))


@query(_CU + """, v AS (SELECT (last * 0.2) / 3e8 - 6 AS x FROM b), h AS (SELECT CASE WHEN x = 9 THEN 36 WHEN x >= -9 AND x < 9 THEN floor((x + 9) / 0.5)::INT + 1 END AS bin FROM v)
SELECT k::INTEGER AS bin, -9.0::DOUBLE + (k - 1) * 0.5 AS low, count(h.bin) AS n FROM range(1, 37) r(k) LEFT JOIN h ON h.bin = k GROUP BY k""")
def offset_histogram(spark, d):
    t = timelines(spark, d).select((F.element_at("delays", -1) * F.lit(0.2) / 3e8 - 6).alias("x"))
    return scores.histogram(t, "x")


@query(_CU + "SELECT user_id::VARCHAR AS doc_id, i AS pos, round(greatest(0.0, d - src * 0.1), 5) AS t FROM p")
def rel_timestamps(spark, d):
    t = timelines(spark, d)
    return t.select("doc_id", F.posexplode(A.relative(F.col("delays"), F.col("source_length") * 0.1)).alias("pos", "t")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("t", 5).alias("t"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN 'Infinity'::DOUBLE WHEN value * 400 < 10000 THEN value * 400 * 1000 ELSE value * 400 END AS ms, round_even(value * 1000, 0)::BIGINT AS int_ms FROM events")
def to_ms(spark, d):
    e = _table(spark, d, "events")
    # a length that is null is endless to the function; the SQL's is null
    return e.select("event_id", F.when(F.col("value").isNotNull(), X.to_ms(F.col("value") * 400)).alias("ms"), X.seconds_to_ms(F.col("value")).alias("int_ms"))


# -- segments ----------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's next turn as target; system turns are targets without a source."""
    c = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w)).where("role IN ('user', 'system')")
    user = F.col("role") == "user"
    return c.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("seg_id"), F.lit("s1").alias("sys_id"), F.col("turn").alias("arrival"), F.when(user, F.col("text")).otherwise("").alias("src"),
        F.when(user, F.when(F.col("_r") == "assistant", F.col("_t")).otherwise("")).otherwise(F.col("text")).alias("tgt"),
    )


_SEGMENTS = """s0 AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id::VARCHAR AS doc_id, turn, turn::VARCHAR AS seg_id, CASE WHEN role = 'user' THEN text ELSE '' END AS src,
  CASE WHEN role = 'user' THEN CASE WHEN r = 'assistant' THEN t ELSE '' END ELSE text END AS tgt FROM s0 WHERE role IN ('user', 'system')),
k AS (SELECT *, CASE WHEN trim(src) = '' THEN 'over_translation' WHEN trim(tgt) = '' THEN 'under_translation' ELSE 'normal' END AS kind FROM s)
"""


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Segments as instances, with times of length by their words."""
    s = segments(spark, d)
    n = F.size(F.split("tgt", " ", -1))
    return s.select(
        F.xxhash64("doc_id", "seg_id").alias("index"), "doc_id", "seg_id", F.col("src").alias("source"), F.col("src").alias("reference"), F.col("tgt").alias("prediction"), F.lit("").alias("null_alignment_type"),
        F.when((F.col("src") != "") & (F.col("tgt") != ""), F.transform(F.sequence(F.lit(1), n), lambda i: i * F.lit(100.0))).otherwise(F.array().cast("array<double>")).alias("delays"),
        F.when((F.col("src") != "") & (F.col("tgt") != ""), F.transform(F.sequence(F.lit(1), n), lambda i: i * F.lit(120.0))).otherwise(F.array().cast("array<double>")).alias("elapsed"),
        F.when(F.col("src") != "", (F.size(F.split("src", " ", -1)) * 90).cast("double")).alias("source_length"), F.lit(2000.0).alias("recording_end"),
    )


@query("WITH " + _SEGMENTS + "SELECT count(*) AS segments, count(*) FILTER (WHERE kind = 'normal') AS valid, count(*) FILTER (WHERE kind = 'normal') AS latency, count(*) FILTER (WHERE kind = 'over_translation') AS over_translation, count(*) FILTER (WHERE kind = 'under_translation') AS under_translation, count(*) FILTER (WHERE kind <> 'normal') AS null_alignments FROM k")
def alignment_summary(spark, d):
    return scores.summary(scores.quality_input(instances(spark, d)))


@query("WITH " + _SEGMENTS + "SELECT doc_id, seg_id, src, tgt AS mt, src AS ref, kind AS null_alignment_type, CASE WHEN kind <> 'normal' THEN 0.0::DOUBLE END AS score_override, kind = 'normal' AS latency_eligible FROM k")
def quality_inputs(spark, d):
    return scores.quality_input(instances(spark, d)).drop("index")


@query("WITH " + _SEGMENTS + "SELECT doc_id, seg_id, CASE WHEN kind = 'normal' THEN '' ELSE kind END AS branch, CASE WHEN kind = 'normal' THEN 'timed' ELSE 'null_' || kind END AS method FROM k")
def null_branch(spark, d):
    b = scores.null_branch(F.col("src"), F.col("tgt"))
    return segments(spark, d).select("doc_id", "seg_id", b.alias("branch"), F.when(b == "", "timed").otherwise(F.concat(F.lit("null_"), b)).alias("method"))


_SCORED = _SEGMENTS + """, i AS (SELECT doc_id, seg_id, len(string_split(tgt, ' ')) AS n, (len(string_split(src, ' ')) * 90)::DOUBLE AS len FROM k WHERE kind = 'normal'),
u AS (SELECT doc_id, seg_id, n, len, unnest(range(n)) AS t FROM i),
f AS (SELECT doc_id, seg_id, avg((t + 1) * 100 - t * (len / n)) AS y FROM u WHERE (t + 1) * 100 < 2000 GROUP BY ALL),
g AS (SELECT doc_id, seg_id, avg((t + 1) * 120 - t * (len / n)) AS y FROM u WHERE (t + 1) * 120 < 2000 GROUP BY ALL)
"""


@query("WITH " + _SCORED + """SELECT (SELECT round(avg(y), 6) FROM f) AS ca_unaware_yaal, (SELECT round(avg(y), 6) FROM g) AS ca_aware_yaal, (SELECT round(avg(n * 100 - len), 6) FROM i) AS ending_offset, (SELECT round(avg(n * 120 - len), 6) FROM i) AS ca_ending_offset,
  count(*) AS segments, count(*) FILTER (WHERE kind = 'normal') AS valid, count(*) FILTER (WHERE kind = 'normal') AS latency, count(*) FILTER (WHERE kind = 'over_translation') AS over_translation, count(*) FILTER (WHERE kind = 'under_translation') AS under_translation, count(*) FILTER (WHERE kind <> 'normal') AS null_alignments FROM k""")
def score_row(spark, d):
    out = scores.score_row(instances(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.drop("bleu").dtypes))


@query("WITH " + _SEGMENTS + "SELECT doc_id, 's1' AS sys_id, string_agg(src, chr(10) ORDER BY turn) AS src, string_agg(tgt, chr(10) ORDER BY turn) AS tgt FROM s GROUP BY doc_id")
def merge_system(spark, d):
    return documents.merge_system(segments(spark, d))


@query("WITH " + _SEGMENTS + "SELECT doc_id, string_agg(tgt, chr(10) ORDER BY turn) AS ref, string_agg(src, '|' ORDER BY turn) AS src_list, string_agg(turn::VARCHAR, '|' ORDER BY turn) AS src_ref_ids FROM s GROUP BY doc_id")
def merge_ref(spark, d):
    return documents.merge_ref(segments(spark, d)).select("doc_id", "ref", _listed("src_list"), _listed("src_ref_ids"))


@query("WITH " + _SEGMENTS + ", r AS (SELECT * FROM s WHERE src = '') SELECT a.doc_id, a.tgt, coalesce(b.ref, '') AS ref, coalesce(n, 0)::INTEGER AS n FROM (SELECT doc_id, string_agg(tgt, ' ' ORDER BY turn) AS tgt FROM s GROUP BY doc_id) a LEFT JOIN (SELECT doc_id, string_agg(tgt, ' ' ORDER BY turn) AS ref, count(*) AS n FROM r GROUP BY doc_id) b USING (doc_id)")
def combine_docs(spark, d):
    s = segments(spark, d)
    ref = documents.merge_ref(s.where("src = ''"), separator=" ")
    return documents.combine(documents.merge_system(s, separator=" "), ref).select("doc_id", "tgt", "ref", F.size("src_list").alias("n"))


@query("WITH " + _SEGMENTS + "SELECT doc_id, string_agg(src, '|' ORDER BY turn) FILTER (WHERE src <> '') AS src_list, string_agg(turn::VARCHAR, '|' ORDER BY turn) FILTER (WHERE src <> '') AS src_ref_ids FROM s GROUP BY doc_id HAVING count(*) FILTER (WHERE src <> '') > 0")
def clean_lists(spark, d):
    return documents.drop_empty_sources(documents.merge_ref(segments(spark, d))).where(F.size("src_list") > 0).select("doc_id", _listed("src_list"), _listed("src_ref_ids"))


@query("""WITH a AS (SELECT conv_id, turn, role, text, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM a)
SELECT conv_id, island::BIGINT AS island, role, min(turn) AS first, ' ' || string_agg(text, ' ' ORDER BY turn) AS text FROM b GROUP BY conv_id, island, role""")
def concat_islands(spark, d):
    return documents.islands(_table(spark, d, "conversations"), "conv_id", "role", "turn", "text")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS index, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS seg_id FROM conversations")
def seq_index(spark, d):
    c = documents.number_globally(_table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return documents.number_in_doc(c.withColumnRenamed("conv_id", "doc_id"), "turn").select(F.col("doc_id").alias("conv_id"), "turn", "index", "seg_id")


@query("""WITH a AS (SELECT n, conv_id, turn, row_number() OVER (PARTITION BY n, conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY n, conv_id) AS c FROM conversations, range(5) t(n))
SELECT n::INTEGER AS n, count(DISTINCT conv_id) AS docs, count(*) FILTER (WHERE r > n) AS kept, count(*) FILTER (WHERE r <= n) AS dropped FROM a WHERE c >= n + 1 GROUP BY n""")
def drop_last_n(spark, d):
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_id"))
    out = None
    for n in range(5):
        kept, dropped = documents.drop_last(c, n)
        row = kept.agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("kept")).crossJoin(dropped.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0)).alias("dropped"))).select(F.lit(n).alias("n"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n_tokens FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 1024")
def token_budget(spark, d):
    return documents.within_budget(_table(spark, d, "documents"), ["text"], 1024).select("doc_id", "n_tokens")


@query("WITH k AS (SELECT count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 1024) AS kept, count(*) AS docs FROM documents) SELECT docs, kept, round((docs - kept) / docs * 100, 6) AS dropped_percent FROM k")
def drop_rate(spark, d):
    docs = _table(spark, d, "documents")
    out = documents.drop_rate(docs, documents.within_budget(docs, ["text"], 1024))
    return out.withColumn("dropped_percent", F.round("dropped_percent", 6))


@query("""WITH a AS (SELECT (l_orderkey % 200)::VARCHAR AS doc_id, l_suppkey AS sid, l_partkey AS i FROM lineitem),
s AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, (p_partkey % 200)::VARCHAR AS doc_id, p_retailprice AS price FROM part)
SELECT a.doc_id, a.sid::VARCHAR AS seg_id, round(min_by(price, row_idx), 2) AS start_ms, round(max_by(price, row_idx) + 1, 2) AS end_ms FROM (SELECT doc_id, sid, unnest(list(i)) AS i FROM a GROUP BY doc_id, sid) a LEFT JOIN s ON s.doc_id = a.doc_id AND s.row_idx = a.i - 1 GROUP BY a.doc_id, a.sid""")
def ids_to_span(spark, d):
    li = _table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).cast("string").alias("doc_id"), F.col("l_suppkey").cast("string").alias("seg_id"), F.col("l_partkey").cast("int").alias("i"))
    segs = li.groupBy("doc_id", "seg_id").agg(F.collect_list("i").alias("src_ref_ids"))
    parts = documents.number_globally(_table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", name="row_idx")
    sents = parts.select((F.col("p_partkey") % 200).cast("string").alias("doc_id"), "row_idx", F.col("p_retailprice").alias("start_ms"), (F.col("p_retailprice") + 1).alias("end_ms"))
    return documents.ids_to_span(segs, sents).select("doc_id", "seg_id", F.round("start_ms", 2).alias("start_ms"), F.round("end_ms", 2).alias("end_ms"))


# -- spans and texts ---------------------------------------------------------------------------------------------

_LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, line, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a FROM l0)
"""


@query("WITH " + _LINES + "SELECT doc_id, line_no::INTEGER AS line_no, line AS sentence, a AS char_start, a + length(line) AS char_end FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def sentence_offsets(spark, d):
    return documents.sentence_offsets(_table(spark, d, "documents"))


@query("WITH " + _LINES + """, u AS (SELECT doc_id, unnest(range(0, length(text) // 7)) AS unit FROM documents),
m AS (SELECT l.doc_id, line_no, min(unit) AS first, max(unit) AS last FROM l JOIN u ON u.doc_id = l.doc_id AND unit * 7 < a + length(line) AND unit * 7 + 7 > a WHERE length(line) > 0 GROUP BY l.doc_id, line_no),
k AS (SELECT *, coalesce(max(last + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM m)
SELECT doc_id, line_no::INTEGER AS seg_id, greatest(first, cur)::BIGINT AS u_start, (last + 1)::BIGINT AS u_end FROM k WHERE last + 1 > greatest(first, cur)""")
def char_overlap(spark, d):
    return documents.char_overlap(*_overlap_sides(spark, d, "int"))


def _overlap_sides(spark, d, kind):
    docs = _table(spark, d, "documents")
    lines = documents.sentence_offsets(docs.select("doc_id", "text")).select("doc_id", F.col("line_no").alias("seg_id"), "char_start", "char_end")
    blank = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    lines = blank.select("doc_id", F.col("line_no").alias("seg_id"), at.alias("char_start"), (at + F.length("line")).alias("char_end"))
    n = F.floor(F.length("text") / 7)
    units = docs.where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("unit")).select("doc_id", "unit", (F.col("unit") * 7).alias("char_start"), (F.col("unit") * 7 + 7).alias("char_end"))
    return lines.withColumn("seg_id", F.col("seg_id").cast(kind)), units


_OVERLAP = ORACLE_SQL["char_overlap"]


@query(_OVERLAP.replace("line_no::INTEGER AS seg_id", "line_no::VARCHAR AS seg_id"))
def char_overlap_text_ids(spark, d):
    """Ids that are texts: "10" comes after "2"."""
    return documents.char_overlap(*_overlap_sides(spark, d, "string"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS id FROM documents), r AS (SELECT *, max(id) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT doc_id, count(*) FILTER (WHERE id <= n - 2) AS kept, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE id > n - 2) AS dropped FROM r WHERE n > 2 GROUP BY doc_id""")
def drop_last_text_ids(spark, d):
    lines = _table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("string").alias("seg_id"))
    kept, dropped = documents.drop_last(lines, 2)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept")).join(dropped, "doc_id").select("doc_id", "kept", F.array_join("dropped", ",").alias("dropped"))



@query(r"""WITH RECURSIVE d AS (SELECT item_id, lower(regexp_replace(text, '[^''\p{L}\p{N}]', '', 'g')) AS s, list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '[^''\p{L}\p{N}]', '', 'g'))) AS u FROM benchmark),
r AS (SELECT item_id, s, u, 0 AS i, 0::BIGINT AS cur, -1::BIGINT AS a, -1::BIGINT AS b FROM d UNION ALL
SELECT item_id, s, u, i + 1, CASE WHEN h > 0 THEN cur + h - 1 + length(u[i + 1]) ELSE cur END, CASE WHEN h > 0 THEN cur + h - 1 ELSE -1 END, CASE WHEN h > 0 THEN cur + h - 1 + length(u[i + 1]) ELSE -1 END
FROM (SELECT *, CASE WHEN u[i + 1] = '' THEN 0 ELSE instr(substr(s, cur + 1), u[i + 1]) END AS h FROM r WHERE i < len(u)))
SELECT item_id, (i - 1)::INTEGER AS pos, a::INTEGER AS char_start, b::INTEGER AS char_end FROM r WHERE i > 0""")
def char_span_locate(spark, d):
    b = _table(spark, d, "benchmark")
    units = F.transform(F.split("text", r"\s+", -1), lambda u: F.lower(X.kept_chars(u)))
    return b.select("item_id", F.posexplode(A.locate_units(F.lower(X.kept_chars(F.col("text"))), units)).alias("pos", "x")).select("item_id", "pos", "x.*")


@query(r"""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\s+'), lambda w: regexp_replace(w, '[^''\p{L}\p{N}]', '', 'g')) AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x <> ''))::INTEGER AS n, md5(array_to_string(list_filter(w, lambda x: x <> ''), ' ')) AS tokens FROM w""")
def tokens_space_lang(spark, d):
    t = _table(spark, d, "documents").select("doc_id", X.tokens(F.col("text"), "english").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(r"""SELECT item_id, lower(regexp_replace(text, '[^''\p{L}\p{N}]', '', 'g')) AS stream, regexp_replace(lower(text), '[\p{P}\p{Z}\p{C}]', '', 'g') AS token,
regexp_replace(regexp_replace('84 . 22 ' || item_id || '. 5', '(\d)(?:\s+\.\s*|\s*\.\s+)(\d)', '\1.\2', 'g'), '(\d)(?:\s+\.\s*|\s*\.\s+)(\d)', '\1.\2', 'g') AS fixed, regexp_matches(trim(text), '^[\x{20}-\x{4DFF}]+$') AS latin,
len(string_split(text, ' '))::INTEGER AS words, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS clipped FROM benchmark""")
def text_functions(spark, d):
    t = F.col("text")
    return _table(spark, d, "benchmark").select("item_id", X.char_stream(t).alias("stream"), X.match_token(t).alias("token"), X.fix_decimal(F.concat(F.lit("84 . 22 "), F.col("item_id").cast("string"), F.lit(". 5"))).alias("fixed"), X.is_latin(t).alias("latin"), X.words_length(t).alias("words"), X.clip(t, 40).alias("clipped"))


@query(r"""WITH p AS (SELECT a.n_name AS needle, b.n_name AS hay FROM nation a, nation b), q AS (SELECT *, lower(regexp_replace(needle, '[\p{P}\p{Z}\p{C}]', '', 'g')) AS n, lower(regexp_replace(hay, '[\p{P}\p{Z}\p{C}]', '', 'g')) AS h FROM p)
SELECT needle, hay FROM q WHERE needle = hay OR n = h OR (length(n) <= 4 AND length(h) <= 12 AND (starts_with(h, n) OR starts_with(n, h)))""")
def loose_match(spark, d):
    n = _table(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("needle")).join(F.broadcast(n.select(F.col("n_name").alias("hay"))), X.loose_match(F.col("needle"), F.col("hay")))  # 25 nations
    return pairs


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, regexp_extract(url, '[^/]*$') AS key FROM pages""")
def html_escape(spark, d):
    return _table(spark, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"), X.doc_key(F.col("url")).alias("key"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_scan(spark, d):
    return _table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT user_id, string_agg(k::VARCHAR, '|' ORDER BY k) AS compact FROM (SELECT user_id, i - 1 AS k, u FROM (SELECT user_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS u FROM (SELECT user_id, list(CASE WHEN value < 20 THEN ' ' ELSE event_type END ORDER BY event_id) AS u FROM events GROUP BY user_id)) ORDER BY user_id, i) WHERE trim(u) <> '' GROUP BY user_id""")
def compact_index(spark, d):
    u = _table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("value") < 20, " ").otherwise(F.col("event_type")).alias("u")))).alias("x"))
    return u.select("user_id", A.compact_index(F.transform("x", lambda x: x["u"])).alias("compact")).where(F.size("compact") > 0).select("user_id", _listed("compact"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM documents),
o AS (SELECT doc_id, k, i, s FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM s), range(1, 5) t(k)),
x AS (SELECT CASE WHEN i + 1 < k THEN 'PAD' ELSE left(replace(trim(array_to_string(s[i + 2 - k:i + 1], ' ')), chr(10), ' '), 10000) END AS text FROM o)
SELECT DISTINCT text FROM x""")
def overlaps_k(spark, d):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return alignment.distinct_overlaps(_table(spark, d, "documents").select("doc_id", lines.alias("s")), "s", 4)


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT 'intersect:' || count(*) FROM (SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'es')")
def set_ops(spark, d):
    s = _table(spark, d, "documents").select("source", "lang")
    out = s.select("source").distinct().join(s.where("lang = 'de'"), "source", "left_anti")
    both = s.where("lang = 'fr'").select("source").intersect(s.where("lang = 'es'").select("source"))
    return out.unionByName(both.agg(F.concat(F.lit("intersect:"), F.count(F.lit(1)).cast("string")).alias("source")))


@query("SELECT 'x' AS side, false AS equal, count(*) FILTER (WHERE lang = 'de')::BIGINT AS only_left, 0::BIGINT AS only_right FROM documents".replace("'x' AS side, ", "").replace("count(*) FILTER (WHERE lang = 'de')", "(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM documents WHERE lang <> 'de'))").replace(" FROM documents", " FROM documents", 1) + " LIMIT 1")
def set_equal(spark, d):
    s = _table(spark, d, "documents")
    return documents.same_set(s, s.where("lang <> 'de'"))


# -- BLEU --------------------------------------------------------------------------------------------------------

_BLEU = _SEGMENTS + r""", t AS (SELECT doc_id, seg_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || tgt || ' ', chr(10), ' ', 'g'), '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '') AS h,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || src || ' ', chr(10), ' ', 'g'), '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '') AS r FROM s),
n AS (SELECT unnest(range(1, 5)) AS n),
hg AS (SELECT doc_id, seg_id, n, g, count(*) AS c FROM (SELECT doc_id, seg_id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM t, n WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT doc_id, seg_id, n, g, count(*) AS c FROM (SELECT doc_id, seg_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM t, n WHERE len(r) >= n) GROUP BY ALL),
m AS (SELECT n, sum(least(hg.c, coalesce(rg.c, 0)))::BIGINT AS m, sum(hg.c)::BIGINT AS t FROM hg LEFT JOIN rg USING (doc_id, seg_id, n, g) GROUP BY n)
"""


@query("WITH " + _BLEU + "SELECT (SELECT sum(len(h))::BIGINT FROM t) AS hyp_len, (SELECT sum(len(r))::BIGINT FROM t) AS ref_len, " + ", ".join(f"coalesce((SELECT m FROM m WHERE n = {i}), 0) AS match_{i}, coalesce((SELECT t FROM m WHERE n = {i}), 0) AS total_{i}" for i in range(1, 5)))
def bleu_stats(spark, d):
    pairs = segments(spark, d).select("doc_id", F.col("tgt").alias("hyp"), F.col("src").alias("ref"))
    return scores.corpus_bleu(pairs).drop("bleu")


@query("WITH " + _BLEU + """, p AS (SELECT n, m, t, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM m), q AS (SELECT exp(avg(ln(CASE WHEN m = 0 THEN 100.0 / (2 ** z * t) ELSE 100.0 * m / t END))) AS g FROM p),
l AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM t) SELECT round(CASE WHEN h >= r THEN 1.0 ELSE exp(1 - r / h) END * g, 6) AS bleu FROM q, l""")
def bleu_corpus(spark, d):
    pairs = segments(spark, d).select("doc_id", F.col("tgt").alias("hyp"), F.col("src").alias("ref"))
    return scores.corpus_bleu(pairs).select(F.round("bleu", 6).alias("bleu"))


# -- roll-ups ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey % 500 AS doc_id, CASE WHEN l_returnflag = 'R' THEN -1.0 WHEN l_linestatus = 'O' AND l_returnflag = 'N' AND l_discount < 0.03 THEN 0.0 ELSE l_discount END::DOUBLE AS comet FROM lineitem)
SELECT doc_id, round(coalesce(avg(comet) FILTER (WHERE comet >= 0), 0), 6) AS comet, count(*) FILTER (WHERE comet >= 0) AS total_seg, count(*) FILTER (WHERE comet = 0) AS misaligned_seg FROM s GROUP BY doc_id""")
def doc_rollup(spark, d):
    li = _table(spark, d, "lineitem")
    c = F.when(F.col("l_returnflag") == "R", -1.0).when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (F.col("l_discount") < 0.03), 0.0).otherwise(F.col("l_discount"))
    s = li.select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").alias("seg_id"), c.alias("comet"))
    return scores.rollup(s, ["comet"]).withColumn("comet", F.round("comet", 6))


@query("WITH " + _SEGMENTS + "SELECT doc_id, seg_id, CASE WHEN src <> '' AND tgt <> '' THEN 'score' WHEN src = '' AND tgt = '' THEN 'skip' ELSE 'worst' END AS state, CASE WHEN src <> '' AND tgt <> '' THEN 'score' ELSE 'worst' END AS simple FROM s")
def window_state(spark, d):
    s = segments(spark, d)
    return s.select("doc_id", "seg_id", scores.window_state(F.col("src"), F.col("tgt"), F.col("src")).alias("state"), scores.window_state_simple(F.col("src"), F.col("tgt")).alias("simple"))


# -- sweeps ------------------------------------------------------------------------------------------------------

_SWEEP = """a AS (SELECT l_suppkey % 20 AS doc_id, l_linenumber + 7 * (l_quantity::INTEGER % 5) AS step, CASE WHEN l_tax < 0.01 THEN 0.0 ELSE l_discount END::DOUBLE AS cost FROM lineitem),
st AS (SELECT doc_id, step::INTEGER AS step, coalesce(avg(cost) FILTER (WHERE round(cost, 6) <> 0), 0) AS avg_cost, count(*) FILTER (WHERE round(cost, 6) = 0) / count(*) AS zero_ratio FROM a GROUP BY doc_id, step)
"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 20).alias("doc_id"), (F.col("l_linenumber") + 7 * (F.rint("l_quantity").cast("int") % 5)).alias("step"), F.when(F.col("l_tax") < 0.01, 0.0).otherwise(F.col("l_discount")).alias("cost"))


@query("WITH " + _SWEEP + "SELECT doc_id, step, round(avg_cost, 9) AS avg_cost, round(zero_ratio, 9) AS zero_ratio FROM st")
def alignment_stats(spark, d):
    return sweeps.alignment_stats(_swept(spark, d)).select("doc_id", "step", F.round("avg_cost", 9).alias("avg_cost"), F.round("zero_ratio", 9).alias("zero_ratio"))


@query("WITH " + _SWEEP + """, r AS (SELECT doc_id, step, round(avg_cost, 9) AS avg_cost, round(zero_ratio, 9) AS zero_ratio FROM st), g AS (SELECT *, lag(zero_ratio) OVER w AS zb, lag(avg_cost) OVER w AS cb FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY step)),
h AS (SELECT *, max((zb IS NOT NULL AND ((zb <> 0 AND zero_ratio > 1.5 * zb) OR zero_ratio - zb > 0.15 OR avg_cost > cb OR avg_cost < 0.02 OR zero_ratio > 0.7))::INT) OVER (PARTITION BY doc_id ORDER BY step) AS ended FROM g)
SELECT doc_id, arg_min(step, avg_cost * 1000000000 + step) AS step FROM h WHERE ended = 0 GROUP BY doc_id""")
def sweep_select(spark, d):
    s = sweeps.alignment_stats(_swept(spark, d)).withColumns({c: F.round(c, 9) for c in ("avg_cost", "zero_ratio")})
    return sweeps.select_step(s, min_cost=0.02).select("doc_id", "step")


@query("WITH " + _SWEEP + """, j AS (SELECT zero_ratio - lag(zero_ratio) OVER (PARTITION BY doc_id ORDER BY step) AS jump FROM st), k AS (SELECT quantile_cont(jump, 0.2) AS a, quantile_cont(jump, 0.8) AS b FROM j WHERE jump <> 0)
SELECT round(avg(jump), 6) AS avg, round(min(jump), 6) AS min, round(max(jump), 6) AS max FROM j, k WHERE jump <> 0 AND jump BETWEEN a AND b""")
def jump_stats(spark, d):
    out = sweeps.jump_stats(sweeps.alignment_stats(_swept(spark, d)))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("WITH " + _SWEEP + ", e AS (SELECT min(avg_cost) AS lo, max(avg_cost) AS hi FROM st WHERE zero_ratio > 0 GROUP BY doc_id) SELECT round(min(lo), 6) AS min, round(max(hi), 6) AS max FROM e")
def cost_range(spark, d):
    out = sweeps.cost_range(sweeps.alignment_stats(_swept(spark, d)))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_PRF = """g AS (SELECT DISTINCT 'f' || (o_orderkey % 7) AS file, [o_orderkey % 50, o_orderkey % 50 + 1] AS s, [o_custkey % 40] AS t FROM orders WHERE o_orderstatus <> 'F'),
x AS (SELECT DISTINCT 'f' || (o_orderkey % 7) AS file, CASE WHEN o_orderkey % 5 = 0 THEN []::BIGINT[] WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 50, o_orderkey % 50 + 1] ELSE [o_orderkey % 50] END AS s, [o_custkey % 40] AS t FROM orders WHERE o_orderpriority < '4')"""


@query("WITH " + _PRF + """, p AS (SELECT file, s, t, EXISTS (SELECT 1 FROM g WHERE g.file = x.file AND g.s = x.s AND g.t = x.t) AS strict, EXISTS (SELECT 1 FROM g WHERE g.file = x.file AND list_has_any(g.s, x.s) AND list_has_any(g.t, x.t)) AS lax FROM x),
r AS (SELECT file, s, t, EXISTS (SELECT 1 FROM x WHERE len(x.s) > 0 AND g.file = x.file AND g.s = x.s AND g.t = x.t) AS strict, EXISTS (SELECT 1 FROM x WHERE len(x.s) > 0 AND g.file = x.file AND list_has_any(g.s, x.s) AND list_has_any(g.t, x.t)) AS lax FROM g),
a AS (SELECT avg(strict::INT) AS ps, avg((strict OR lax)::INT) AS pl FROM p), b AS (SELECT avg(strict::INT) AS rs, avg((strict OR lax)::INT) AS rl FROM r)
SELECT round(ps, 9) AS precision_strict, round(pl, 9) AS precision_lax, round(rs, 9) AS recall_strict, round(rl, 9) AS recall_lax, round(CASE WHEN ps + rs = 0 THEN 0 ELSE 2 * ps * rs / (ps + rs) END, 9) AS f1_strict, round(CASE WHEN pl + rl = 0 THEN 0 ELSE 2 * pl * rl / (pl + rl) END, 9) AS f1_lax FROM a, b""")
def align_prf(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("file"))
    one, two = F.array(F.col("o_orderkey") % 50), F.array(F.col("o_orderkey") % 50, F.col("o_orderkey") % 50 + 1)
    tgt = F.array(F.col("o_custkey") % 40).alias("tgt_idx")
    gold = o.where("o_orderstatus <> 'F'").select("file", two.alias("src_idx"), tgt)
    none = F.array().cast("array<bigint>")
    test = o.where("o_orderpriority < '4'").select("file", F.when(F.col("o_orderkey") % 5 == 0, none).when(F.col("o_orderkey") % 2 == 0, two).otherwise(one).alias("src_idx"), tgt)
    out = sweeps.precision_recall(gold, test)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("""SELECT t.x, t.y, count(p.x) AS n FROM (SELECT x, y FROM range(1, 8) a(x), range(1, 8) b(y) WHERE x + y <= 8) t
LEFT JOIN (SELECT l_linenumber AS x, l_quantity::INTEGER % 7 + 1 AS y FROM lineitem) p ON p.x = t.x AND p.y = t.y GROUP BY t.x, t.y""")
def alignment_types(spark, d):
    """All types of size 8, with how many pairs of a table are of each."""
    pairs = _table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("x"), (F.rint("l_quantity").cast("long") % 7 + 1).alias("y")).groupBy("x", "y").count()
    return sweeps.alignment_types(spark, 8).join(pairs, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


@query("SELECT '[' || (l_orderkey % 90) || ', ' || (l_orderkey % 90 + 1) || ']:[' || (l_linenumber) || ']:' || printf('%.6f', l_discount::DOUBLE) AS line, (l_orderkey % 90) || '|' || (l_orderkey % 90 + 1) AS src_idx, l_discount::DOUBLE AS cost FROM lineitem")
def alignment_text(spark, d):
    li = _table(spark, d, "lineitem")
    src = F.array(F.col("l_orderkey") % 90, F.col("l_orderkey") % 90 + 1)
    line = sweeps.format_alignment(src, F.array("l_linenumber"), F.col("l_discount"))
    return li.select(line.alias("line")).withColumn("a", sweeps.parse_alignment(F.col("line"))).select("line", "a.src_idx", "a.cost").withColumn("src_idx", _listed("src_idx"))


# -- perturbation ------------------------------------------------------------------------------------------------


@query("WITH " + _SEGMENTS + """, p AS (SELECT doc_id, turn, CASE WHEN turn IN (0, 2) THEN 0 ELSE turn END AS g, src, tgt FROM s),
m AS (SELECT doc_id, g, CASE WHEN count(*) > 1 THEN g || '_2' ELSE g::VARCHAR END AS seg_id, string_agg(src, ' ' ORDER BY turn) AS src, string_agg(tgt, ' ' ORDER BY turn) AS tgt FROM p GROUP BY doc_id, g),
o AS (SELECT p.doc_id, p.turn::VARCHAR AS seg_id, m.src, CASE WHEN m.seg_id LIKE '%\\_%' ESCAPE '\\' THEN m.tgt ELSE p.tgt END AS tgt FROM p JOIN m ON m.doc_id = p.doc_id AND m.g = p.g)
SELECT * FROM o""")
def perturb_merge(spark, d):
    s = segments(spark, d).select("doc_id", "seg_id", "src", "tgt")
    pairs = s.where("seg_id = '0'").join(s.where("seg_id = '2'").select("doc_id"), "doc_id").select("doc_id", F.lit(0).cast("long").alias("first"), F.lit(2).cast("long").alias("second"))
    return perturb.propagate_merges(perturb.merge_pairs(s, pairs), s)


@query("WITH " + _SEGMENTS + "SELECT doc_id, seg_id, CASE WHEN turn = 0 OR src = '' THEN '' ELSE src END AS src, CASE WHEN turn = 0 OR src = '' THEN '' ELSE tgt END AS tgt FROM s")
def perturb_drop(spark, d):
    s = segments(spark, d).select("doc_id", "seg_id", "src", "tgt")
    changed = s.withColumn("src", F.when(F.col("seg_id") == "0", "").otherwise(F.col("src")))
    return perturb.propagate_drops(changed, s)


@query("WITH " + _SEGMENTS + "SELECT a.doc_id, a.src, b.tgt FROM (SELECT doc_id, string_agg(src, ' ' ORDER BY turn) AS src FROM s GROUP BY 1) a JOIN (SELECT doc_id, string_agg(tgt, ' ' ORDER BY turn) AS tgt FROM s GROUP BY 1) b USING (doc_id)")
def recombine(spark, d):
    m = documents.merge_system(segments(spark, d), separator=" ")
    return perturb.recombine(m, m)


@query()
def sample_merges(spark, d):
    return perturb.sample_merges(segments(spark, d))


# -- vectors -----------------------------------------------------------------------------------------------------


_UNITS = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-5)) AS v FROM embeddings)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of documents: each label's vectors as sources, the next label's as targets."""
    e = _table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return e.select(F.col("label").alias("doc_id"), "vec_id", "vec"), e.select((F.col("label") - 1).alias("doc_id"), "vec_id", "vec")


@query("WITH " + _UNITS + """, m AS (SELECT a.vec_id AS x, a.label AS doc_id, 1 - avg(list_dot_product(a.v, b.v)) AS n FROM u a JOIN u b ON b.label = a.label + 1 GROUP BY ALL),
w AS (SELECT b.vec_id AS y, b.label - 1 AS doc_id, 1 - avg(list_dot_product(a.v, b.v)) AS n FROM u a JOIN u b ON b.label = a.label + 1 GROUP BY ALL)
SELECT a.label AS doc_id, a.vec_id AS x, b.vec_id AS y, round(2 * (1 - list_dot_product(a.v, b.v)) / (1e-6 + m.n + w.n), 6) AS cost FROM u a JOIN u b ON b.label = a.label + 1 JOIN m ON m.x = a.vec_id JOIN w ON w.y = b.vec_id""")
def vec_cost(spark, d):
    src, tgt = _sides(spark, d)
    left = alignment.norms_of(src, tgt).select("doc_id", F.col("vec_id").alias("x"), F.col("unit").alias("p"), F.col("norm").alias("n0"))
    right = alignment.norms_of(tgt, src).select("doc_id", F.col("vec_id").alias("y"), F.col("unit").alias("q"), F.col("norm").alias("n1"))
    # the cost matrix of each pair of documents is the result itself
    return alignment.pair_costs(left, right).withColumn("cost", F.round("cost", 6))


@query("WITH " + _UNITS + "SELECT a.label AS doc_id, a.vec_id, round(1 - avg(list_dot_product(a.v, b.v)), 6) AS norm FROM u a JOIN u b ON b.label = a.label + 1 GROUP BY a.label, a.vec_id")
def vec_norms(spark, d):
    return alignment.norms_of(*_sides(spark, d)).select("doc_id", "vec_id", F.round("norm", 6).alias("norm"))


def _doc_embedding_sql() -> str:
    bank = ", ".join(f"({i}, {s}, {w!r})" for i, row in enumerate(alignment.beta_bank()) for s, w in enumerate(row))
    return f"""WITH bank(centre, slot, w) AS (VALUES {bank}), s AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
c AS (SELECT label, round_even(i / greatest(n - 1, 1) * 99, 0)::INTEGER AS centre, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM s),
v AS (SELECT label, slot, dim, sum(w * x) AS v FROM c JOIN bank USING (centre) GROUP BY ALL), t AS (SELECT label, sqrt(sum(v * v)) + 1e-5 AS len FROM v GROUP BY label)
SELECT label::VARCHAR AS doc_id, ((slot) * 64 + dim - 1)::INTEGER AS pos, round(v / len, 6) AS x FROM v JOIN t USING (label)"""


@query(_doc_embedding_sql())
def doc_embedding(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), F.lit(1).alias("count"))
    return alignment.doc_embedding(e).select("doc_id", F.posexplode("vec").alias("pos", "x")).select("doc_id", "pos", F.round("x", 6).alias("x"))


@query()
def vec_align(spark, d):
    """Each label's vectors aligned with the next label's, at the production size of 8; longer runs are sums of neighbours."""
    e = _table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    rows = e.groupBy("label").agg(F.struct(listed.alias("vectors"), F.array().cast("array<string>").alias("unknown")).alias("v"))
    left = rows.select(F.col("label").cast("string").alias("doc_id"), "v")
    right = rows.select((F.col("label") - 1).cast("string").alias("doc_id"), "v")
    best = alignment.sweep_best(left, right, 8, max_jump=1.0, min_cost=0.0, sums=True)
    return best.select("doc_id", "step", "aln_idx", "src_idx", "tgt_idx", F.round("cost", 6).alias("cost"))


#: A cycle of 23 sources: block of each, and how many targets each of the ten blocks has. Block 5 leaves its source out, block 7 is a target alone.
_PLANTED_BLOCK = [0, 1, 1, 2, 3, 3, 3, 4, 5, 6, 6, 6, 6, 6, 8, 8, 9, 9, 9, 9, 9, 9, 9]
_PLANTED_TARGETS = [1, 1, 2, 1, 1, 0, 1, 1, 2, 1]


def planted_pairs(spark, d):
    """Documents of 500 vectors as sources, and targets made of them: in turn alone, two, three, five and seven joined, one and two cut in two, one left out and one put in.
    Vectors of the table may be near one another, so each unit vector gets a place of its own among its neighbours: one of 32 more dimensions, twice as long as
    itself, and what is put in one of 32 others. No two neighbours' similarity is above a fifth then, and the best alignment is the one that was planted."""
    at = F.col("vec_id") % 500
    place = lambda i: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(j == i, 2.0).otherwise(0.0))
    near = (at % 32).cast("int")
    e = _table(spark, d, "embeddings").select("vec_id", A.unit(F.col("embedding")).alias("u"))
    e = e.select("vec_id", F.concat("u", place(near)).alias("v"), F.concat(F.reverse("u"), place(near + 32)).alias("r"))
    block = F.get(F.lit(_PLANTED_BLOCK), (at % 23).cast("int"))
    e = e.select((F.col("vec_id") - at).alias("doc"), at.alias("i"), F.floor(at / 23).alias("c"), block.alias("b"), "v", "r")
    scaled = lambda v, w: F.transform(v, lambda x: x * w)
    plus = lambda v, w: F.zip_with(v, w, lambda x, y: x + y)
    blocks = e.groupBy("doc", "c", "b").agg(F.array_sort(F.collect_list(F.struct("i", "v", "r"))).alias("x"))
    total = F.aggregate(F.slice("x", 2, 8), F.col("x")[0]["v"], lambda a, r: plus(a, r["v"]))
    blocks = blocks.select("doc", "c", "b", total.alias("s"), F.col("x")[0]["r"].alias("r"))
    n = F.get(F.lit(_PLANTED_TARGETS), "b")
    half = scaled(F.col("s"), 0.5)
    made = F.when(n == 1, F.array("s")).when(n == 2, F.array(plus(half, scaled(F.col("r"), 0.8)), plus(half, scaled(F.col("r"), -0.8))))
    put_in = blocks.where("b = 8").select("doc", "c", F.lit(7).alias("b"), F.array("r").alias("t"))
    targets = blocks.where(n > 0).select("doc", "c", "b", made.alias("t")).unionByName(put_in)
    vectors = lambda v: F.struct(F.transform(v, lambda x: x.cast("array<float>")).alias("vectors"), F.array().cast("array<string>").alias("unknown")).alias("v")
    doc = (F.col("doc") / 500).cast("long").cast("string").alias("doc_id")
    left = e.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("doc_id", vectors(F.transform("x", lambda r: r["v"])))
    right = targets.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("c", "b", "t"))).alias("x")).select("doc_id", vectors(F.flatten(F.transform("x", lambda r: r["t"]))))
    return left, right


@query(f"""WITH b AS (SELECT vec_id // 500 AS d, vec_id % 500 AS i, vec_id % 500 // 23 AS c, {_PLANTED_BLOCK}[vec_id % 500 % 23 + 1] AS b FROM embeddings),
s AS (SELECT d, c, b, list(i ORDER BY i) AS src, {_PLANTED_TARGETS}[b + 1] AS n FROM b GROUP BY d, c, b UNION ALL SELECT DISTINCT d, c, 7, [], 1 FROM b WHERE b = 8),
o AS (SELECT *, row_number() OVER w - 1 AS aln_idx, (sum(n) OVER w)::BIGINT - n AS y FROM s WINDOW w AS (PARTITION BY d ORDER BY c, b))
SELECT d::VARCHAR AS doc_id, aln_idx::INTEGER AS aln_idx, array_to_string(src, ',') AS src, array_to_string(range(y, y + n), ',') AS tgt, 0.0::DOUBLE AS cost FROM o""")
def vec_align_planted(spark, d):
    """Sources against targets made of them, coarse to fine, at size 8: merges up to seven to one, splits, a sentence left out and one put in, each at its place."""
    out = alignment.sweep(*planted_pairs(spark, d), 8, [0.01], sums=True)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("doc_id", "aln_idx", listed("src_idx").alias("src"), listed("tgt_idx").alias("tgt"), (F.round("cost", 2) + 0.0).alias("cost"))


@query()
def resegment_docs(spark, d):
    """Documents' lines as segments, their words as timed units: the exact matchers with their cursors."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    lines = documents.sentence_offsets(docs).withColumn("row_idx", F.col("line_no").cast("long"))
    segs = lines.select("doc_id", F.lit(None).cast("string").alias("sys_id"), F.col("sentence").alias("src"), F.col("sentence").alias("ref"), F.col("sentence").alias("tgt"), F.col("line_no").cast("string").alias("seg_id"), F.array((F.col("line_no") + 1).cast("int")).alias("src_ref_ids"), F.array().cast("array<int>").alias("mt_indices"), F.when(F.col("line_no") % 2 == 0, F.col("char_start")).otherwise(-1).cast("int").alias("mt_char_start"), F.col("char_end").cast("int").alias("mt_char_end"), F.col("line_no").alias("arrival"))
    sents = lines.select("doc_id", "row_idx", (F.col("char_start") * 10.0).alias("start_ms"), (F.col("char_end") * 10.0).alias("end_ms"), F.col("sentence").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    inst = docs.select("doc_id", F.transform(words, lambda w, i: (i + 1) * F.lit(100.0)).alias("delays"), F.array().cast("array<double>").alias("elapsed"), words.alias("prediction_units"), F.transform(A.locate_units(F.col("text"), words), lambda s: F.array(s["char_start"], s["char_end"])).alias("spans"), (F.length("text") * 10.0).alias("source_length_ms"))
    out = resegment.resegment(segs, sents, inst)
    return out.select("doc_id", "seg_id", "_match_method", "_raw_u_start", "_raw_u_end", F.size("delays").alias("n"), F.round(A.yaal(F.col("delays"), F.col("source_length"), F.col("recording_end")), 3).alias("yaal"))


def _label_pairs(spark, d):
    """Each label's vectors as a source and the next label's as its reference."""
    e = _table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    rows = e.groupBy("label").agg(F.struct(listed.alias("vectors"), F.array().cast("array<string>").alias("unknown")).alias("v"))
    return rows.select(F.col("label").cast("string").alias("doc_id"), "v"), rows.select((F.col("label") - 1).cast("string").alias("doc_id"), "v")


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT a.label::VARCHAR AS doc_id, a.n AS n_src, b.n AS n_tgt, true AS in_order, true AS whole_or_paired FROM n a JOIN n b ON b.label = a.label + 1""")
def reference_alignment(spark, d):
    """What every alignment of a reference is: each sentence of both sides once and in order, and, if it isn't the whole N:M row, none left out."""
    rows, _ = alignment.reference_alignments(*_label_pairs(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("aln_idx", "src_idx", "tgt_idx", "step")))
    side = lambda c: F.flatten(F.transform("x", lambda r: r[c]))
    g = rows.groupBy("doc_id").agg(ordered.alias("x"))
    straight = lambda c: side(c) == F.sequence(F.lit(0), F.size(side(c)) - 1)
    paired = F.forall("x", lambda r: (F.size(r["src_idx"]) > 0) & (F.size(r["tgt_idx"]) > 0))
    return g.select("doc_id", F.size(side("src_idx")).cast("long").alias("n_src"), F.size(side("tgt_idx")).cast("long").alias("n_tgt"), (straight("src_idx") & straight("tgt_idx")).alias("in_order"), paired.alias("whole_or_paired"))


@query("""WITH a AS (SELECT l_suppkey % 20 AS doc_id, l_linenumber + 7 * (l_quantity::INTEGER % 5) AS step, CASE WHEN l_suppkey % 20 % 3 = 1 OR l_linenumber = 1 AND l_tax < 0.01 THEN 0.0 ELSE l_discount + 0.01 END::DOUBLE AS cost FROM lineitem),
z AS (SELECT doc_id, step::INTEGER AS step, round(avg(cost), 9) AS avg_cost FROM a GROUP BY doc_id, step HAVING count(*) FILTER (WHERE round(cost, 6) = 0) = 0)
SELECT doc_id, step, avg_cost FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY avg_cost, step) = 1""")
def sweep_zero_free(spark, d):
    """Documents with steps that leave nothing out, with some that do, and with none without."""
    li, doc = _table(spark, d, "lineitem"), F.col("l_suppkey") % 20
    left_out = (doc % 3 == 1) | ((F.col("l_linenumber") == 1) & (F.col("l_tax") < 0.01))
    swept = li.select(doc.alias("doc_id"), (F.col("l_linenumber") + 7 * (F.rint("l_quantity").cast("int") % 5)).alias("step"), F.when(left_out, 0.0).otherwise(F.col("l_discount") + 0.01).cast("double").alias("cost"))
    return sweeps.best_without_zeros(sweeps.alignment_stats(swept).withColumn("avg_cost", F.round("avg_cost", 9))).select("doc_id", "step", "avg_cost")


def lines_to_resegment(spark, d):
    """Documents' lines as segments over their words as timed units, cut in every way that the cascade knows: as they are, with a foreign word before,
    without spaces, by characters, with segments put in that have no source or no match. Units of every second document end in commas. A segment's place is
    therefore known beforehand: it begins where the line before it ended."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 2 == 1).alias("commas"), "text")
    words = F.regexp_extract_all(F.col("line"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    lines = docs.select("doc_id", "commas", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")).select("doc_id", "commas", "line_no", words.alias("w")).where(F.size("w") > 0)
    before = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.withColumn("k", F.row_number().over(before) - 1).withColumn("u0", F.sum(F.size("w")).over(before) - F.size("w"))
    unit = lambda w: F.concat(w, F.when(F.col("commas"), ",").otherwise(""))
    told = F.array_join(F.transform("w", unit), " ")
    lines = lines.withColumn("c0", F.coalesce(F.sum(F.length(told) + 1).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = materialised(lines, "lines").withColumn("told", told)  # four tables are made of them
    joined = F.array_join("w", "")
    plain = F.array_join("w", " ")
    kind = F.col("k") % 6
    tgt = F.when(kind == 1, F.concat(F.lit("zzzzzz "), plain)).when((kind == 2) & (F.size("w") > 1) & (F.length(joined) >= 40), joined).when(kind == 3, F.lit("qqqqqq")).otherwise(plain)
    at = F.when(kind == 3, F.col("c0")).otherwise(-1).cast("int")
    segs = lines.select("doc_id", F.lit(None).cast("string").alias("sys_id"), plain.alias("src"), plain.alias("ref"), tgt.alias("tgt"), (F.col("k") * 2 + 1).alias("arrival"), F.array((F.col("k") + 1).cast("int")).alias("src_ref_ids"), at.alias("mt_char_start"), (at + F.length("told")).cast("int").alias("mt_char_end"))
    put_in = lines.where(kind >= 4).select("doc_id", F.lit(None).cast("string").alias("sys_id"), F.when(kind == 4, "").otherwise(plain).alias("src"), plain.alias("ref"), F.lit("qqqqqq xxxxxx").alias("tgt"), (F.col("k") * 2).alias("arrival"), F.array((F.col("k") + 1).cast("int")).alias("src_ref_ids"), F.lit(-1).alias("mt_char_start"), F.lit(-1).alias("mt_char_end"))
    segs = segs.unionByName(put_in).withColumns({"seg_id": F.col("arrival").cast("string"), "mt_indices": F.array().cast("array<int>")})
    sents = lines.select("doc_id", F.col("k").cast("long").alias("row_idx"), (F.col("k") * 1000.0).alias("start_ms"), ((F.col("k") + 1) * 1000.0).alias("end_ms"), plain.alias("text"))
    inst = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.transform("w", unit).alias("u")))).alias("x")).select("doc_id", F.flatten(F.transform("x", lambda x: x["u"])).alias("prediction_units"), (F.size("x") * 1000.0).alias("source_length_ms"))
    inst = inst.withColumn("spans", F.transform(A.locate_units(F.array_join("prediction_units", " "), F.col("prediction_units")), lambda s: F.array(s["char_start"], s["char_end"])))
    inst = inst.withColumns({"delays": F.transform("prediction_units", lambda u, i: (i + 1) * F.lit(100.0)), "elapsed": F.array().cast("array<double>")})
    return segs, sents, inst


@query("""WITH l AS (SELECT doc_id, doc_id % 2 = 1 AS commas, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k, w
        FROM (SELECT doc_id, unnest(range(len(x))) AS line_no, regexp_extract_all(unnest(x), '[A-Za-z0-9]+') AS w FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS x FROM documents)) WHERE len(w) > 0),
    p AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS u0, len(w) > 1 AND len(array_to_string(w, '')) >= 40 AS long FROM l),
    s AS (SELECT doc_id, k * 2 + 1 AS a, k, CASE WHEN k % 6 = 1 THEN 'skip_latin_1' WHEN k % 6 = 2 AND long THEN 'char_exact' WHEN k % 6 = 3 THEN 'char_span' WHEN commas THEN 'loose' ELSE 'strict' END AS method, u0, u0 + len(w) AS u1, len(w) AS n FROM p
        UNION ALL SELECT doc_id, k * 2, k, CASE WHEN k % 6 = 4 THEN 'null_over_translation' ELSE 'quality_only_not_found' END, CASE WHEN k % 6 = 4 THEN -1 ELSE u0 END, CASE WHEN k % 6 = 4 THEN -1 ELSE u0 END, 0 FROM p WHERE k % 6 >= 4)
    SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS position, method, u0 AS u_start, u1 AS u_end, n::INT AS n, coalesce(list_sum(list_transform(range(u0 + 1, u0 + n + 1), lambda i: greatest(0, i * 100.0 - k * 1000.0))), 0.0)::DOUBLE AS delay FROM s""")
def resegment_parts(spark, d):
    """The fold in parts of 32 segments: methods, places and times of every segment."""
    out = resegment.resegment(*lines_to_resegment(spark, d), part=32)
    return out.select("doc_id", "position", F.col("_match_method").alias("method"), F.coalesce("_compact_u_start", F.lit(-1)).alias("u_start"), F.coalesce("_compact_u_end", F.lit(-1)).alias("u_end"), F.size("delays").alias("n"), F.aggregate("delays", F.lit(0.0), lambda a, x: a + x).alias("delay"))


from strandline.plans import splitting, storage  # noqa: E402  storage registers its queries here

QUERIES |= splitting.QUERIES
ORACLE_SQL |= splitting.ORACLE_SQL
