"""Line dedup by winnowing, with DataFrame functions only.

A line counts if it holds a word. A window is the shortest run of counted lines from a line on that holds ``words`` words, so
a long line is a window of its own and short ones share one. Of every window the rightmost line of the smallest hash is
the fingerprint: windows that are equal choose alike, so every repeat of so many words has a fingerprint at the same
place of both copies. Only fingerprints are emitted, with the hashes of the few lines that a window around them may hold.

Places are joined on fingerprints that occur more than once, each with the first one; from there the match is extended both ways, line
by line, and goes if it holds ``words`` words. Where the match with the first place doesn't fill all the windows of a
fingerprint, those left over are joined among each other by their own hash, so a run goes whichever earlier place it repeats.
Overlapping matches make up the maximal repeat.

No places of a fingerprint are paired with each other, only with the first one. Counting is by partial aggregation; what is
joined with is written first, so both sides of a join are plain shuffles that Spark may split where one fingerprint is hot.

What goes, in short: each counted line in a run of counted lines that holds ``words`` words and also starts earlier, in a
document with a smaller id or further up in the same one.

Defined results: a null text counts as empty; blank lines always stay; lines too short for a run of their own go only with their
neighbours; a line stays at its first place, so no line is lost altogether; rows that repeat a doc_id are told apart by a hash
of their text, and equal rows (same id, same text) are one document, so both keep the same lines; a null doc_id comes last; other
columns stay as they are, whatever their names. A text of which nothing goes is returned unchanged. Lines are compared by 128 bits
of hash where they are fingerprints, by 64 where they are their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD, free_name, written

#: Runs of at least so many words. Labels, greetings and headings mostly hold fewer.
WORDS = 5


def _let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _count(sizes: Column, words: int) -> Column:
    """How many of the first lines hold ``words`` words together; 0 if all don't."""
    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    more = lambda acc, x: F.when(acc["sum"] >= words, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + 1).alias("n")))
    return F.aggregate(sizes, none, more, lambda acc: F.when(acc["sum"] >= words, acc["n"]).otherwise(0))


def fingerprints(lines: Column, sizes: Column, words: int) -> Column:
    """For the hashes of a document's counted lines and their numbers of words: the place (from 1) of each window's fingerprint
    and the window's number of lines, for each line that begins one."""
    window = lambda i: _count(F.slice(sizes, i, F.lit(words)), words)
    least = lambda i, k: -F.array_min(F.transform(F.slice(lines, i, k), lambda h, o: F.struct(h.alias("h"), (-(i + o)).alias("at"))))["at"]
    begun = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.struct(i.alias("from"), window(i).alias("k")))
    chosen = F.transform(F.filter(begun, lambda w: w["k"] > 0), lambda w: F.struct(w["from"].alias("from"), w["k"].alias("k"), F.when(w["k"] == 1, w["from"]).otherwise(least(w["from"], w["k"])).alias("at")))
    return F.when(F.size(lines) > 0, chosen).otherwise(F.array().cast("array<struct<from:int,k:int,at:int>>"))


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of the documents, the text without its later repeated runs, and ``n_lines``, ``n_removed`` (of counted lines)."""
    key, gone_name = free_name(docs, "_key"), free_name(docs, "_gone")
    counted = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    # an id of a row that later scans find again: of its id, source text and nothing that depends on the order of rows
    key_of = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    hashed = F.transform(F.filter(split, counted), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(words), x).alias("g"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("w")))
    reach = words - 1  # a window of so many words has as many lines at most

    def places(d):
        """A row a fingerprint: its hash, its place, and the lines around it, the nearest first."""
        left = lambda x, at: F.reverse(F.slice(x, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach))))
        right = lambda x, at: F.slice(x, at + 1, F.lit(reach))
        at = F.array_distinct(F.transform(fingerprints(d["h"], d["w"], words), lambda f: f["at"]))
        return F.transform(at, lambda p: F.struct(
            F.element_at(d["h"], p).alias("h"), F.element_at(d["g"], p).alias("g"), p.alias("at"), F.element_at(d["w"], p).alias("w"),
            left(d["h"], p).alias("left"), right(d["h"], p).alias("right"), left(d["w"], p).alias("left_w"), right(d["w"], p).alias("right_w"),
        ))

    apart = lambda x: F.struct(*(x[c].alias(c) for c in ("h", "g", "w")))
    rows = docs.select(key_of.alias("key"), F.explode(_let(hashed, lambda x: _let(apart(x), places))).alias("p")).select("key", "p.*")
    rows = written(rows, "line-fingerprints")
    # 1. positions joined on fingerprints that occur more than once: the first place of each, with the lines around it
    firsts = rows.groupBy("h", "g").agg(F.min(F.struct("key", "at", "left", "right")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    firsts = written(firsts, "line-firsts")
    met = rows.join(firsts, ["h", "g"])
    # 2. extended both ways
    met = met.withColumn("first_itself", F.struct("key", "at") == F.struct("first.key", "first.at")).withColumn("l", _alike(F.col("left"), F.col("first.left"))).withColumn("r", _alike(F.col("right"), F.col("first.right")))
    held = F.col("w") + _sum(F.slice("left_w", F.lit(1), F.col("l"))) + _sum(F.slice("right_w", F.lit(1), F.col("r")))
    met = met.where(~F.col("first_itself")).withColumn("held", held)
    # windows of the fingerprint beyond the match: from each line on, and up to each line, as far as the words reach
    around, around_w = F.concat(F.reverse("left"), F.array("h"), "right"), F.concat(F.reverse("left_w"), F.array("w"), "right_w")
    mid = F.size("left") + 1

    def beyond(v):
        n = F.size(v["x"])
        ahead = F.transform(F.sequence(F.lit(1), v["mid"]), lambda i: F.struct(i.alias("a"), (i + _count(F.slice(v["w"], i, F.lit(words)), words) - 1).alias("b")))
        size_up_to = lambda j: _count(F.reverse(F.slice(v["w"], F.greatest(j - reach, F.lit(1)), F.least(j, F.lit(words)))), words)
        back = F.transform(F.sequence(v["mid"], n), lambda j: F.struct((j - size_up_to(j) + 1).alias("a"), j.alias("b")))
        inside = lambda s: (s["a"] >= v["mid"] - v["l"]) & (s["b"] <= v["mid"] + v["r"])
        holds = lambda s: (s["a"] <= v["mid"]) & (s["b"] >= v["mid"]) & (s["b"] >= s["a"])
        whole = lambda s: _sum(F.slice(v["w"], s["a"], s["b"] - s["a"] + 1)) >= words
        return F.filter(F.array_distinct(F.concat(ahead, back)), lambda s: holds(s) & ~inside(s) & whole(s))

    given = F.struct(around.alias("x"), around_w.alias("w"), mid.alias("mid"), F.col("l").alias("l"), F.col("r").alias("r"))
    cut = lambda v, s: F.slice(v["x"], s["a"], s["b"] - s["a"] + 1)
    rest = _let(given, lambda v: F.transform(beyond(v), lambda s: F.struct(F.xxhash64(cut(v, s)).alias("h"), F.xxhash64(F.lit(words), cut(v, s)).alias("g"), (F.col("at") - v["mid"] + s["a"]).alias("a"), (F.col("at") - v["mid"] + s["b"]).alias("b"))))
    met = written(met.select("key", (F.col("at") - F.col("l")).alias("a"), (F.col("at") + F.col("r")).alias("b"), (F.col("held") >= words).alias("long"), rest.alias("rest")), "line-matches")
    matched = met.where("long").select("key", "a", "b")
    # 3. what the first place doesn't have, but another earlier one may
    left_over = met.where(F.size("rest") > 0).select("key", F.explode("rest").alias("s")).select("key", "s.*").distinct()
    again = left_over.groupBy("h", "g").agg(F.min(F.struct("key", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    more = left_over.join(written(again, "line-again"), ["h", "g"]).where(F.struct("key", "a") > F.col("first")).select("key", "a", "b")
    # 4. overlapping matches make the maximal repeats of a document
    gone = matched.unionByName(more).distinct().groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b")))).alias(gone_name))
    whole = docs.withColumn(key, key_of).join(gone.withColumnRenamed("key", key), key, "left")

    def stays(raw):
        numbers = F.sequence(F.lit(1), F.size(raw))
        places_of = F.filter(numbers, lambda i: counted(F.element_at(raw, i)))
        return _let(places_of, lambda p: F.array_join(F.transform(F.array_except(numbers, F.transform(F.col(gone_name), lambda z: F.element_at(p, z))), lambda i: F.element_at(raw, i)), "\n"))

    text = F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(_let(split, stays))
    n_lines = F.size(F.filter(split, counted)).cast("long")
    return whole.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), n_lines.alias(free_name(docs, "n_lines")), F.coalesce(F.size(gone_name), F.lit(0)).cast("long").alias(free_name(docs, "n_removed")))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
e AS (SELECT doc_id, raw, list_filter(range(1, len(raw) + 1), lambda i: regexp_matches(raw[i], '[^\x20\x09-\x0D]')) AS pos FROM d),
l AS (SELECT doc_id, list_transform(pos, lambda p: raw[p]) AS lines, list_transform(pos, lambda p: len(regexp_extract_all(raw[p], '[^\x20\x09-\x0D]+'))) AS words FROM e),
x AS (SELECT doc_id, lines, words, unnest(range(1, len(lines) + 1)) AS i FROM l),
w AS (SELECT doc_id, lines, i AS a, i + list_filter(range(0, 5), lambda k: list_sum(words[i:i + k]) >= 5)[1] AS b FROM x
  UNION SELECT doc_id, lines, i - list_filter(range(0, least(5, i)), lambda k: list_sum(words[i - k:i]) >= 5)[1], i FROM x),
g AS (SELECT doc_id, a, b, lines[a:b] AS s FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT s, min((doc_id, a)) AS f FROM g GROUP BY s),
h AS (SELECT DISTINCT g.doc_id, unnest(range(g.a, g.b + 1)) AS p FROM g JOIN m USING (s) WHERE (g.doc_id, g.a) > m.f),
c AS (SELECT doc_id, list(p) AS gone FROM h GROUP BY doc_id)
SELECT e.doc_id, len(pos)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN raw ELSE list_transform(list_filter(range(1, len(raw) + 1), lambda q: NOT list_contains(list_transform(gone, lambda z: pos[z]), q)), lambda q: raw[q]) END, chr(10)), '')) AS kept_sha256
FROM e LEFT JOIN c USING (doc_id)
"""
