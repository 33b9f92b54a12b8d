"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document of a source should be taken target / source size times. The whole part of that is taken of every
document; the fraction is rounded by the pivotal method: two documents with fractions f and g and sizes a and b pass
words to each other, at random and without bias, so that a f + b g stays and one of them becomes 0 or 1. What stays
undecided goes on to the next one. Documents meet in chunks of bounded size, the longest first so that a short one is left; each chunk leaves one undecided
document, and these meet in chunks again: a reduction tree, whose height is the logarithm of the number of documents.
The last one of a source is drawn by its fraction. The words by which that draw misses, too many as likely as too few, are handed on
to documents of the last chunk that were decided the other way, in random order, as long as they fit; so a source
comes near its target though its last document may be a long one, and no document is favoured but by its size.

Random numbers are hashes of doc_id, size and seed: reruns agree, however the rows are dealt.

Defined results: a null text has size 0; documents of size 0 get the whole part only; a null source is a source of its
own, the last; a null doc_id and rows that repeat one take part as rows of their own, equal rows told apart by number; a source of
size 0 has target 0; other columns, whatever their names, aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, written

WEIGHTS, CAP, CHUNK, SEED = (1, 2, 3), 3, 256, 42


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """For each source (``source``, ``source_size``): its target. One row a source is gathered, never documents.

    A source's target is the smaller of cap times its size and its weight times one level, the same for all, at which
    the targets add up to all words. That is where resharing the excess by weight ends."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("double"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * cap
    rest = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") - capped) / rest
    # the first source, by size a weight, whose own cap is above its level sets the level for all after it
    t = t.withColumn("_level", level).withColumn("_open", F.when(F.col("_level") * F.col("w") <= F.col("source_size") * cap, F.col("_level")))
    t = t.withColumn("_level", F.max("_open").over(everything))
    return t.select("source", "source_size", F.least(F.col("source_size").cast("double") * cap, F.coalesce(F.col("_level") * F.col("w"), F.col("source_size").cast("double") * cap)).alias("target"))


def _unit(*parts) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _reduce(items: DataFrame, seed: int) -> DataFrame:
    """One level: for each chunk the decisions of all its documents but one, and that one with its fraction."""
    x = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "h", "row", "size", "f")))
    start = F.struct(F.element_at("_x", 1).alias("open"), F.array().cast("array<struct<row:struct<id:bigint,text:bigint,nth:int>,size:double,up:int>>").alias("done"))

    def meet(acc, b):
        a = acc["open"]
        mass_a, mass_b = a["size"] * a["f"], b["size"] * b["f"]
        total = mass_a + mass_b
        # words that a can hand to b, and b to a
        give = F.least(mass_a, b["size"] - mass_b)
        take = F.least(a["size"] - mass_a, mass_b)
        to_b = _unit(a["row"]["id"], a["row"]["text"], a["row"]["nth"], b["row"]["id"], b["row"]["text"], b["row"]["nth"], F.lit(seed)) * (give + take) < take
        # after the transfer exactly one of the two is 0 or full, told by which bound was met and not by rounded numbers
        a_done = F.when(to_b, mass_a <= b["size"] - mass_b).otherwise(a["size"] - mass_a <= mass_b)
        done = F.when(a_done, F.struct(a["row"].alias("row"), a["size"].alias("size"), F.when(to_b, 0).otherwise(1).alias("up"))).otherwise(F.struct(b["row"].alias("row"), b["size"].alias("size"), F.when(to_b, 1).otherwise(0).alias("up")))
        left = F.when(a_done, total - F.when(to_b, F.lit(0.0)).otherwise(a["size"].cast("double"))).otherwise(total - F.when(to_b, b["size"].cast("double")).otherwise(F.lit(0.0)))
        who = lambda field: F.when(a_done, b[field]).otherwise(a[field])
        f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), left / who("size")))
        return F.struct(F.struct(who("order").alias("order"), who("h").alias("h"), who("row").alias("row"), who("size").alias("size"), f.alias("f")).alias("open"), F.concat(acc["done"], F.array(done)).alias("done"))

    folded = F.aggregate(F.slice("_x", 2, F.size("_x")), start, meet)
    return items.groupBy("source", "chunk", "chunks").agg(x.alias("_x")).select("source", "chunk", "chunks", folded.alias("r"))


def _drawn(r, seed: int):
    """The draw of a chunk's open document, by its fraction."""
    return (_unit(r["open"]["row"]["id"], r["open"]["row"]["text"], r["open"]["row"]["nth"], F.lit(seed + 2)) < r["open"]["f"]).cast("int")


def _settled(r, seed: int):
    """The decisions of a source's last chunk after its open document is drawn: the words by which the draw misses are handed on to
    others of the chunk, in random order, each turned over if it is no larger than what is left to hand on."""
    up = _drawn(r, seed)
    missed = r["open"]["size"] * (up - r["open"]["f"])  # too many, if positive
    fits = F.filter(r["done"], lambda d: (d["up"] == F.when(missed > 0, 1).otherwise(0)) & (d["size"] <= F.abs(missed)))
    order = F.array_sort(F.transform(fits, lambda d: F.struct(F.xxhash64(d["row"]["id"], d["row"]["text"], d["row"]["nth"], F.lit(seed + 3)).alias("h"), d["row"].alias("row"), d["size"].alias("size"))))
    none = F.struct(F.abs(missed).alias("left"), F.array().cast("array<struct<id:bigint,text:bigint,nth:int>>").alias("turned"))
    take = lambda acc, d: F.when(d["size"] <= acc["left"], F.struct((acc["left"] - d["size"]).alias("left"), F.concat(acc["turned"], F.array(d["row"])).alias("turned"))).otherwise(acc)
    turned = F.aggregate(order, none, take, lambda acc: acc["turned"])
    put = lambda t: F.transform(r["done"], lambda d: F.struct(d["row"].alias("row"), F.when(F.array_contains(t, d["row"]), 1 - d["up"]).otherwise(d["up"]).alias("up")))
    return F.element_at(F.transform(F.array(turned), put), 1)


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and ``copies`` (taken = copies x size) for each document."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    row = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    base = docs.select(row.alias("row0"), F.col("source").cast("string").alias("source"), size.alias("size"))
    # equal rows are told apart by number; groups of these are as large as one id repeats
    base = base.withColumn("nth", F.row_number().over(Window.partitionBy("row0").orderBy(F.col("source").asc_nulls_last()))).select(F.struct("row0.id", "row0.text", "nth").alias("row"), "source", "size")
    base = written(base, "mix-sizes")  # texts are scanned once
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # sources are few, but their number isn't bounded: the join is left to Spark's own check of sizes
    goal = targets(per.select("source", "source_size"), weights, cap).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate + 1e-12)).withColumn("f", F.greatest(F.lit(0.0), rate - F.col("whole")))
    joined = base.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    h = F.xxhash64("row.id", "row.text", "row.nth", F.lit(seed))
    chunks = F.ceil(F.col("n") / chunk)
    level = joined.where("size > 0 AND f > 0").select("source", h.alias("h"), "row", F.col("size").cast("double").alias("size"), "f", F.pmod(F.xxhash64("row.id", "row.text", "row.nth", F.lit(seed + 1)), chunks).alias("chunk"), chunks.alias("chunks"))
    largest = per.agg(F.max("n").alias("n")).first()["n"] or 0
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(largest / chunk)), chunk / 2))) if largest else 0
    decided = None
    for i in range(levels):
        last = i == levels - 1
        if last:
            level = level.withColumn("chunk", F.lit(0).cast("long"))
        r = _reduce(level, seed)
        done = r.select(F.explode(_settled(F.col("r"), seed) if last else F.col("r.done")).alias("d")).select("d.row", "d.up")
        decided = done if decided is None else decided.unionByName(done)
        opened = r.select("source", "chunk", "chunks", "r.open.*", _drawn(F.col("r"), seed).alias("drawn"))
        if last:
            decided = decided.unionByName(opened.select("row", F.col("drawn").alias("up")))
        else:
            up = F.ceil(F.col("chunks") / (chunk // 2))
            level = opened.select("source", "h", "row", "size", "f", F.floor(F.col("chunk") / (chunk // 2)).alias("chunk"), up.alias("chunks"))
    if decided is None:
        decided = joined.select("row", F.lit(0).alias("up")).limit(0)
    out = joined.join(decided, "row", "left").withColumn("copies", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long"))
    return out.select(F.col("row.id").alias("doc_id"), F.col("row.text").alias("text_hash"), F.col("row.nth").alias("nth"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op7_mixing_targets(spark, sf_dir: str) -> DataFrame:
    """What of op7_mixing doesn't depend on the draw, and how near each source comes: the words by which it misses, in units of its longest
    document (0: less than one)."""
    out = op7_mixing(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    near = out.groupBy("source", "source_size", "target").agg(F.count(F.lit(1)).alias("documents"), F.sum("taken").alias("taken"), F.max("size").alias("longest"), F.sum((F.col("taken") > 3 * F.col("size")).cast("long")).alias("beyond"))
    return near.select("source", "source_size", F.round("target", 3).alias("target"), "documents", "beyond", F.floor(F.abs(F.col("taken") - F.col("target")) / F.col("longest")).cast("long").alias("missed"))


OP7_TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT source, count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS s FROM documents GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d),
r AS (SELECT source, s, w, documents, NULL::DOUBLE AS target, 0 AS round FROM w
  UNION ALL SELECT source, s, w, documents, CASE WHEN target IS NULL AND lv * w > 3 * s THEN 3.0 * s ELSE target END, round + 1
  FROM (SELECT *, ((SELECT sum(s) FROM w) - coalesce(sum(target) OVER (), 0)) / sum(CASE WHEN target IS NULL THEN w END) OVER () AS lv FROM r WHERE round < 25)),
e AS (SELECT *, ((SELECT sum(s) FROM w) - coalesce(sum(target) OVER (), 0)) / sum(CASE WHEN target IS NULL THEN w END) OVER () AS lv FROM r WHERE round = 25)
SELECT source, s AS source_size, round(coalesce(target, lv * w), 3) AS target, documents, 0::BIGINT AS beyond, 0::BIGINT AS missed FROM e
"""
