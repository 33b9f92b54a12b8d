"""A corpus pipeline of five stages: quality rules, line dedup, n-gram Jaccard join, mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. run()
writes each stage's table as Parquet and reads it again as the next one's documents. Any stage takes nulls, empty
tables and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import round_trip
from strandline.llm.common import free_name, written
from strandline.llm.jaccard_join import jaccard_join
from strandline.llm.line_dedup import line_dedup
from strandline.llm.mixing import mix_sources
from strandline.llm.quality_rules import learn_rules, quality_rules


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the length of the text as it is now."""
    return changed.select(*((F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules(docs, rules)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; a document of which all lines went goes too."""
    out = line_dedup(docs)
    n, gone = out.columns[-2:]
    return _with_text(docs, out.where((F.col(gone) == 0) | (F.col(gone) < F.col(n))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one with the smallest id, of these the one with the smallest hash of its text;
    documents without words are linked to none. Of equal rows (same id, same text) one stays."""
    i, h, stays = free_name(docs, "_id"), free_name(docs, "_h"), written(jaccard_join(docs), "classes")
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("text_hash").alias("h"))
    of_groups = stays.where("class_node IS NOT NULL").groupBy("class_node").agg(F.min(key).alias("k")).select("k.*")
    kept = of_groups.unionByName(stays.where("class_node IS NULL").select(key.alias("k")).select("k.*")).distinct().toDF(i, h)
    known = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    return known.join(kept, [i, h], "left_semi").dropDuplicates([i, h]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    i, h, nth, n, copy = (free_name(docs, x) for x in ("_id", "_h", "_nth", "_copies", "_copy"))
    null = F.lit(2**63 - 1)
    copies = mix_sources(docs).where("copies > 0").select(F.coalesce("doc_id", null).alias(i), F.coalesce("text_hash", null).alias(h), F.col("nth").alias(nth), F.col("copies").alias(n))
    keyed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), null)).withColumn(h, F.coalesce(F.xxhash64("text"), null)).withColumn(nth, F.row_number().over(Window.partitionBy(i, h).orderBy(F.col("source").cast("string").asc_nulls_last())))
    return keyed.join(copies, [i, h, nth]).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids' bytes are the text's."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    known = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    out = round_trip(known, path, pattern, ["doc_id", "source", "_sha"])
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("decodes"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: The rules are learnt, the paths chosen and the copies drawn by hashes that SQL here lacks: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
