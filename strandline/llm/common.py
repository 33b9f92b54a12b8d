"""What the operators share: sizes read from plans, tables in the shared folder, and safe column names."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of the warehouse's where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files or tables that a plan reads, from Spark's own statistics: no job runs. A source of
    unknown size counts as 64 MB a partition."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return known if all(x < 1 << 60 for x in sizes) else max(known, df.rdd.getNumPartitions() << 26)


def block_count(df: DataFrame, least: int = 64) -> int:
    """Blocks of about 4 MB of input each, larger ones as the input grows beyond 1 GB, up to 64 MB."""
    n = input_bytes(df)
    each = (4 << 20) * min(16.0, max(1.0, math.sqrt(n / (1 << 30))))
    return max(least, math.ceil(n / each))


def block_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator needs, so others of any name can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have yet."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name
