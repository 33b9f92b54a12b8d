"""Sources: JSON lines, strict or lenient, folders and arrays of JSON, text lines, YAML segments, WAV files, vectors, alignments."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline import schemas
from strandline.operators.shared import materialised
from strandline.operators.sweeps import MAX_JUMP, MIN_COST, OVERLAP, parse_alignment
from strandline.sources import ranged


def _series_udf(f, kind: str):
    """A pandas UDF of a plain function, made when it is called: workers that import this module have no session."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return pandas_udf(run, kind)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are passed over, a malformed one raises. ``arrival`` numbers files' lines in order."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("arrival", F.monotonically_increasing_id())


def jsonl_lenient(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """A manifest: lines that are malformed, have no target, or (if a listing is given) name no existing file are left out."""
    raw = spark.read.schema(f"{schemas.MANIFEST}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    good = raw.where("_corrupt_record IS NULL AND tgt IS NOT NULL AND tgt <> ''").drop("_corrupt_record")
    return good if existing is None else good.join(existing.select(F.col("path").alias("tgt")), "tgt", "left_semi")


def json_dir(spark: SparkSession, path: str, schema: str, glob: str = "*_asr.json") -> DataFrame:
    """One JSON object a file; files that can't be read, or without a source, are left out."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(path)
    return raw.where("_corrupt_record IS NULL AND src IS NOT NULL AND src <> ''").drop("_corrupt_record")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records; anything else raises."""
    text = spark.read.text(path, wholetext=True)
    is_list = F.regexp_extract(F.col("value"), r"^\s*(.)", 1) == "["
    kind = T.ArrayType(T.StructType.fromDDL(schema))
    rows = F.from_json(F.when(is_list, F.col("value")).otherwise(F.raise_error(F.lit("not a JSON array"))), kind, {"mode": "FAILFAST"})
    return text.select(F.explode(rows).alias("r")).select("r.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, line) of a text file, numbered from 0 in order of the file. Splits of the file are read apart; a line's number is
    its place in its split and the number of lines in all splits before it."""
    split = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    x = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"), *split)
    x = materialised(x, "lines")
    sizes = x.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first"))
    # a row a split
    before = sizes.select("_f", "_b", "_first", (F.sum("n").over(Window.orderBy("_f", "_b")) - F.col("n")).alias("_before"))
    return x.join(F.broadcast(before), ["_f", "_b"]).select((F.col("_before") + F.col("_i") - F.col("_first")).alias("row_idx"), "line")


def _yaml_rows(t: str) -> list[dict]:
    import yaml

    return [{"wav": r["wav"], "offset": float(r["offset"]), "duration": float(r["duration"])} for r in yaml.safe_load(t) or []]


def segment_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, wav, offset, duration) of a YAML list; an empty file has none."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(_series_udf(_yaml_rows, "array<struct<wav:string,offset:double,duration:double>>")("value")).alias("row_idx", "r")).select(F.col("row_idx").cast("long").alias("row_idx"), "r.*")


def wav_listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths of WAV files in order; their bytes aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path").orderBy("path")


def wav_seconds(data: bytes | None) -> float:
    """Frames over rate of the bytes of a WAV file; 0 for anything else."""
    return ranged.wav_seconds(io.BytesIO(data), len(data)) if data else 0.0


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, seconds) of the WAV files of a folder: Spark lists them, and tasks read the heads of their chunks only. Files of no bytes aren't listed."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            seconds = []
            for name, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                with ranged.opened(name) as f:
                    seconds.append(ranged.wav_seconds(f, size))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(seconds, pa.float64())], names=["path", "seconds"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, seconds double")


def embeddings(spark: SparkSession, text_path: str, vector_path: str) -> DataFrame:
    """(text, vec): lines of a text file with the vectors of a flat float32 file. Lines must be there, and differ. The file is read
    by ranges of records, a task each."""
    text = lines(spark, text_path).withColumn("text", F.trim("line"))
    n, distinct = text.agg(F.count(F.lit(1)), F.count_distinct("text")).first()
    found = spark.read.format("binaryFile").load(vector_path).select("path", "length").collect()  # one file; its bytes aren't read
    if len(found) != 1:
        raise ValueError(f"{len(found)} files of vectors")
    path, size = found[0]["path"], found[0]["length"]
    if not n or n != distinct:
        raise ValueError("no lines" if not n else "lines repeat")
    if not size or size % (4 * n):
        raise ValueError("the vectors don't divide by the lines")
    spark.dataSource.register(ranged.flat_vectors())
    vec = spark.read.format("flat_vectors").options(dim=size // n // 4, length=size, range=ranged.RANGE).load(path)
    return text.join(vec, "row_idx").select("text", "vec")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(file, src_idx, tgt_idx, cost) of text alignments; blank lines are passed over, others that can't be read raise."""
    x = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").rlike("^(SRC|TGT):")).select(F.col("_metadata.file_name").alias("file"), parse_alignment(F.trim("value")).alias("a"))
    good = F.col("a.src_idx").isNotNull() & F.col("a.tgt_idx").isNotNull()
    return x.where(F.when(good, True).otherwise(F.raise_error(F.lit("not an alignment")).cast("boolean"))).select("file", "a.*")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, score): the first field of each line, with score 1."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("word"), F.lit(1.0).alias("score")).where("word <> ''").distinct()


def align_params(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of (max_jump, min_cost, overlap): a summary's values, or the defaults where there is none."""
    if path is None:
        return spark.createDataFrame([(MAX_JUMP, MIN_COST, OVERLAP)], "max_jump double, min_cost double, overlap int")
    p = spark.read.schema(schemas.ALIGN_PARAMS).option("multiLine", True).json(path)
    return p.select(F.coalesce("jump_stats.max", F.lit(MAX_JUMP)).alias("max_jump"), F.coalesce("cost_range_union.min", F.lit(MIN_COST)).alias("min_cost"), F.coalesce("conservative_overlap_size", F.lit(OVERLAP)).alias("overlap"))


def experiment_files(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """(pair, folder, system, path) of root/pair/folder/system.jsonl, without the ignored systems."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*/*").select("path")
    parts = F.split("path", "/")
    name = lambda i: F.element_at(parts, F.lit(i))
    return x.select(name(-3).alias("pair"), name(-2).alias("folder"), F.regexp_replace(name(-1), r"\.jsonl$", "").alias("system"), "path").where(~F.col("system").isin(list(ignored)))
