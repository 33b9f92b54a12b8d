"""The whole evaluation: from transcripts and segments to aligned segments, instances, scores and reports.

Three tables are materialised (transcripts, aligned segments, instances); all else is one plan between them.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import arrays as A
from strandline.functions import text as X
from strandline.kernels import match as M
from strandline.operators import alignment, documents, resegment, scores
from strandline.operators.shared import materialised
from strandline.sources import readers, writers


@dataclass
class Config:
    """Inputs and layout of a run."""

    src_lang: str
    tgt_lang: str
    asr_dir: str
    yaml_path: str
    src_txt: str
    ref_txt: str
    output_dir: str
    splitter: str = "regex"
    embedder: str = "hashed_ngrams"
    overlap: int = 8

    def path(self, *parts: str) -> str:
        return os.path.join(self.output_dir, *parts)

    @property
    def aligned_path(self) -> str:
        return self.path("output_segmentation", "hyp", "aligned")

    @property
    def bleu_tokenizer(self) -> str:
        return X.BLEU_TOKENIZERS.get(self.tgt_lang, "13a")


def char_spans(asr: DataFrame) -> DataFrame:
    """Transcripts with the span of each timed unit in the stream of the text's kept characters."""
    units = F.transform(F.coalesce("time_stamps", F.array().cast("array<struct<text:string,start_time:double,end_time:double>>")), lambda u: F.lower(X.kept_chars(u["text"])))
    # the stream is a column of its own: a Python function can't stand inside a fold
    return asr.withColumn("stream", X.char_stream(F.col("text"))).withColumn("unit_spans", A.locate_units(F.col("stream"), units))


def instances_log(yaml: DataFrame, asr: DataFrame) -> DataFrame:
    """A row a recording: units, their end times in ms as delays, and its length by its segments."""
    lengths = yaml.groupBy("wav").agg((F.max(F.col("offset") + F.col("duration")) * 1000).alias("source_length_ms"))
    found = documents.yaml_to_asr(yaml, char_spans(asr)).join(lengths, "wav")
    units = F.coalesce("time_stamps", F.array().cast("array<struct<text:string,start_time:double,end_time:double>>"))
    return found.select(
        "doc_id", F.col("text").alias("prediction"), F.transform(units, lambda u: F.rint(u["end_time"] * 1000)).alias("delays"), F.array().cast("array<double>").alias("elapsed"),
        F.transform(units, lambda u: u["text"]).alias("prediction_units"), F.transform("unit_spans", lambda s: F.array(s["char_start"], s["char_end"])).alias("spans"), "source_length_ms", "first",
    )


def segment_table(yaml: DataFrame, src: DataFrame, ref: DataFrame) -> DataFrame:
    """Sentences of the sources with times and references: doc_id, row_idx, start_ms, end_ms, text, ref."""
    z = documents.zip_lines(yaml, src, ref)
    return z.select(X.doc_key(F.col("wav")).alias("doc_id"), "row_idx", (F.col("offset") * 1000).alias("start_ms"), ((F.col("offset") + F.col("duration")) * 1000).alias("end_ms"), F.col("src").alias("text"), "ref")


def align(config: Config, segments: DataFrame, instances: DataFrame) -> DataFrame:
    """Aligned segments of every document that has both sides."""
    order = (F.col("row_idx"),)
    kept = segments.where("text <> ''")
    source = kept.groupBy("doc_id").agg(documents.ordered_list(F.col("text"), *order).alias("src_list"), documents.ordered_list(F.col("ref"), *order).alias("ref_list"), documents.ordered_list((F.col("row_idx") + 1).cast("int"), *order).alias("src_ref_ids"))
    split = documents.sentence_offsets(instances.select("doc_id", F.col("prediction").alias("text")), config.splitter)
    target = split.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "sentence"))), lambda s: F.struct(s["sentence"].alias("sentence"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"))).alias("tgt_sentences"))
    docs = materialised(source.join(target, "doc_id").withColumn("sys_id", F.lit(None).cast("string")).withColumn("tgt_list", F.transform("tgt_sentences", lambda s: s["sentence"])), "docs")
    texts = alignment.distinct_overlaps(docs, "src_list", config.overlap).unionByName(alignment.distinct_overlaps(docs, "tgt_list", config.overlap)).distinct()
    vectors = materialised(alignment.embed(texts, config.embedder), "vectors")
    best = alignment.sweep_best(alignment.with_vectors(docs, vectors, "src_list", config.overlap, "a"), alignment.with_vectors(docs, vectors, "tgt_list", config.overlap, "b"), config.overlap)
    return alignment.aligned_segments(best, docs)


def raw_spans(aligned: DataFrame, instances: DataFrame) -> DataFrame:
    """Target spans of raw text as spans of the stream of kept characters, in which units are located."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: M.stream_places(t or ""))

    # one list of places a document, then a look-up a segment; the list is read from storage, not computed for each
    known = materialised(instances.select("doc_id", places("prediction").alias("_places")), "places")
    spans = aligned.join(known.select("doc_id", "_places"), "doc_id", "left")
    upto = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.get("_places", F.least(F.col(c), F.size("_places") - 1)))
    return spans.withColumns({c: upto(c).cast("int") for c in ("mt_char_start", "mt_char_end")}).drop("_places")


def score(config: Config, aligned: DataFrame, segments: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances of aligned segments, numbered over all documents in order of first appearance."""
    out = resegment.resegment(materialised(raw_spans(aligned, instances), "spans"), segments.select("doc_id", "row_idx", "start_ms", "end_ms", "text"), instances)
    placed = out.join(instances.select("doc_id", "first"), "doc_id")
    before = placed.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    start = before.select("first", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("start"))  # a row a recording
    return placed.join(start, "first").withColumn("index", F.col("start") + F.col("position")).drop("first", "start", "position")


def run(spark: SparkSession, config: Config) -> dict:
    """Write aligned segments, instances, scores, quality inputs, report and metadata under the output folder; metadata also on failure."""
    started, status, error = datetime.now(timezone.utc), "ok", None
    try:
        yaml = readers.segment_yaml(spark, config.yaml_path)
        segments = materialised(segment_table(yaml, readers.lines(spark, config.src_txt), readers.lines(spark, config.ref_txt)), "segments")
        asr = readers.json_dir(spark, config.asr_dir, "src string, tgt string, text string, time_stamps array<struct<text:string,start_time:double,end_time:double>>")
        instances = materialised(instances_log(yaml, asr), "instances")
        writers.jsonl(align(config, segments, instances), config.aligned_path)
        aligned = spark.read.schema(schemas.ALIGNED_SEGMENT).json(config.aligned_path)
        scored = materialised(score(config, aligned, segments, instances), "reseg")
        writers.jsonl(scored, config.path("output_evaluation", "instances.resegmented"))
        quality = scores.quality_input(scored)
        writers.jsonl(quality, config.path("output_evaluation", "quality_inputs"))
        row = scores.score_row(scored, config.bleu_tokenizer)
        writers.scores_tsv(row, config.path("output_evaluation", "scores.resegmented.csv"))
        ok = F.col("latency_eligible")
        cards = quality.join(scored.select("index", (F.try_element_at("elapsed", F.lit(1)) - F.col("source_length")).alias("f"), A.ending_offset(F.col("elapsed"), F.col("source_length")).alias("e")), "index").withColumns({"first_offset": F.when(ok, F.col("f")), "end_offset": F.when(ok, F.col("e"))})
        writers.html_report(writers.report_cards(cards), config.path("output_evaluation", "report.html"))
        return row.first().asDict()
    except Exception as e:
        status, error = "failed", repr(e)
        raise
    finally:
        writers.write_run_metadata(spark, config.path("run_meta.json"), writers.run_metadata(spark, asdict(config), started, status, error))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Evaluate simultaneous translation of long recordings.")
    for name in ("src-lang", "tgt-lang", "asr-dir", "yaml-path", "src-txt", "ref-txt", "output-dir"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--splitter", default="regex")
    p.add_argument("--embedder", default="hashed_ngrams")
    p.add_argument("--overlap", type=int, default=8)
    from strandline.session import session

    print(run(session(), Config(**vars(p.parse_args(argv)))))


if __name__ == "__main__":
    main()
