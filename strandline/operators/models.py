"""Operators around models, which are plug-ins: transcription, scores with their worst value, and rewriting of merged segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline import plugins
from strandline.operators.scores import score_windows

#: The scores that are known, what a window without a text gets, and whether they look at a reference.
WORST = {"comet": 0.0, "comet-qe": 0.0, "metricx": 25.0, "metricx-qe": 25.0}
#: A rewriting counts if it is so like the texts it was made of, and is tried so often.
ACCEPT, TRIES = 0.85, 3
#: Bytes of recordings after which their results leave a task, if there are enough for a batch.
HELD = 8 << 20


def batches_by_size(sizes: list[int], most: int, budget: int) -> list[list[int]]:
    """Places of recordings of like sizes, largest first: at most ``most`` in a batch, and so many that each could be as large as the batch's largest within
    ``budget`` bytes, as models pad to it. One that is larger than the budget is a batch by itself."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * sizes[out[-1][0]] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _runs(sizes: list[int], least: int, held: int, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of neighbours: one ends at ``most`` bytes, or at ``held`` if it has ``least`` recordings."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or (total >= held and i + 1 - begin >= least):
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def transcribe_all(files: DataFrame, transcriber: str, language: str, batch: int = 10, budget: int = 64 << 20) -> DataFrame:
    """A row for each of (src, tgt, content): text and time_stamps, or ``error`` if there are none. The plug-in gets lists of bytes and languages, and gives
    (text, units) for each. A batch that raises, or gives another number of results, is halved until what fails is a recording alone, so one that can't be
    transcribed takes no other with it. A null content is an error without a call. Rows keep their order within a partition.

    A task holds the recordings and results of one run of rows (HELD bytes, or a batch's ``budget``), units as Arrow arrays, however many rows Spark sends at once."""
    schema = "src string, tgt string, text string, time_stamps array<struct<text:string,start_time:double,end_time:double>>, error string"
    unit = pa.struct([("text", pa.string()), ("start_time", pa.float64()), ("end_time", pa.float64())])

    f = plugins.get("transcriber", transcriber)  # here, as workers don't know what a program has registered

    def called(content: list[bytes], places: list[int], text: list, units: list, error: list) -> None:
        try:
            got = f([content[i] for i in places], [language] * len(places))
            why = None if len(got) == len(places) else f"{len(got)} results of {len(places)}"
        except Exception as e:
            got, why = [], f"{type(e).__name__}: {e}"
        if why is None:
            for i, (t, spans) in zip(places, got):
                u, a, b = zip(*spans) if len(spans) else ((), (), ())
                text[i], units[i] = t, pa.StructArray.from_arrays([pa.array(u, pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], fields=list(unit))
        elif len(places) == 1:
            error[places[0]] = why
        else:
            for half in (places[: len(places) // 2], places[len(places) // 2 :]):
                called(content, half, text, units, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [n or 0 for n in pc.binary_length(whole.column(2)).to_pylist()]
            for begin, end in _runs(sizes, batch, min(HELD, budget), budget):
                src, tgt, column = whole.slice(begin, end - begin).columns
                content = column.to_pylist()
                text, units, error = ([None] * len(content) for _ in range(3))
                known = [i for i, c in enumerate(content) if c is not None]
                for places in batches_by_size([len(content[i]) for i in known], batch, budget):
                    called(content, [known[i] for i in places], text, units, error)
                for i, c in enumerate(content):
                    if c is None:
                        error[i] = "no content"
                ends = np.cumsum([0, *(0 if u is None else len(u) for u in units)])
                there = [u for u in units if u is not None]
                values = pa.concat_arrays(there) if there else pa.array([], unit)
                stamps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([u is None for u in units], pa.bool_()))
                yield pa.RecordBatch.from_arrays([src, tgt, pa.array(text, pa.string()), stamps, pa.array(error, pa.string())], names=["src", "tgt", "text", "time_stamps", "error"])

    return files.select("src", "tgt", "content").mapInArrow(run, schema)


def transcribe(files: DataFrame, transcriber: str, language: str, batch: int = 10, budget: int = 64 << 20) -> DataFrame:
    """The recordings that were transcribed: src, tgt, text, time_stamps. For those that failed see transcribe_all."""
    return transcribe_all(files, transcriber, language, batch, budget).where("error IS NULL").drop("error")


def scorer(name: str):
    """A scorer plug-in as a function of columns; it gets Series in batches."""
    f = plugins.get("scorer", name)

    def columns(*c: Column) -> Column:
        def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            return f(batches)

        def three(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            return f(batches)

        return pandas_udf(three if len(c) > 2 else two, "double")(*c)

    return columns


def score_as(df: DataFrame, metric: str, plugin: str = "overlap", simple: bool = False) -> DataFrame:
    """A column named as the metric: the plug-in's scores of (src, mt, ref), or of (src, mt) for a metric that looks at no reference;
    windows that lack a text get the metric's worst value, those without any -1."""
    return score_windows(df, scorer(plugin), metric, worst=WORST[metric], ref=not metric.endswith("-qe"), simple=simple)


def rewrite_merges(merged: DataFrame, rewriter: str = "concat", similarity: str = "accept", accept: float = ACCEPT, tries: int = TRIES) -> DataFrame:
    """Merged segments (their id has an underscore; src and tgt are the parts' texts, joined) with rewritten texts: a rewriting
    counts if it is like enough, the parts' own texts stay after so many tries. ``tried`` is how many there were, 0 for segments that aren't merged."""

    rewrite, like = plugins.get("rewriter", rewriter), plugins.get("similarity", similarity)

    def one(first: str, second: str) -> tuple[str, int]:
        joined = f"{first} {second}".strip()
        for i in range(1, tries + 1):
            new = plugins.retry(rewrite, attempts=1)(first, second)
            if new is not None and like(joined, new) >= accept:
                return new, i
        return joined, tries

    @pandas_udf("struct<text:string,tried:int>")
    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a or "", b or "") for a, b in zip(first, second)], columns=["text", "tried"], index=first.index)

    parts = F.contains("seg_id", F.lit("_"))
    out = merged.where(parts).withColumn("_s", run("src_1", "src_2")).withColumn("_t", run("tgt_1", "tgt_2"))
    out = out.select("doc_id", "seg_id", F.col("_s.text").alias("src"), F.col("_t.text").alias("tgt"), F.greatest("_s.tried", "_t.tried").alias("tried"))
    return out.unionByName(merged.where(~parts).select("doc_id", "seg_id", F.col("src_1").alias("src"), F.col("tgt_1").alias("tgt"), F.lit(0).alias("tried")))
