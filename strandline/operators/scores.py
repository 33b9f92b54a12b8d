"""Quality and latency of resegmented instances: types of null alignments, eligibility, summaries, roll-ups, corpus BLEU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions.text import bleu_tokens, is_blank, segment_order, words_length

#: The types of an alignment.
NORMAL, UNDER, OVER = "normal", "under_translation", "over_translation"


def alignment_type(explicit: Column, source: Column, prediction: Column) -> Column:
    """The given type if there is one (another name raises), else by what is blank: no source is over-translation."""
    e = F.coalesce(explicit, F.lit(""))
    bad = F.raise_error(F.concat(F.lit("unknown alignment type: "), e))
    return F.when(e.isin(NORMAL, UNDER, OVER), e).when(e != "", bad).when(is_blank(source), OVER).when(is_blank(prediction), UNDER).otherwise(NORMAL)


def null_branch(source: Column, target: Column) -> Column:
    """What resegmentation makes of blank texts: the source is looked at first; "" if none is blank."""
    return F.when(is_blank(source), OVER).when(is_blank(target), UNDER).otherwise("")


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def latency_eligible(kind: Column, delays: Column, elapsed: Column, source_length: Column) -> Column:
    return (kind == NORMAL) & _some(delays) & _some(elapsed) & source_length.isNotNull()


def counts_for_metrics(explicit: Column, delays: Column, elapsed: Column) -> Column:
    """The looser test of the metrics: no explicit type, and times. It may differ from latency_eligible."""
    return is_blank(explicit) & _some(delays) & _some(elapsed)


def quality_input(instances: DataFrame) -> DataFrame:
    kind = alignment_type(F.col("null_alignment_type"), F.col("source"), F.col("prediction"))
    return instances.withColumn("_k", kind).select(
        "index", "doc_id", "seg_id", F.col("source").alias("src"), F.col("prediction").alias("mt"), F.col("reference").alias("ref"), F.col("_k").alias("null_alignment_type"),
        F.when(F.col("_k") != NORMAL, F.lit(0.0)).alias("score_override"), latency_eligible(F.col("_k"), F.col("delays"), F.col("elapsed"), F.col("source_length")).alias("latency_eligible"),
    )


def summary(quality: DataFrame) -> DataFrame:
    """One row of counts."""
    return quality.agg(*_summary())


_SUMMARY = ["segments", "valid", "latency", "over_translation", "under_translation", "null_alignments"]


def _summary() -> list[Column]:
    k = F.col("null_alignment_type")
    counts = [F.count(F.lit(1)), F.count_if(k == NORMAL), F.count_if("latency_eligible"), F.count_if(k == OVER), F.count_if(k == UNDER), F.count_if(k != NORMAL)]
    return [c.alias(name) for c, name in zip(counts, _SUMMARY)]


def latency_columns(instances: DataFrame) -> DataFrame:
    """Each instance's lagging and ending offsets, in unaware and aware forms, null where they are undefined."""
    ok = counts_for_metrics(F.col("null_alignment_type"), F.col("delays"), F.col("elapsed"))
    d, e, n, end = (F.col(c) for c in ("delays", "elapsed", "source_length", "recording_end"))
    return instances.withColumns({"yaal": F.when(ok, A.yaal(d, n, end)), "ca_yaal": F.when(ok, A.yaal(e, n, end)), "ending_offset": F.when(ok, A.ending_offset(d, n)), "ca_ending_offset": F.when(ok, A.ending_offset(e, n))})


#: Latency columns and their names in the summary.
_LATENCIES = {"yaal": "ca_unaware_yaal", "ca_yaal": "ca_aware_yaal", "ending_offset": "ending_offset", "ca_ending_offset": "ca_ending_offset"}


def score_row(instances: DataFrame, tokenizer: str = "13a") -> DataFrame:
    """The summary of a corpus: BLEU, four latencies and six counts, in this order. A latency without instances is NaN."""
    kind = alignment_type(F.col("null_alignment_type"), F.col("source"), F.col("prediction"))
    eligible = latency_eligible(kind, F.col("delays"), F.col("elapsed"), F.col("source_length"))
    one = latency_columns(instances).select(F.col("prediction").alias("hyp"), F.col("reference").alias("ref"), *_LATENCIES, kind.alias("null_alignment_type"), eligible.alias("latency_eligible"))
    nan = F.lit(float("nan"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _counters(4)]
    total = bleu_statistics(one, tokenizer).agg(*sums, *(F.coalesce(F.avg(c), nan).alias(name) for c, name in _LATENCIES.items()), *_summary())
    return total.select(bleu_of().alias("bleu"), *_LATENCIES.values(), *_SUMMARY)


def offset_rows(instances: DataFrame) -> DataFrame:
    """First and last delay, their span, and how they lie to the recording's end; null where a text is blank."""
    ok = ~is_blank(F.col("source")) & ~is_blank(F.col("prediction"))
    first, last = F.try_element_at("delays", F.lit(1)), F.try_element_at("delays", F.lit(-1))
    out = {"first_delay": first, "last_delay": last, "recording_end": F.col("recording_end"), "delay_span": last - first, "gap": last - F.col("recording_end"), "diff_ms_span": last - first - F.col("recording_end")}
    return instances.select("doc_id", "seg_id", *(F.when(ok, c).alias(k) for k, c in out.items()))


def histogram(values: DataFrame, column: str, low: float = -9.0, high: float = 9.0, bins: int = 36) -> DataFrame:
    """Counts of equal bins, empty ones too; the last one holds its upper edge, values outside none."""
    x = F.col(column)
    width = (high - low) / bins
    at = F.when(x == high, bins).when((x >= low) & (x < high), F.floor((x - low) / width) + 1)
    counted = values.where(~F.isnan(x)).select(at.cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# -- BLEU --------------------------------------------------------------------------------------------------------


def bleu_statistics(pairs: DataFrame, tokenizer: str = "13a", order: int = 4) -> DataFrame:
    """For each pair: lengths, and for each n the clipped matches and the number of n-grams.

    Counting is inside the row, so what is left for the corpus is eleven sums."""
    t = pairs.withColumn("_h", bleu_tokens(F.col("hyp"), tokenizer)).withColumn("_r", bleu_tokens(F.col("ref"), tokenizer))
    stats = [F.size("_h").cast("long").alias("hyp_len"), F.size("_r").cast("long").alias("ref_len")]
    for n in range(1, order + 1):
        grams = lambda c, n=n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), _gram(c, n))).otherwise(F.array().cast("array<string>"))
        h, r = grams(F.col("_h")), grams(F.col("_r"))
        stats.append(_clipped(h, r).alias(f"match_{n}"))
        stats.append(F.greatest(F.size("_h") - (n - 1), F.lit(0)).cast("long").alias(f"total_{n}"))
    return t.select(*[c for c in pairs.columns if c not in ("hyp", "ref")], *stats)


def _gram(c: Column, n: int):
    return lambda i: F.array_join(F.slice(c, i, F.lit(n)), " ")


def _clipped(h: Column, r: Column) -> Column:
    """Matches of two multisets of n-grams: both are sorted together, those of h before equal ones of r, and one pass pairs them off."""
    side = lambda xs, k: F.transform(xs, lambda g: F.struct(g.alias("g"), F.lit(k).alias("side")))
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("met"))

    def step(s, x):
        left = F.when(s["g"] == x["g"], s["left"]).otherwise(0)
        pairs = (x["side"] == 1) & (left > 0)
        return F.struct(x["g"].alias("g"), F.when(x["side"] == 0, left + 1).when(pairs, left - 1).otherwise(left).alias("left"), (s["met"] + F.when(pairs, 1).otherwise(0)).alias("met"))

    return F.aggregate(F.array_sort(F.concat(side(h, 0), side(r, 1))), start, step, lambda s: s["met"].cast("long"))


def _counters(order: int) -> list[str]:
    return ["hyp_len", "ref_len", *[f"{k}_{n}" for n in range(1, order + 1) for k in ("match", "total")]]


def corpus_bleu(pairs: DataFrame, tokenizer: str = "13a", order: int = 4) -> DataFrame:
    """One row: BLEU of all pairs together, with exponential smoothing of orders without a match; nulls count as empty texts."""
    s = bleu_statistics(pairs, tokenizer, order)
    total = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _counters(order)])
    return total.withColumn("bleu", bleu_of(order))


def bleu_of(order: int = 4) -> Column:
    """BLEU of the summed counters match_n, total_n, hyp_len, ref_len."""
    logs, zeros = None, F.lit(0)
    for n in range(1, order + 1):
        m, t = F.col(f"match_{n}").cast("double"), F.col(f"total_{n}").cast("double")
        zeros = zeros + F.when((F.col(f"match_{n}") == 0) & (F.col(f"total_{n}") > 0), 1).otherwise(0)
        p = F.when(F.col(f"total_{n}") == 0, F.lit(None).cast("double")).when(F.col(f"match_{n}") == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * t)).otherwise(100.0 * m / t)
        logs = F.ln(p) if logs is None else logs + F.ln(p)
    h, r = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    brevity = F.when(h >= r, 1.0).when(h > 0, F.exp(1 - r / h)).otherwise(0.0)
    return F.when(F.col("match_1") == 0, 0.0).otherwise(F.coalesce(brevity * F.exp(logs / order), F.lit(0.0)))


# -- scores of windows and documents ------------------------------------------------------------------------------


def window_state(src: Column, mt: Column, ref: Column | None = None) -> Column:
    """"score" if all is there, "worst" if only the target or only all but the target is, else "skip"."""
    there = lambda c: ~is_blank(c)
    rest = there(src) if ref is None else there(src) & there(ref)
    none = ~there(src) if ref is None else ~there(src) & ~there(ref)
    return F.when(rest & there(mt), "score").when((there(mt) & none) | (~there(mt) & rest), "worst").otherwise("skip")


def window_state_simple(*columns: Column) -> Column:
    every = None
    for c in columns:
        every = ~is_blank(c) if every is None else every & ~is_blank(c)
    return F.when(every, "score").otherwise("worst")


def score_windows(df: DataFrame, scorer, name: str, worst: float = 0.0, ref: bool = True, simple: bool = False) -> DataFrame:
    """A column of scores: those of the scorer (a pandas UDF) where all texts are there, the worst one, or -1. Rows keep their place."""
    c = [F.col("src"), F.col("mt"), *([F.col("ref")] if ref else [])]
    state = window_state_simple(*c) if simple else window_state(*c)
    df = df.withColumn("_state", state)
    to_score = df.where("_state = 'score'").withColumn(name, scorer(*c))
    rest = df.where("_state <> 'score'").withColumn(name, F.when(F.col("_state") == "worst", F.lit(float(worst))).otherwise(F.lit(-1.0)))
    return to_score.unionByName(rest).drop("_state")


def rollup(scored: DataFrame, scores: list[str], order: str = "seg_id", first: str | None = None) -> DataFrame:
    """A row a document: texts in order, means of the scores that aren't negative (0 if none), counts by the first score."""
    from strandline.operators.documents import ordered_concat, place_of

    lead = first or scores[0]
    place = place_of(scored, order)
    return scored.groupBy("doc_id").agg(
        *[ordered_concat(F.col(c), place, F.col(order)).alias(c) for c in ("src", "ref", "mt") if c in scored.columns],
        *[F.coalesce(F.avg(F.when(F.col(s) >= 0, F.col(s))), F.lit(0.0)).alias(s) for s in scores],
        F.count_if(F.col(lead) >= 0).alias("total_seg"), F.count_if(F.col(lead) == 0).alias("misaligned_seg"),
    )


def mean_by_doc(scored: DataFrame, score: str) -> DataFrame:
    return scored.groupBy("doc_id").agg(F.coalesce(F.avg(score), F.lit(0.0)).alias(score))


def reference_length(c: Column, unit: str = "word") -> Column:
    from strandline.functions.text import py_strip

    return words_length(c) if unit == "word" else F.length(py_strip(F.coalesce(c, F.lit(""))))
