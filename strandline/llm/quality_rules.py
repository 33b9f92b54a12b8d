"""Quality rules as a learned decision list.

Statistics of each whole text are computed in one pass. From labelled rows, sequential covering learns rules that
reject: each rule is a conjunction of thresholds, grown by information gain on two thirds of the rows not covered yet,
then pruned on the other third; it stays if enough of what it covers there is of low quality. The ordered rules become one Spark
conditional expression, so that applying them needs no Python and every verdict names the rule that made it.

Defined results: a null text has no words and fails the base rule; without labels nothing but the base rule rejects;
labels of unknown or repeated documents count once, the lower label wins; null labels are left out. Lines are parted
by "\\n" only. Repeats are compared by 64-bit hashes within a text; of a repeated id the smallest text is learnt from, and each row is judged by its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import wordscan as ws
from strandline.llm.common import free_name

#: The learner sees this many labelled rows at most, those of the lowest hashes.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A rule stays if at least this part of what it covers on the pruning rows is of low quality.
PRECISION = 0.95
MAX_RULES, MAX_CONDITIONS = 24, 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_short")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

#: Ratios that the rules test: each as numerator, denominator.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "short_share": ("n_short", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def statistics(texts) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow column."""
    w = ws.Words(texts)
    body, n, doc = w.body, len(w.offsets) - 1, w.doc()
    salt = ws.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    letter = (body & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": ws.per_text(letter & ~w.space, w.offsets)}
    for name, what in (("n_symbols", _SYMBOL[body]), ("n_upper", (body >= 65) & (body <= 90)), ("n_digits", (body >= 48) & (body <= 57)), ("n_marks", _MARK[body])):
        out[name] = ws.per_text(what, w.offsets)
    start, end = ws.spans(body != 10, w.offsets)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    cuts = np.searchsorted(start, w.offsets)
    lines = np.diff(cuts)
    out["n_lines"] = lines
    key = ws.mix(ws.hashes(body, start, end) + np.repeat(salt, lines))
    out["n_dup_lines"] = lines - _distinct(key, np.repeat(np.arange(n), lines), n)
    at, window = w.windows(WINDOW)
    again = ws.repeated(ws.mix(window + salt[doc[at]])) if len(at) else np.zeros(0, bool)
    out["n_repeat_words"] = ws.per_text(ws.covered(len(w.start), at[again], WINDOW), w.range)
    out["n_distinct"] = _distinct(ws.mix(w.hash + salt[doc]), doc, n) if len(doc) else np.zeros(n, np.int64)
    out["n_short"] = ws.per_text((w.end - w.start) <= 2, w.range)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(key):
        return np.zeros(n, np.int64)
    order = np.argsort(key)
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order][first], minlength=n)


def with_statistics(docs: DataFrame, columns: list[str] | None = None, name: str = "_statistics") -> DataFrame:
    """The given columns (all, by default) and a struct of counts."""
    columns = docs.columns if columns is None else columns
    text = free_name(docs, "_text")

    def run(batches):
        for batch in batches:
            for part in ws.slices(batch, text):
                counts = statistics(part.column(text))
                packed = pa.StructArray.from_arrays([pa.array(counts[k], pa.int64()) for k in COUNTS], names=list(COUNTS))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), packed], names=[*columns, name])

    counted = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, counted)])
    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each of RATIOS; 0 where the denominator is 0."""
    cols = [counts[a] / np.maximum(counts[b], 1) if b else counts[a] for a, b in RATIOS.values()]
    return np.column_stack([np.asarray(c, float) for c in cols])


def _condition_column(feature: str, above: bool, threshold: float, name: str) -> Column:
    a, b = RATIOS[feature]
    value = F.col(f"{name}.{a}").cast("double")
    if b:
        value = value / F.greatest(F.col(f"{name}.{b}"), F.lit(1)).cast("double")
    return value > F.lit(threshold) if above else value <= F.lit(threshold)


# -- learning ---------------------------------------------------------------------------------------------------


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in conditions:
        out &= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    """Conditions that raise the information gain, one after another, until none does or only bad rows are left."""
    conditions: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < MAX_CONDITIONS:
        p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            v, y = x[inside, j], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p = np.cumsum(y)[cut]
            low_n = cut + 1 - low_p
            mid = (v[cut] + v[cut + 1]) / 2
            for above, pp, nn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] * (1 + 1e-9):
                    best = (gain[k], (j, above, float(mid[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = _holds(x, conditions)
    return conditions


def _prune(conditions, x: np.ndarray, bad: np.ndarray):
    """The shortest beginning of the conditions with the best (bad - good) / (bad + good) on the pruning rows."""
    best, kept = -2.0, conditions
    for k in range(1, len(conditions) + 1):
        inside = _holds(x, conditions[:k])
        p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, conditions[:k]
    return kept


def cover(x: np.ndarray, bad: np.ndarray, least: int = 4) -> list[list[tuple[int, bool, float]]]:
    """Sequential covering: rules, each of which rejects what no rule before it covers."""
    rules: list = []
    part = np.arange(len(x)) % 3 == 2
    while len(rules) < MAX_RULES and bad[~part].sum() >= least:
        rule = _grow(x[~part], bad[~part])
        if not rule:
            break
        rule = _prune(rule, x[part], bad[part])
        inside = _holds(x, rule)
        held = inside & part
        if bad[inside].sum() < least or not held.any() or bad[held].mean() < PRECISION or bad[inside].mean() < PRECISION:
            break
        rules.append(rule)
        x, bad, part = x[~inside], bad[~inside], part[~inside]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, _quality of at most ``sample`` documents that have a label, those of the lowest hashes; of a repeated id the smallest text."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return known.groupBy("doc_id", "_quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[tuple[str, bool, float]]]:
    """Rules as lists of (feature, above, threshold), learnt from at most ``sample`` labelled rows."""
    rows = with_statistics(labelled(docs, labels, sample), ["doc_id", "_quality"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return []
    counts = {c: np.array([r["_statistics"][c] for r in rows]) for c in COUNTS}
    bad = np.array([r["_quality"] for r in rows]) == 0
    usable = ~_base_failed(counts)
    names = list(RATIOS)
    return [[(names[j], above, t) for j, above, t in rule] for rule in cover(ratios(counts)[usable], bad[usable])]


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def verdict(rules, name: str = "_statistics") -> Column:
    """The number of the first rule that holds, from 1; 0 if none does: one conditional expression in the rules' order."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = None
        for feature, above, threshold in rule:
            c = _condition_column(feature, above, threshold, name)
            holds = c if holds is None else holds & c
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def quality_rules(docs: DataFrame, rules, columns: list[str] | None = None, name: str = "_quality") -> DataFrame:
    """The given columns (all, by default) and a struct ``_quality``: the counts, base_failed, rule and kept."""
    name = free_name(docs, name)
    df = with_statistics(docs, columns, name)
    n, r = F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    rule = verdict(rules, name)
    return df.withColumn(name, F.struct(f"{name}.*", failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_rules(docs, rules, ["doc_id"])
    return out.select("doc_id", *(f"{out.columns[-1]}.{c}" for c in (*COUNTS[:5], "base_failed", "kept", "rule")))
