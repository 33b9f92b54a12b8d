"""Array, vector and latency functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# -- vectors -----------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length plus 1e-5. The length is bound as a variable, as an expression inside a lambda is evaluated for each element."""
    length = F.array(norm(a) + F.lit(1e-5))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def pair_cost(similarity: Column, n0: Column, n1: Column, kx: Column | int = 1, ky: Column | int = 1) -> Column:
    """Cost of aligning kx and ky sentences, from the similarity of their vectors and their context norms."""
    return F.lit(2.0) * kx * ky * (F.lit(1.0) - similarity) / (F.lit(1e-6) + n0 + n1)


# -- latency -----------------------------------------------------------------------------------------------------


def cut(delays: Column, recording_end: Column, source_length: Column | None = None) -> Column:
    """How many delays come before the first that reaches the recording's end (or, if given, the source's length)."""
    over = lambda d: d >= recording_end if source_length is None else (d >= recording_end) | (d >= source_length)
    at = F.array_position(F.transform(delays, lambda d: F.coalesce(over(d), F.lit(False))), F.lit(True))
    return F.when(at == 0, F.size(delays)).otherwise((at - 1).cast("int"))


def yaal(delays: Column, source_length: Column, recording_end: Column | None = None, target_length: Column | None = None, longform: bool = True) -> Column:
    """Average lagging of a prefix: the mean of d_t - t / gamma before the cut; null if nothing comes before it.

    gamma = max(delays, target length) / source length. Without a recording's end only shortform is cut."""
    end = F.lit(float("inf")) if recording_end is None else F.coalesce(recording_end, F.lit(float("inf")))
    tau = cut(delays, end, None if longform else source_length)
    n = F.size(delays)
    length = n if target_length is None else F.greatest(n, target_length)
    step = source_length / length
    total = F.aggregate(F.transform(F.slice(delays, 1, tau), lambda d, t: d - t * step), F.lit(0.0), lambda s, x: s + x)
    return F.when(tau > 0, total / tau)


def ending_offset(delays: Column, source_length: Column, absolute: bool = False) -> Column:
    x = F.try_element_at(delays, F.lit(-1)) - source_length
    return F.abs(x) if absolute else x


def relative(times: Column, start: Column) -> Column:
    """Times from the segment's start on, none below 0."""
    return F.transform(times, lambda t: F.greatest(F.lit(0.0), t - start))


def cut_to_shorter(delays: Column, elapsed: Column, *others: Column) -> list[Column]:
    """Parallel arrays cut to one length; elapsed is delays where it is missing or of another length."""
    e = F.when(elapsed.isNull() | (F.size(elapsed) != F.size(delays)), delays).otherwise(elapsed)
    m = F.least(F.size(delays), F.size(e))
    return [F.slice(x, 1, m) for x in (delays, e, *others)]


def compact_index(units: Column) -> Column:
    """Raw indexes of the units that aren't blank."""
    at = F.filter(F.transform(units, lambda u, i: F.struct(i.alias("i"), F.regexp_replace(u, r"(?U)\s+", "").alias("u"))), lambda x: x["u"] != "")
    return F.transform(at, lambda x: x["i"])


def compact_to_raw(index: Column, start: Column, end: Column) -> Column:
    """The raw span of a compact one, blank units inside included; (0, 0) if it is none."""
    ok = (start < end) & (start >= 0) & (end <= F.size(index))
    raw = F.struct(F.try_element_at(index, start + 1).alias("start"), (F.try_element_at(index, end) + 1).alias("end"))
    return F.when(ok, raw).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))


def in_pieces(f: Callable[..., list], kind: pa.DataType, *columns: pa.Array, rows: int = 64) -> pa.Array:
    """The Arrow array of what ``f`` gives for columns as lists. So many rows at a time are Python objects, however many a batch has."""
    parts = [pa.array(f(*(c.slice(i, rows).to_pylist() for c in columns)), kind) for i in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_SPANS = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))


def _located(text: pa.Array, units: pa.Array) -> pa.Array:
    def one(t: str, us) -> list[dict]:
        at, out = 0, []
        for u in us:
            i = t.find(u, at) if u else -1
            at = i + len(u) if i >= 0 else at
            out.append({"char_start": i, "char_end": at if i >= 0 else -1})
        return out

    return in_pieces(lambda ts, uss: [one(t or "", us if us is not None else []) for t, us in zip(ts, uss)], _SPANS, text, units)


@cache
def _locate():
    return arrow_udf(_located, "array<struct<char_start:int,char_end:int>>")


def locate_units(text: Column, units: Column) -> Column:
    """The span of each unit in the text, searched from where the one before ended; (-1, -1) for a miss.

    Both are streams of kept characters, lower case; spans are of the stream. The search is a fold whose result grows with
    the document: as a column of Spark it would be copied for each unit, so it runs in Arrow batches."""
    return _locate()(text, units)


def _line_starts(s: pa.Array) -> pa.Array:
    import numpy as np
    import pyarrow.compute as pc

    lines = pc.split_pattern(s, "\n")
    sizes = np.asarray(pc.utf8_length(lines.flatten()), np.int64) + 1
    at = np.cumsum(sizes) - sizes
    offsets = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lines), 0), np.int64)))
    first = np.append(at, 0)[offsets[:-1]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at - np.repeat(first, np.diff(offsets)), pa.int64()))


@cache
def _line_starts_udf():
    return arrow_udf(_line_starts, "array<long>")


def line_starts(text: Column) -> Column:
    """Where each line of a text begins, in characters. A running sum over a list would be copied for each line, so it runs in Arrow batches."""
    return _line_starts_udf()(text)


def run_of(sentences: Column, size: Column, at: Column, most: int = 10_000) -> Column:
    """The text of so many sentences that end at a place: padded in front, blank ones named, cut to so many characters."""
    text = F.array_join(F.slice(sentences, at + 2 - size, size), " ")
    clean = F.regexp_replace(F.trim(text), r"\n", " ")
    named = F.when(clean == "", "BLANK_LINE").otherwise(F.substring(clean, 1, most))
    return F.when(at + 1 < size, F.lit("PAD")).otherwise(named)


def overlaps(sentences: Column, k: int, most: int = 10_000) -> Column:
    """All runs of 1 to k sentences as (size, at, text)."""

    def run(size, i):
        return F.struct(F.lit(size).alias("size"), i.alias("at"), run_of(sentences, F.lit(size), i, most).alias("text"))

    rows = [F.transform(F.when(F.size(sentences) > 0, F.sequence(F.lit(0), F.size(sentences) - 1)), (lambda s: lambda i: run(s, i))(s)) for s in range(1, k + 1)]
    return F.flatten(F.array(*rows))


def gather_text(items: Column, index: Column) -> Column:
    """The items of an index list, joined by spaces."""
    return F.array_join(F.transform(index, lambda i: F.get(items, i)), " ")
