"""Sentence boundaries learnt from the corpus itself, without labels: abbreviations, collocations and frequent sentence starters
are found by log-likelihood ratios over counts, after Kiss and Strunk (2006), as plain aggregates per language.

A text is cut after end marks that white space follows, after full-width end marks and at line ends. Only cuts after a single
point or an ellipsis are in question. What decides them depends on the words around the point alone, so verdicts are made once
for each distinct pair of words, not for each place, and a join takes the false cuts back. Texts are scanned three times, in
Arrow batches (words are counted, places in question told, texts cut), and shuffled once.

Nulls: a null text is empty, a null language is one of its own. Rows equal in doc_id, language and text are one document.
A corpus without points has no rules, and all cuts stand. Columns other than these three are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.shared import materialised

#: Fixed values of the published method: scores from which a type is an abbreviation, a pair a collocation, a word a starter.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: How often an abbreviation stands with its point, for the likelihood of being one (fixed value of the method).
WITH_POINT = 0.99

#: Texts that are Python objects at a time; bytes of texts whose words a task counts at a time, about; characters of results that leave it at a time, about.
ROWS, BYTES, CHARS = 64, 8 << 20, 2_000_000

_SPACE, _MARKS, _WIDE, _CLOSERS = " \t\n\x0b\x0c\r", ".!?", "。！？", "\"')]”’»"
#: An end of a piece. It begins with a set of characters, by which it is searched; a run of marks is tried from its first one only, so that a long one costs no square.
_END = re.compile("[\n{m}{w}](?:(?<=\n)|(?<=[{m}])(?<![{m}][{m}])[{m}]*+{c}*+[{s}]++|(?<=[{w}])[{m}{w}]*+{c}*+[{s}]*+)".format(m=_MARKS, w=_WIDE, s=_SPACE, c=r"[\"')\]”’»]"))
_WORD = re.compile(f"[^{_SPACE}]*+")
#: Whether a byte is the last one of a mark or closer.
_LAST = np.isin(np.arange(256), [c.encode()[-1] for c in _MARKS + _WIDE + _CLOSERS])
#: What ends a word, by its number.
_ENDINGS = "ndep"
_CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"


def core_of(word: Column) -> Column:
    """From the first letter or digit to the last."""
    return F.regexp_extract(word, _CORE, 0)


def case_of(core: Column) -> Column:
    return F.when(core.rlike(r"^\p{Lu}"), "U").when(core.rlike(r"^\p{Ll}"), "l").otherwise("o")


def prior_of(last: Column) -> Column:
    """The type of a word before a point; "" for other marks."""
    return F.when(F.col("before") == "p", F.lower(core_of(last))).otherwise("")


def _follower(x: DataFrame) -> DataFrame:
    """Type and case of the word after a mark, in place of it."""
    x = x.withColumn("_c", core_of(F.col("next")))
    return x.withColumn("type", F.lower("_c")).withColumn("kase", case_of(F.col("_c"))).drop("_c", "next")


def mark_of(word: str) -> str:
    """What ends a word: "p" a single point, "e" more points, "d" any other end marks, "n" nothing. Closing quotes and brackets may follow."""
    base = word.rstrip(_CLOSERS)
    run = base[len(base.rstrip(_MARKS + _WIDE)) :]
    return "n" if not run else "p" if run == "." else "d" if run.strip(".") else "e"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about BYTES of text in all, across batches."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            held.append(part := batch.slice(i, ROWS))
            n += part.column("text").nbytes
            if n >= BYTES:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _endings(words: pa.Array) -> np.ndarray:
    """What ends each word, by its number; only words that a mark or closer may end are looked at one by one."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset + 1 :][: len(words)]
    out = np.zeros(len(words), np.int64)
    at = np.flatnonzero(_LAST[np.frombuffer(data, np.uint8)[ends - 1]]) if len(words) else []
    out[at] = [_ENDINGS.index(mark_of(w.decode("utf-8", "replace"))) for w in words.take(pa.array(at, pa.int64())).cast(pa.binary()).to_pylist()]
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): (lang, before, last, next, mark, n), how often a word follows a mark, and the word with that mark if it is a point. Marks are numbers. A line begins after a sure end."""
    for part in _pieces(batches):
        langs = part.column("lang").combine_chunks().dictionary_encode("encode")
        lines = pc.split_pattern(part.column("text").combine_chunks().cast(pa.string()), "\n")
        words = pc.ascii_split_whitespace(lines.flatten())
        line, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
        some = pc.not_equal(words, "")  # white space at the ends of a line
        line, words = line[np.asarray(some)], words.filter(some).dictionary_encode()
        if not len(words):
            continue
        lang = np.asarray(langs.indices, np.int64)[pc.list_parent_indices(lines).to_numpy()[line]]
        code, known = np.asarray(words.indices, np.int64), words.dictionary
        ends = _endings(known)
        begins = np.append(True, line[1:] != line[:-1])
        before = np.where(begins, 1, ends[np.roll(code, 1)])
        last = np.where(before == 3, before + np.roll(code, 1), before)
        keys, n = np.unique((lang * (len(known) + 3) + last) * len(known) + code, return_counts=True)
        keys, code = np.divmod(keys, len(known))
        lang, last = np.divmod(keys, len(known) + 3)
        pick = lambda of, i: of.take(pa.array(i))
        word = pc.if_else(pa.array(last >= 3), pick(known, np.maximum(last - 3, 0)), "")
        yield pa.RecordBatch.from_arrays([pick(langs.dictionary, lang), pa.array(np.minimum(last, 3), pa.int32()), word, pick(known, code), pa.array(ends[code], pa.int32()), pa.array(n, pa.int64())], names=["lang", "before", "last", "next", "mark", "n"])


def word_counts(docs: DataFrame, language: str = "lang") -> DataFrame:
    """(lang, prior, before, type, mark, kase, n): how often a word of a type follows a mark, with the type before it where that mark is a point. Rows may repeat.

    Counted by words as they are first, so patterns run on distinct words only."""
    d = docs.select(F.col(language).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"before": T.IntegerType(), "last": T.StringType(), "next": T.StringType(), "mark": T.IntegerType(), "n": T.LongType()}
    schema = T.StructType([T.StructField("lang", d.schema["lang"].dataType), *(T.StructField(c, k) for c, k in kinds.items())])
    few = d.mapInArrow(_count_words, schema).groupBy("lang", "before", "last", "next", "mark").agg(F.sum("n").alias("n"))
    few = few.withColumns({c: F.substring(F.lit(_ENDINGS), F.col(c) + 1, F.lit(1)) for c in ("before", "mark")})
    return _follower(few.withColumn("prior", prior_of(F.col("last")))).select("lang", "prior", "before", "type", "mark", "kase", "n")


def type_counts(counts: DataFrame) -> DataFrame:
    """(lang, type, seen, points, lower, upper, upper_mid, started, lower_start): how often types stand, with a point, in which case, in upper case after no mark, and after a point or sure end."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    low, up, start = F.col("kase") == "l", F.col("kase") == "U", F.col("before").isin("d", "p")
    return counts.groupBy("lang", "type").agg(
        F.sum("n").alias("seen"), n(F.col("mark") == "p").alias("points"), n(low).alias("lower"), n(up).alias("upper"),
        n(up & (F.col("before") == "n")).alias("upper_mid"), n(start).alias("started"), n(low & start).alias("lower_start"),
    )


def _log_l(k: Column, n: Column, p: Column) -> Column:
    """The log likelihood of k of n at a probability; a count of 0 adds 0 whatever the probability."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def association(first: Column, second: Column, both: Column, total: Column) -> Column:
    """The log-likelihood ratio of two events meeting ``both`` times; 0 if they don't meet more often than by chance."""
    rest = total - first
    p, p1, p2 = second / total, both / first, F.when(rest > 0, (second - both) / rest).otherwise(0.0)
    ratio = 2 * (_log_l(both, first, p1) + _log_l(second - both, rest, p2) - _log_l(both, first, p) - _log_l(second - both, rest, p))
    return F.when((first > 0) & (both * total > first * second), ratio).otherwise(0.0)


def type_kinds(types: DataFrame) -> DataFrame:
    """(lang, type, kind, points, score) of types that stand before a point: initial, number, abbreviation or word. types: from type_counts, stored.

    The score is the ratio of two likelihoods of the counts with and without a point, times a factor that falls with the
    type's length, one that grows with the points inside it, and one that falls with each time it stands without."""
    total = types.groupBy("lang").agg(F.sum("seen").alias("total"), F.sum("points").alias("all_points"))
    t = types.select("lang", "type", "points", "seen").where("points > 0")
    t = t.join(F.broadcast(total), t["lang"].eqNullSafe(total["lang"])).drop(total["lang"])  # a row a language
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = 2 * (_log_l(F.col("points"), F.col("seen"), F.lit(WITH_POINT)) - _log_l(F.col("points"), F.col("seen"), F.col("all_points") / F.col("total")))
    t = t.withColumn("score", ratio * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters, F.col("points") - F.col("seen")))
    number = F.col("type").rlike(r"^\p{N}[\p{N}.,:/-]*\z")
    kind = F.when(F.col("type").rlike(r"^\p{L}\z"), "initial").when(number, "number").when((F.col("type") != "") & (F.col("score") >= ABBREVIATION), "abbreviation").otherwise("word")
    return t.select("lang", "type", kind.alias("kind"), "points", "score")


def doubtful_pairs(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(lang, prior, before, type, kase, kind, points, n): the counts after an ellipsis, and after points of all but plain words."""
    k = kinds.where("kind <> 'word'").select(F.col("lang").alias("_l"), F.col("type").alias("_t"), "kind", "points")
    c = counts.select("lang", "prior", "before", "type", "kase", "n")
    after = c.where("before = 'p'")
    after = after.join(k, after["lang"].eqNullSafe(k["_l"]) & (after["prior"] == k["_t"])).drop("_l", "_t")
    return after.unionByName(c.where("before = 'e'").withColumn("kind", F.lit("ellipsis")).withColumn("points", F.lit(0).cast("long"))).select("lang", "prior", "before", "type", "kase", "kind", "points", "n")


def follower_counts(types: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(lang, type, seen, lower, upper, upper_mid, lower_start, total, score) of the types of doubtful pairs: how words stand after
    others. ``score`` is the association with places that surely start a sentence, 0 for what has no letter.

    Places start one surely after sure ends and after points of plain words, so those of doubtful pairs are taken off. types, doubtful: stored."""
    n = lambda c: F.sum(F.when(c & (F.col("before") == "p"), F.col("n")).otherwise(0))
    off = doubtful.groupBy(F.col("lang").alias("_l"), F.col("type").alias("_t")).agg(n(F.lit(True)).alias("_s"), n(F.col("kase") == "l").alias("_low"))
    f = types.join(off, types["lang"].eqNullSafe(off["_l"]) & (types["type"] == off["_t"])).drop("_l", "_t")
    f = f.withColumn("started", F.col("started") - F.col("_s")).withColumn("lower_start", F.col("lower_start") - F.col("_low")).drop("_s", "_low")
    of_all = types.select("lang", "seen", "started").unionByName(doubtful.where("before = 'p'").select("lang", F.lit(0).cast("long").alias("seen"), (-F.col("n")).alias("started")))
    total = of_all.groupBy("lang").agg(F.sum("seen").alias("total"), F.sum("started").alias("starts"))
    f = f.join(F.broadcast(total), f["lang"].eqNullSafe(total["lang"])).drop(total["lang"])  # a row a language
    score = F.when(F.col("type").rlike(r"\p{L}"), association(F.col("starts"), F.col("seen"), F.col("started"), F.col("total"))).otherwise(0.0)
    return f.select("lang", "type", "seen", "lower", "upper", "upper_mid", "lower_start", "total", score.alias("score"))


def false_cuts(counts: DataFrame) -> DataFrame:
    """(lang, prior, before, type, kase, why): the pairs of words between which a point or an ellipsis ends no sentence.

    * collocation: the point's word (not a plain one) and the next belong together, and the next is no starter;
    * abbreviation, ellipsis: unless the next word is upper case and either a starter, or one known in lower case and never in upper case inside a sentence;
    * initial, number: if the next word is lower case and known in upper case, or never lower case after a sure end;
    * initial: if the next word is upper case, never known in lower case, and not shown to start sentences by being upper case after sure ends only.

    counts: from word_counts, stored, as it is read several times. Only pairs that may be false cuts are joined with what is known of the next word."""
    types = materialised(type_counts(counts), "type-counts")
    doubtful = materialised(doubtful_pairs(counts, type_kinds(types)), "doubtful-pairs")
    pairs = doubtful.groupBy("lang", "prior", "before", "type", "kase", "kind", "points").agg(F.sum("n").alias("_n"))
    both = Window.partitionBy("lang", "prior", "before", "type")  # at most one row a case
    x = pairs.withColumn("both", F.sum("_n").over(both)).drop("_n")
    f = follower_counts(types, doubtful).withColumnsRenamed({"lang": "_fl", "type": "_ft", "score": "start_score"})
    x = x.join(f, x["lang"].eqNullSafe(f["_fl"]) & (x["type"] == f["_ft"])).drop("_fl", "_ft")
    low, up = F.col("kase") == "l", F.col("kase") == "U"
    starter = F.col("start_score") > STARTER
    opens = up & (F.col("lower") > 0) & (F.col("upper_mid") == 0)
    goes_on = low & ((F.col("upper") > 0) | (F.col("lower_start") == 0))
    together = (F.col("before") == "p") & (association(F.col("points"), F.col("seen"), F.col("both"), F.col("total")) > COLLOCATION) & ~starter
    short = F.col("kind").isin("abbreviation", "ellipsis")
    why = F.when(together, "collocation").when(short & ~opens & ~(up & starter), F.col("kind")).when(~short & goes_on, F.col("kind"))
    why = why.when((F.col("kind") == "initial") & up & (F.col("lower") == 0) & (F.col("upper_mid") > 0), "initial")
    return x.select("lang", "prior", "before", "type", "kase", why.alias("why")).where("why IS NOT NULL")


def learn(docs: DataFrame, language: str = "lang") -> DataFrame:
    """The rules of a corpus (text and a language): false_cuts of its counts."""
    return false_cuts(materialised(word_counts(docs, language), "word-counts"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _ends(text: str) -> list[int]:
    """Where the pieces of a text end."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if not text or (ends and ends[-1] == len(text)) else [*ends, len(text)]


@lru_cache(10_000)
def _in_question(end: str) -> str:
    """The mark of an end of a piece, with the white space after it, if it is a point or an ellipsis and no line ends there."""
    mark = mark_of(end.rstrip(_SPACE))
    return mark if mark in "pe" and "\n" not in end else ""


def _tell_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (_key, lang, text): (_key, lang, at, before, last, next) of the ends of pieces in question, the mark and the words around them."""
    kinds = pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()
    for part in _texts(batches):
        found = []
        for k, text in enumerate(part.column("text").to_pylist()):
            begin, held = 0, None
            for m in _END.finditer(text):
                end = m.end()
                if held:  # the piece after it ends here
                    found.append((*held, _WORD.match(text, begin, end)[0]))
                    held = None
                if before := _in_question(m[0]):
                    piece = text[begin:end].rstrip(_SPACE)
                    last = piece[piece.rfind(" ") + 1 :]
                    if not last.isprintable():  # other white space isn't
                        last = last[max(map(last.rfind, _SPACE)) + 1 :]
                    held = k, end, before, last
                begin = end
            if held and begin < len(text):
                found.append((*held, _WORD.match(text, begin)[0]))
        row, *rest = (pa.array(x, t) for x, t in zip(zip(*found) if found else ((),) * 5, kinds))
        yield pa.RecordBatch.from_arrays([*part.select(["_key", "lang"]).take(row).columns, *rest], names=["_key", "lang", "at", "before", "last", "next"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, wrong): (doc_id, pos, sentence, char_start, char_end), texts cut at all ends of pieces that aren't wrong."""
    kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()

    def told(part, found):
        row, *rest = (pa.array(x, t) for x, t in zip(zip(*found) if found else ((),) * 5, kinds))
        return pa.RecordBatch.from_arrays([*part.select(["doc_id"]).take(row).columns, *rest], names=["doc_id", "pos", "sentence", "char_start", "char_end"])

    for part in _texts(batches):
        found, size = [], 0
        for k, (text, wrong) in enumerate(zip(part.column("text").to_pylist(), part.column("wrong").to_pylist())):
            ends, begin, pos = _ends(text), 0, 0
            if wrong:
                wrong = frozenset(wrong)
                ends = [e for e in ends if e not in wrong]
            for end in ends:
                s = text[begin:end].lstrip(_SPACE)
                start, begin = end - len(s), end
                if s := s.rstrip(_SPACE):
                    found.append((k, pos, s, start, start + len(s)))
                    pos, size = pos + 1, size + len(s)
                    if size >= CHARS:
                        yield told(part, found)
                        found, size = [], 0
        yield told(part, found)


def learned_sentences(docs: DataFrame, rules: DataFrame | None = None, language: str = "lang") -> DataFrame:
    """(doc_id, pos, sentence, char_start, char_end): sentences without white space at their ends, and their spans in the text.

    docs: doc_id, text and a language; rules: from ``learn``, of this corpus where none are given."""
    rules = materialised(learn(docs, language), "boundary-rules") if rules is None else rules  # read twice; places aren't shuffled where its size is seen to be small
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.to_json(F.struct("doc_id", F.col(language))), text), 256))
    d = docs.select("doc_id", F.col(language).alias("lang"), text.alias("text"), key.alias("_key"))

    schema = T.StructType([d.schema["_key"], d.schema["lang"], T.StructField("at", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("before", "last", "next"))])
    told = d.select("_key", "lang", "text").mapInArrow(_tell_places, schema).withColumn("prior", prior_of(F.col("last"))).drop("last")

    def met(x, r, *on):
        same = x["lang"].eqNullSafe(r["lang"])
        for c in on:
            same = same & (x[c] == r[c])
        return x.join(r, same, "left_semi")

    told = _follower(met(told, rules.select("lang", "before", "prior").distinct(), "before", "prior"))  # few words have a rule, so few places are looked at further
    wrong = met(told, rules, "before", "prior", "type", "kase").groupBy("_key").agg(F.collect_set("at").alias("wrong"))

    whole = d.select("doc_id", "text", "_key").dropDuplicates(["_key"]).join(wrong, "_key", "left").select("doc_id", "text", "wrong")
    return whole.mapInArrow(_cut, T.StructType([d.schema["doc_id"], *(T.StructField(n, t) for n, t in (("pos", T.IntegerType()), ("sentence", T.StringType()), ("char_start", T.LongType()), ("char_end", T.LongType())))]))
