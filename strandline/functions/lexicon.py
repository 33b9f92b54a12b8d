"""Tokens by a dictionary, for languages whose words aren't parted by spaces: least-cost paths through a lattice of words, and
stems with what hangs on them. Both are columns for ``text.tokens`` (its plug-ins by language) and take any dictionary table.

A null text has no tokens. Work is linear in the text's length times the longest word's, whatever the text.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.functions.arrays import in_pieces
from strandline.functions.text import kept_chars

#: A dictionary goes to every task, so larger ones (UTF-8 bytes of their words) are refused.
LARGEST = 16 << 20


def dictionary_of(words: DataFrame, limit: int = LARGEST) -> dict[str, float]:
    """{word: score} of a table (word, score), from ``readers.dictionary`` or of one's own; a word's scores are added. Raises beyond the limit."""
    each = words.where("word <> '' AND score > 0").groupBy("word").agg(F.sum(F.col("score").cast("double")).alias("score"))
    size = each.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"a dictionary of {size} bytes; at most {limit} go to every task")
    return {r["word"]: r["score"] for r in each.collect()}


def char_class(c: str) -> str:
    """Letters by their script, as its name begins (HIRAGANA, KATAKANA, HANGUL, CJK, LATIN, ...), other characters by their category."""
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return "KATAKANA" if c == "ー" else unicodedata.name(c, "LETTER").split()[0].split("-")[0]
    return kind[0]


def lattice(scores: dict[str, float]) -> Callable[[str], list[str]]:
    """A tokenizer: of all ways to cut a text's stretches between white space into dictionary words and unknown ones the one of least cost.

    A dictionary word costs minus the logarithm of its share of all scores. Unknown words are single characters and whole
    stretches of one class; they cost that of the rarest word for themselves and again for each character, so that what the
    dictionary covers is taken from there. Of equal costs the one with fewer words, then with the longer last words."""
    total = sum(scores.values())
    costs = {w: -math.log(s / total) for w, s in scores.items()}
    rarest = max(costs.values(), default=0.0) + 1.0
    longest = max(map(len, costs), default=0)

    def path(run: str) -> list[str]:
        n = len(run)
        kinds = [char_class(c) for c in run]
        begin = list(range(n))  # where each character's stretch of one class begins
        for i in range(1, n):
            if kinds[i] == kinds[i - 1]:
                begin[i] = begin[i - 1]
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, n + 1):
            ends_stretch = end == n or begin[end] == end
            ways = [(a, costs[run[a:end]]) for a in range(max(0, end - longest), end) if run[a:end] in costs]
            ways += [(a, rarest * (1 + end - a)) for a in {end - 1, *([begin[end - 1]] if ends_stretch else [])}]
            best.append(min((round(best[a][0] + c, 9), best[a][1] + 1, a) for a, c in ways))
        out, end = [], n
        while end:
            out.append(run[best[end][2] : end])
            end = best[end][2]
        return out[::-1]

    return lambda text: [w for run in text.split() for w in path(run)]


def stems(scores: dict[str, float]) -> Callable[[str], list[str]]:
    """A tokenizer: each word between white space is cut after its beginning of two characters or more that scores best in the
    dictionary, the longest of equals; a word without one, or of two characters at most, stays whole."""
    longest = max(map(len, scores), default=0)

    def cut(word: str) -> list[str]:
        known = [(scores[word[:e]], e) for e in range(2, min(len(word), longest) + 1) if word[:e] in scores]
        at = max(known)[1] if known and len(word) > 2 else len(word)
        return [x for x in (word[:at], word[at:]) if x]

    return lambda text: [x for w in text.split() for x in cut(w)]


def tokens_by(tokenizer: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A column of arrays from a column of texts: the tokenizer's tokens, of kept characters only, without empty ones."""

    @arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(lambda t: [tokenizer(x or "") for x in t], pa.list_(pa.string()), texts)

    return lambda c: F.filter(F.transform(run(c), kept_chars), lambda t: t != "")
