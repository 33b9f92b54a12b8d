"""Text functions as Spark columns. Only NFKC and plug-in tokenizers need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from strandline.functions.arrays import in_pieces

#: Code points of CJK characters that are tokens of their own.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}"
#: Languages and their names, and tokenizers of the quality score.
LANGUAGES = {"en": "English", "zh": "Chinese", "de": "German", "ja": "Japanese"}
#: Fixed value: what stands before the number in long document ids.
LONG_ID = "acl-long."
BLEU_TOKENIZERS = {"en": "13a", "zh": "zh", "de": "13a", "ja": "ja-mecab"}


@cache
def _nfkc():
    """Made on first use: workers that import this module have no session."""

    @pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else "")

    return f


def nfkc(c: Column) -> Column:
    """NFKC of the text, "" for null. Texts of ASCII only are their own, so these don't go to Python."""
    text = F.coalesce(c, F.lit(""))
    plain = text.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, text).otherwise(_nfkc()(F.when(~plain, text)))


def py_strip(c: Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit(""))) == ""


def kept_chars(c: Column) -> Column:
    """Letters, numbers and apostrophes only."""
    return F.regexp_replace(c, r"[^'\p{L}\p{N}]", "")


def char_stream(c: Column, normalised: bool = False) -> Column:
    """The lower-case stream of kept characters, of NFKC text unless it is normalised already."""
    return F.lower(kept_chars(c if normalised else nfkc(c)))


def match_token(c: Column, normalised: bool = False) -> Column:
    """A token as matchers see it: lower case, without punctuation, separators and control characters."""
    return F.regexp_replace(F.lower(c if normalised else nfkc(c)), r"[\p{P}\p{Z}\p{C}]", "")


def fix_decimal(c: Column) -> Column:
    """No white space around a point between digits."""
    return F.regexp_replace(c, r"(?U)(?<=\d)\s*\.\s*(?=\d)", ".")


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]$")


def is_latin(c: Column) -> Column:
    """Not empty, and every character from U+0020 and below U+4E00."""
    return py_strip(c).rlike(r"^[\x{20}-\x{4DFF}]+$")


def loose_match(needle: Column, hay: Column) -> Column:
    """Tokens that are equal, equal as matchers see them, or short latin prefixes of one another."""
    n, h = py_strip(needle), py_strip(hay)
    nn, hh = match_token(n, True), match_token(h, True)
    prefix = is_latin(n) & is_latin(h) & (F.length(nn) <= 4) & (F.length(hh) <= 12) & (F.startswith(hh, nn) | F.startswith(nn, hh))
    return (n == "") | (n == h) | (nn == "") | (nn == hh) | prefix


def space_tokens(c: Column) -> Column:
    """Words of kept characters, each CJK character a token of its own."""
    words = F.split(py_strip(c), r"(?U)\s+", -1)
    cut = lambda w: F.regexp_extract_all(kept_chars(w), F.lit(f"[{CJK}]|[^{CJK}]+"), F.lit(0))
    return F.flatten(F.transform(words, cut))


def mixed_tokens(c: Column) -> Column:
    """The same, but any character that isn't kept parts tokens."""
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]|(?:(?![{CJK}])['\\p{{L}}\\p{{N}}])+"), F.lit(0))


def tokens(c: Column, language: Column | str, plugins: dict | None = None) -> Column:
    """Tokens by language; languages with a plug-in (name to a pandas UDF of arrays) use it, all others words."""
    language = F.lower(F.lit(language) if isinstance(language, str) else language)
    out = None
    for name, udf in (plugins or {}).items():
        out = F.when(language == name, udf(c)) if out is None else out.when(language == name, udf(c))
    return space_tokens(c) if out is None else out.otherwise(space_tokens(c))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def one_decimal(c: Column) -> Column:
    """A number with one decimal place, ties to even; "-" for null."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.1f", F.rint(c * 10) / 10))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def doc_key(path: Column) -> Column:
    """The last part of a path, whichever slashes it has."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), code)


def bleu_tokenizer(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in BLEU_TOKENIZERS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.lit("13a"))


def language_pair(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?i)(en[-_](?:de|es)|ja[-_]zh)", 1)
    return F.when(found == "", "unknown").otherwise(F.lower(F.replace(found, F.lit("_"), F.lit("-"))))


def doc_matches(doc: Column, short: Column) -> Column:
    """Equal ids, or a long id that has the short one after its fixed prefix."""
    return (doc == short) | F.contains(doc, F.concat(F.lit(LONG_ID), short, F.lit(".")))


def segment_order(seg: Column) -> Column:
    """Whole numbers by value, all else after them."""
    return F.when(seg.rlike(r"^\d+$"), seg.try_cast("long")).otherwise(F.lit(1_000_000_000))


def segment_prefix(seg: Column) -> Column:
    """The number before an underscore, or the number."""
    return F.split_part(seg, F.lit("_"), F.lit(1)).try_cast("long")


def words_length(c: Column) -> Column:
    """Pieces between single spaces; 1 for an empty text."""
    return F.size(F.split(F.coalesce(c, F.lit("")), " ", -1))


def seconds_to_ms(c: Column) -> Column:
    return F.rint(c * 1000).cast("long")


def to_ms(c: Column) -> Column:
    """Milliseconds of a length of unknown unit: below 10,000 it is seconds; none or not positive is endless."""
    x = c.try_cast("double")
    return F.when(x.isNull() | (x <= 0), F.lit(float("inf"))).when(x < 10_000, x * 1000).otherwise(x)


# -- tokenizers of the corpus score ------------------------------------------------------------------------------


def bleu_tokens_13a(c: Column) -> Column:
    """Tokens of the standard mteval-v13a scheme: symbols apart, points and commas apart but between digits."""
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<skipped>"), F.lit("")), r"-\n", "")
    c = F.regexp_replace(c, r"\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    # The four patterns of the scheme.
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def bleu_tokens_zh(c: Column) -> Column:
    """Each Chinese character a token, the rest as 13a."""
    return bleu_tokens_13a(F.regexp_replace(c, f"([{CJK}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}])", " $1 "))


def bleu_tokens(c: Column, tokenizer: str = "13a") -> Column:
    if tokenizer == "zh":
        return bleu_tokens_zh(c)
    if tokenizer == "13a":
        return bleu_tokens_13a(c)
    from strandline import plugins  # Japanese and Korean morphology: raises if there is no plug-in of this name

    return plugin_tokens(c, plugins.get("tokenizer", tokenizer))


def plugin_tokens(c: Column, f) -> Column:
    """Tokens of a plug-in, a function of a text, in Arrow batches."""

    @arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        return in_pieces(lambda texts: [list(f(x or "")) for x in texts], pa.list_(pa.string()), s)

    return run(c)
