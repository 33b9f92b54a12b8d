"""Queries of what is learnt from the documents themselves, sentence boundaries, vectors and dictionaries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import lexicon
from strandline.functions import text as X
from strandline.operators import boundaries, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CLOSERS = "'\"'')]”’»'"
_RUN = f"substring(rtrim({{0}}, {_CLOSERS}), length(rtrim(rtrim({{0}}, {_CLOSERS}), '.!?。！？')) + 1)"
_MARK = f"(CASE WHEN {_RUN} = '' THEN 'n' WHEN {_RUN} = '.' THEN 'p' WHEN ltrim({_RUN}, '.') = '' THEN 'e' ELSE 'd' END)"
_CORE = r"regexp_extract({0}, '(?s)[\p{{L}}\p{{N}}](?:.*[\p{{L}}\p{{N}}])?')"
_KASE = r"(CASE WHEN regexp_matches({0}, '^\p{{Lu}}') THEN 'U' WHEN regexp_matches({0}, '^\p{{Ll}}') THEN 'l' ELSE 'o' END)"


def _features(last: str, nxt: str) -> str:
    core = _CORE.format(nxt)
    return f"CASE WHEN {_MARK.format(last)} = 'p' THEN lower({_CORE.format(last)}) ELSE '' END AS prior, {_MARK.format(last)} AS before, lower({core}) AS type, {_KASE.format(core)} AS kase"


def _log_l(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def _association(c1: str, c2: str, c12: str, n: str) -> str:
    c1, c2, c12, n = (f"({x})::DOUBLE" for x in (c1, c2, c12, n))
    p, p1, p2 = f"({c2} / {n})", f"({c12} / {c1})", f"(CASE WHEN {n} > {c1} THEN ({c2} - {c12}) / ({n} - {c1}) ELSE 0 END)"
    rest, others = f"({n} - {c1})", f"({c2} - {c12})"
    ratio = f"2 * ({_log_l(c12, c1, p1)} + {_log_l(others, rest, p2)} - {_log_l(c12, c1, p)} - {_log_l(others, rest, p)})"
    return f"(CASE WHEN {c1} > 0 AND {c12} * {n} > {c1} * {c2} THEN {ratio} ELSE 0 END)"


_RULES = (
    r"w0 AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '\n|[^\x20\x09-\x0D]+') AS w FROM documents), w1 AS (SELECT lang, unnest(list_zip([chr(10)] || w[:-2], w)) AS x FROM w0), "
    + "w2 AS (SELECT lang, x[1] AS a, x[2] AS b FROM w1 WHERE x[2] <> chr(10)), w3 AS (SELECT lang, CASE WHEN a = chr(10) THEN '!' ELSE a END AS a, b, count(*) AS n FROM w2 GROUP BY ALL), "
    + f"w4 AS (SELECT lang, {_features('a', 'b')}, {_MARK.format('b')} AS mark, n FROM w3), "
    + "c AS (SELECT lang, prior, before, type, mark, kase, sum(n)::BIGINT AS n FROM w4 GROUP BY ALL), "
    + "tot AS (SELECT lang, sum(n)::DOUBLE AS total, sum(CASE WHEN mark = 'p' THEN n ELSE 0 END)::DOUBLE AS dots FROM c GROUP BY lang), "
    + "t0 AS (SELECT lang, type, sum(CASE WHEN mark = 'p' THEN n ELSE 0 END)::DOUBLE AS points, sum(CASE WHEN mark <> 'p' THEN n ELSE 0 END)::DOUBLE AS plain, length(replace(type, '.', '')) AS letters FROM c GROUP BY lang, type), "
    + f"t1 AS (SELECT t0.*, 2 * ({_log_l('points', '(points + plain)', '0.99::DOUBLE')} - {_log_l('points', '(points + plain)', '(dots / total)')}) * exp(-letters) * (length(type) - letters + 1) * pow(letters, -plain) AS score FROM t0 JOIN tot ON t0.lang IS NOT DISTINCT FROM tot.lang WHERE points > 0), "
    + r"k AS (SELECT *, CASE WHEN regexp_full_match(type, '\p{L}') THEN 'initial' WHEN regexp_full_match(type, '\p{N}[\p{N}.,:/-]*') THEN 'number' WHEN type <> '' AND score >= 0.3 THEN 'abbreviation' ELSE 'word' END AS kind FROM t1), "
    + "s AS (SELECT c.*, (before = 'd' OR (before = 'p' AND k.kind = 'word')) AS start FROM c LEFT JOIN k ON c.lang IS NOT DISTINCT FROM k.lang AND c.prior = k.type AND before = 'p'), "
    + "f0 AS (SELECT lang, type, sum(n) AS seen, coalesce(sum(n) FILTER (start), 0) AS started, coalesce(sum(n) FILTER (kase = 'l'), 0) AS low, coalesce(sum(n) FILTER (kase = 'U'), 0) AS up, coalesce(sum(n) FILTER (kase = 'U' AND before = 'n'), 0) AS up_mid, coalesce(sum(n) FILTER (kase = 'l' AND start), 0) AS low_start FROM s GROUP BY lang, type), "
    + "f1 AS (SELECT *, sum(started) OVER (PARTITION BY lang) AS starts, sum(seen) OVER (PARTITION BY lang) AS total FROM f0), "
    + r"f AS (SELECT *, regexp_matches(type, '\p{L}') AND "
    + _association("starts", "seen", "started", "total")
    + " > 30 AS starter FROM f1), "
    + "p AS (SELECT DISTINCT lang, prior, before, type, kase, sum(n) OVER (PARTITION BY lang, prior, before, type) AS met FROM c WHERE before IN ('p', 'e')), "
    + "x AS (SELECT p.*, CASE WHEN before = 'e' THEN 'ellipsis' ELSE kind END AS kind, points, seen, low, up, up_mid, low_start, total, starter FROM p LEFT JOIN k ON p.lang IS NOT DISTINCT FROM k.lang AND p.prior = k.type AND before = 'p' JOIN f ON p.lang IS NOT DISTINCT FROM f.lang AND p.type = f.type), "
    + "y AS (SELECT *, kind IN ('abbreviation', 'ellipsis') AS short, kase = 'U' AND low > 0 AND up_mid = 0 AS opens, kase = 'l' AND (up > 0 OR low_start = 0) AS goes_on FROM x WHERE kind <> 'word'), "
    + "r AS (SELECT lang, prior, before, type, kase, CASE WHEN before = 'p' AND NOT starter AND "
    + _association("points", "seen", "met", "total")
    + " > 7.88 THEN 'collocation' WHEN short AND NOT opens AND NOT (kase = 'U' AND starter) THEN kind WHEN NOT short AND goes_on THEN kind WHEN kind = 'initial' AND kase = 'U' AND low = 0 AND up_mid > 0 THEN 'initial' END AS why FROM y)"
)
_SPACED = "translate({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
_PIECES = r"""(?s).*?(?:\n|[.!?]+["'')\]”’»]*[\x20\x09-\x0D]+|[。！？][.!?。！？]*["'')\]”’»]*[\x20\x09-\x0D]*|\z)"""
_SENTENCES = (
    f", d AS (SELECT doc_id, lang, list_filter(regexp_extract_all(coalesce(text, ''), '{_PIECES}'), lambda p: p <> '') AS a FROM documents), "
    + "e AS (SELECT doc_id, lang, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM d), g AS (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM e), "
    + f"h AS (SELECT *, string_split(rtrim({_SPACED.format('p')}), ' ')[-1] AS a, string_split(ltrim({_SPACED.format('q')}), ' ')[1] AS b FROM g), "
    + f"m AS (SELECT doc_id, lang, i, p, q, {_features('a', 'b')} FROM h), "
    + "o AS (SELECT m.*, r.why IS NULL OR q IS NULL OR contains(p, chr(10)) AS ends FROM m LEFT JOIN (SELECT * FROM r WHERE why IS NOT NULL) r ON m.lang IS NOT DISTINCT FROM r.lang AND m.prior = r.prior AND m.before = r.before AND m.type = r.type AND m.kase = r.kase), "
    + "u AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM o), "
    + "v AS (SELECT doc_id, s, min(p0) AS p0, string_agg(p, '' ORDER BY i) AS p FROM u GROUP BY doc_id, s), "
    + "z AS (SELECT doc_id, s, p0 + length(p) - length(ltrim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS char_start, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM v) "
    + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS pos, sentence, char_start::BIGINT AS char_start, (char_start + length(sentence))::BIGINT AS char_end FROM z WHERE sentence <> ''"
)

ORACLE_SQL["boundary_rules"] = "WITH " + _RULES + " SELECT * FROM r WHERE why IS NOT NULL"
ORACLE_SQL["learned_sentences"] = "WITH " + _RULES + _SENTENCES


def boundary_rules(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of words of each language between which a point ends no sentence."""
    return boundaries.learn(spark.read.parquet(f"{d}/documents.parquet"))


def learned_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents by boundaries learnt from all documents."""
    return boundaries.learned_sentences(spark.read.parquet(f"{d}/documents.parquet"))


#: A pair of neighbours at each distance, then both ways.
ORACLE_SQL["word_information"] = r"""WITH d AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM d UNION ALL SELECT unnest(list_zip(w[:-3], w[3:])) FROM d UNION ALL SELECT unnest(list_zip(w[:-4], w[4:])) FROM d UNION ALL SELECT unnest(list_zip(w[:-5], w[5:])) FROM d),
f AS (SELECT p[1] AS a, p[2] AS b FROM e UNION ALL SELECT p[2], p[1] FROM e),
g AS (SELECT a, b, count(*) AS n FROM f GROUP BY a, b), h AS (SELECT a, sum(n)::DOUBLE AS n FROM g GROUP BY a), t AS (SELECT sum(n)::DOUBLE AS n FROM g)
SELECT g.a AS word, count(*) AS partners, round(max(ln(g.n * t.n / (x.n * y.n))), 6) AS strongest, round(sum(ln(g.n * t.n / (x.n * y.n))), 3) AS information FROM g JOIN h x ON x.a = g.a JOIN h y ON y.a = g.b, t WHERE g.n * t.n > x.n * y.n GROUP BY g.a"""


def word_information(spark: SparkSession, d: str) -> DataFrame:
    """For each word of the documents those that stand near it oftener than by chance: how many, the strongest's information and the sum of all."""
    x = vectors.word_partners(spark.read.parquet(f"{d}/documents.parquet"))
    return x.select("word", "partners", F.round("strongest", 6).alias("strongest"), F.round("information", 3).alias("information"))


def learned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all benchmark passages by words learnt from all documents."""
    words = vectors.learn_word_vectors(spark.read.parquet(f"{d}/documents.parquet"))
    return vectors.embed_learned(spark.read.parquet(f"{d}/benchmark.parquet").select("text"), words)


ORACLE_SQL["lattice_tokens"] = "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS tokens FROM part"
ORACLE_SQL["stem_tokens"] = r"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT DISTINCT w FROM e WHERE length(w) > 2), p AS (SELECT w, unnest(range(2, least(length(w), (SELECT max(length(word)) FROM k)) + 1)) AS n FROM v),
c AS (SELECT w, max(n) AS n FROM p JOIN k ON k.word = substring(w, 1, n) GROUP BY w),
x AS (SELECT doc_id, i, unnest([substring(e.w, 1, coalesce(n, length(e.w))), substring(e.w, coalesce(n, length(e.w)) + 1)]) AS t, unnest([0, 1]) AS j FROM e LEFT JOIN c ON c.w = e.w),
y AS (SELECT doc_id, i, j, regexp_replace(t, '[^''\p{L}\p{N}]', '', 'g') AS t FROM x)
SELECT d.doc_id, coalesce(count(t) FILTER (t <> ''), 0)::INTEGER AS n, md5(coalesce(string_agg(t, ' ' ORDER BY i, j) FILTER (t <> ''), '')) AS tokens FROM d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id"""


def lattice_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, written without spaces, cut into the words they were made of; words and their counts are the dictionary."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("score"))
    cut = lexicon.tokens_by(lexicon.lattice(lexicon.dictionary_of(words)))
    return part.select("p_partkey", F.array_join(X.tokens(F.replace("p_name", F.lit(" "), F.lit("")), "ja", {"ja": cut}), "|").alias("tokens"))


def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    """All documents with words cut after the longest beginning that is a word of the benchmark, as stems and endings."""
    found = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(found).alias("word")).distinct().withColumn("score", F.lit(1.0))
    cut = lexicon.tokens_by(lexicon.stems(lexicon.dictionary_of(words)))
    out = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.tokens(F.col("text"), "ko", {"ko": cut}).alias("t"))
    return out.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


QUERIES |= {f.__name__: f for f in (boundary_rules, learned_sentences, word_information, learned_vectors, lattice_tokens, stem_tokens)}
