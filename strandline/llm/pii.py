"""Personal data and the terms that disclose it, with DataFrame functions only.

Base: e-mail addresses, IP addresses, payment card numbers and phone numbers, by pattern and check; added to these are
secrets (values of 16 characters or more, with a digit, given to a token, key or password). They are the protected
entities. The corpus then tells how strongly other terms reveal them (information-theoretic sanitisation):
for a term t near an entity e, the disclosure is the part of all of t's occurrences that lie near e, and the
information is log2 P(t, e) / P(t) P(e) in bits. A term whose disclosure and information reach the thresholds, in
enough different surroundings, is as good as the entity itself: all its spans in all texts are added (kind ``term``) and
sanitise() generalises or removes them together with the others. What is near only tells what discloses.

Counts cover all documents: terms are counted with partial aggregation, entities by (entity, term). Within a document work is
linear in its length and its number of entities: running sums go by chunks, contexts are cut from blocks of the
text, and terms are held against other spans by a join on (document, cell of the text), one row a term. Copies of one
passage are one surrounding, so copying alone discloses nothing.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; within one kind spans don't
overlap, between kinds they may; rows that repeat a doc_id are answered by their own texts, equal rows alike; other columns of any
name stay; a null doc_id is an id of its own; an empty table gives none; a text of any length, and any number of entities, is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import free_name, written

KINDS = ("email", "ip", "card", "phone")
#: What find() adds to the base kinds, numbered on.
MORE = ("secret", "term")
SECRET_KIND, TERM_KIND = len(KINDS), len(KINDS) + 1
#: Terms are looked for so many code points around an entity.
REACH = 80
DISCLOSURE, BITS, SURROUNDINGS = 0.5, 8.0, 2
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Texts are cut into blocks of so many code points; terms and spans meet in cells of so many.
BLOCK, CELL = 1024, 256
#: Running sums go by chunks of so many elements.
CHUNK = 256

# The base patterns, in forms that Java matches without recursion and in linear time. A match begins where a run of
# the first class begins, or where the match before it ended: elsewhere inside a run the leftmost match has begun
# earlier.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Separators that don't stand between two digits; once they are masked, cards are plain runs.
_LOOSE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
_CARD = r"[0-9][0-9\x20-]+"
_CARD_LIKELY = r"[0-9][0-9\x20-]{11,}[0-9]"
#: The name of a secret, a sign, and its value (the last group).
SECRET = r"""(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)["']?[\x20\x09]{0,3}[:=][\x20\x09]{0,3}["']?([A-Za-z0-9+/_.=-]{16,})"""
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _running(x: Column, zero: Column, op) -> Column:
    """For each element the sum (by op) of all before it: by chunks, so no array is copied for each element."""

    def fold(part, out):
        kind = F.array().cast("array<int>")
        return F.aggregate(part, F.struct(zero.alias("at"), kind.alias("out")), lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), out)

    def whole(all_):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)), lambda acc: acc))
        put = lambda parts: F.flatten(F.zip_with(parts, fold(F.transform(parts, lambda p: p["at"]), lambda acc: acc["out"]), lambda p, before: F.transform(p["out"], lambda v: op(before, v))))
        return F.when(F.size(all_) > 0, _let(chunks, put)).otherwise(F.array().cast("array<int>"))

    return _let(x, whole)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, as (start, end, value), from the pieces between them."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(z):
        before = _running(F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["value"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(z, before, lambda x, n: F.struct((n + F.length(x["gap"])).alias("start"), (n + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    found = _let(F.arrays_zip(values.alias("value"), gaps.alias("gap")), lambda z: placed(F.slice(z, 1, F.size(z) - 1)))  # there is a gap more than values
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digits' sum is a multiple of ten."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.element_at(d, i).cast("int") + 1 + F.when(i % 2 == 0, 10).otherwise(0)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, its valid spans. Cheap tests come first, so most texts meet no pattern at all."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    email = F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL)).otherwise(none)
    octets = lambda v: F.forall(F.split(v, r"\."), lambda o: F.length(F.regexp_replace(o, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(v, r"\."), lambda o: F.substring(F.regexp_replace(o, "^0+(?=[0-9])", ""), 1, 4).cast("int") <= 255)
    ip = F.when(text.rlike(_IP), F.filter(matches(text, _IP), lambda m: octets(m["value"]))).otherwise(none)
    masked = F.regexp_replace(text, _LOOSE, "\u0001")
    card_ok = lambda m: F.when(F.length(_digits(m["value"])).between(13, 19), _luhn(_digits(m["value"]))).otherwise(False)
    card = F.when(text.rlike(_CARD_LIKELY), F.filter(matches(masked, _CARD), card_ok)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, _PHONE), lambda m: F.length(_digits(m["value"])).between(9, 15))).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def secret_spans(text: Column) -> Column:
    """The values of secrets."""
    value = lambda m: F.regexp_extract(m["value"], SECRET, 1)
    spans = F.transform(matches(text, SECRET), lambda m: F.struct((m["end"] - F.length(value(m))).alias("start"), m["end"].alias("end"), value(m).alias("value")))
    return F.when(text.rlike(SECRET), F.filter(spans, lambda m: m["value"].rlike("[0-9]"))).otherwise(F.array().cast(_SPAN))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, n: Column) -> Column:
    """n code points from start on, from the blocks that hold them."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.least(F.floor((start + n) / BLOCK).cast("int"), F.size(blocks) - 1)
    return F.when((n <= 0) | (first >= F.size(blocks)), F.lit("")).otherwise(F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, n))


def _near(blocks: Column, length: Column, span: Column) -> Column:
    """What stands around one span, without the words that the reach cuts."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    left = _cut(blocks, begin, span["start"] - begin)
    left = F.when(begin > 0, F.regexp_replace(left, r"^[^\x20\x09-\x0D]+", "")).otherwise(left)
    right = _cut(blocks, span["end"], F.least(F.lit(REACH), length - span["end"]))
    right = F.when(length > span["end"] + REACH, F.regexp_replace(right, r"[^\x20\x09-\x0D]+$", "")).otherwise(right)
    return F.struct(F.concat_ws(":", span["kind"], span["value"]).alias("entity"), span["start"].alias("start"), span["end"].alias("end"), left.alias("left"), right.alias("right"))


def _outside(places: DataFrame, base: DataFrame) -> DataFrame:
    """Of (key, start, end, ...) those that overlap no span of the same document. A span is entered in every cell in which a term that overlaps it may begin."""
    s = base.select("key", F.explode("base").alias("s")).select(F.col("key").alias("_k"), F.col("s.start").alias("_a"), F.col("s.end").alias("_b"))
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.greatest(F.col("_a") - REACH, F.lit(0)) / CELL), F.floor((F.col("_b") - 1) / CELL))))
    meets = (F.col("key") == F.col("_k")) & (F.floor(F.col("start") / CELL) == F.col("_cell")) & (F.col("_a") < F.col("end")) & (F.col("_b") > F.col("start"))
    return places.join(s, meets, "left_anti")


def _everywhere(docs: DataFrame, key: Column, text: Column, base: DataFrame, telling: DataFrame) -> DataFrame:
    """key, start, end of every occurrence of the telling terms outside other spans. Places are looked for only in texts that hold one."""
    terms = written(telling.select("term").distinct(), "pii-telling")
    held = docs.select(key.alias("key"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))).alias("term"))
    held = written(held.join(terms, "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "pii-held")
    texts = docs.select(key.alias("key"), text.alias("_t")).join(held, "key").dropDuplicates(["key"])  # equal keys have equal texts
    spans = F.filter(matches(F.col("_t"), TERM), lambda m: F.array_contains("terms", F.lower(m["value"])))
    return _outside(texts.select("key", F.explode(spans).alias("t")).select("key", "t.start", "t.end"), base)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, bits: float = BITS, surroundings: int = SURROUNDINGS) -> DataFrame:
    """doc_id, text_hash and ``spans``: (kind number from 0, start, end), sorted; secrets have number 4, terms 5."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text"))
    kinds = base_spans(text) | {"secret": secret_spans(text)}
    tag = lambda i: lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))
    tagged = [F.transform(F.col(f"_{k}"), tag(i)) for i, k in enumerate(kinds)]
    base = docs.select(key.alias("key"), text.alias("_t"), *(c.alias(f"_{k}") for k, c in kinds.items()))
    base = base.select("key", "_t", F.concat(*tagged).alias("base"))
    around = lambda x: F.transform("base", lambda s: _near(x["blocks"], x["n"], s))
    near = F.when(F.size("base") > 0, _let(F.struct(blocks_of(F.col("_t")).alias("blocks"), F.length("_t").alias("n")), around))
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = written(base.select("key", bare.alias("bare"), near.alias("near")).withColumnRenamed("bare", "base"), "pii-base")
    # terms near entities, but not those inside another span
    at = base.where("near IS NOT NULL").select("key", F.explode("near").alias("e")).select("key", "e.*")
    place = lambda side, shift: F.transform(matches(F.col(side), TERM), lambda m: F.struct((m["start"] + shift).alias("start"), (m["end"] + shift).alias("end"), F.lower(m["value"]).alias("term")))
    found = F.concat(place("left", F.col("start") - F.length("left")), place("right", F.col("end")))
    at = at.select("key", "entity", F.xxhash64("left", "right").alias("around"), F.explode(found).alias("t")).select("key", "entity", "around", "t.start", "t.end", "t.term")
    at = written(_outside(at, base), "pii-near")
    pairs = at.groupBy("entity", "term", "around").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("seen"))
    of_entity = at.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    likely = pairs.where(F.col("seen") >= surroundings)
    counts = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("n_term"))
    counts = written(counts, "pii-terms")
    total = counts.agg(F.sum("n_term")).first()[0] or 0  # one number
    weighed = likely.join(counts, "term").where(F.col("both") >= F.col("n_term") * disclosure).join(of_entity, "entity")
    information = F.log2(F.col("both").cast("double") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    telling = written(weighed.where(information >= bits).select("entity", "term"), "pii-pairs")
    marked = at.join(telling, ["entity", "term"], "left_semi").select("key", "start", "end").unionByName(_everywhere(docs, key, text, base, telling))
    kind = "array<struct<kind:int,start:int,end:int>>"
    added = marked.groupBy("key").agg(F.collect_set(F.struct(F.lit(TERM_KIND).alias("kind"), "start", "end")).alias("added"))
    out = base.select("key", "base").join(added, "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(kind))))
    return out.select(F.col("key.id").alias("doc_id"), F.col("key.text").alias("text_hash"), spans.alias("spans"))


def _listed(spans: Column, names=(*KINDS, *MORE)) -> Column:
    known = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(known, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, generalise: bool = True, **thresholds) -> DataFrame:
    """All columns of the documents, the text without its spans (each replaced by <KIND>, or with generalise=False
    removed; of overlapping spans the first by start takes all), and the spans found."""
    found = find(docs, **thresholds).dropDuplicates(["doc_id", "text_hash"])
    key, h, spans, other, x = (free_name(docs, c) for c in ("_id", "_h", "spans", "_other", "_x"))
    known = F.array(*[F.lit(f"<{x.upper()}>" if generalise else "") for x in (*KINDS, *MORE)])
    text = F.coalesce("text", F.lit(""))
    by_start = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    ended = lambda z: _running(F.transform(z, lambda s: -s["last"]), F.lit(0), F.greatest)
    heads = lambda z: F.filter(F.zip_with(z, ended(z), lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("from"))), lambda s: s["start"] >= s["from"])

    def joined_up(v):
        pieces = F.transform(heads(v["z"]), lambda s: F.concat(_cut(v["blocks"], s["from"], s["start"] - s["from"]), F.element_at(known, s["kind"] + 1)))
        last = F.array_max(F.transform(v["z"], lambda s: -s["last"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    cut = _let(F.struct(by_start.alias("z"), blocks_of(text).alias("blocks")), joined_up)
    joined = docs.withColumns({key: F.col("doc_id").cast("long"), h: F.xxhash64(text)}).join(found.select(F.col("doc_id").alias(other), F.col("text_hash").alias(x), F.col("spans").alias(spans)), F.col(key).eqNullSafe(F.col(other)) & (F.col(h) == F.col(x)), "left")
    return joined.select(*(F.when(F.size(spans) > 0, cut).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns), spans)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        *(n(len(KINDS) + i).alias(f"n_{k}") for i, k in enumerate(MORE)), F.size("spans").cast("long").alias("n_spans"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pat(kind, re) AS (VALUES (0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, '[0-9]([\x20-]?[0-9])+'), (3, '\+[0-9][\x20().0-9-]+[0-9]'), (4, '{SECRET}')),
m AS (SELECT doc_id, t, kind, regexp_extract_all(t, re) AS v, string_split_regex(t, re) AS g FROM d, pat),
s0 AS (SELECT doc_id, t, kind, unnest(range(1, len(v) + 1)) AS i, v, g FROM m WHERE len(v) > 0),
s1 AS (SELECT doc_id, t, kind, v[i] AS value, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::INTEGER AS a FROM s0),
s2 AS (SELECT doc_id, t, kind, CASE kind WHEN 4 THEN regexp_extract(value, '{SECRET}', 1) ELSE value END AS value, CASE kind WHEN 4 THEN a + length(value) - length(regexp_extract(value, '{SECRET}', 1)) ELSE a END::INTEGER AS a, a + length(value) AS b, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM s1),
s AS (SELECT doc_id, t, kind, value, a, b FROM s2 WHERE CASE kind WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(try_cast(ltrim(o, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(reverse(digits), k, 1)::INTEGER WHEN substr(reverse(digits), k, 1)::INTEGER > 4 THEN 2 * substr(reverse(digits), k, 1)::INTEGER - 9 ELSE 2 * substr(reverse(digits), k, 1)::INTEGER END)) % 10 = 0
  WHEN 4 THEN regexp_matches(value, '[0-9]') ELSE length(digits) BETWEEN 9 AND 15 END),
c0 AS (SELECT doc_id, kind || ':' || value AS entity, greatest(a - 80, 0) AS from_, a, b, substr(t, greatest(a - 80, 0) + 1, a - greatest(a - 80, 0)) AS l, substr(t, b + 1, 80) AS r, length(t) AS n FROM s),
c1 AS (SELECT doc_id, entity, a, b, CASE WHEN from_ > 0 THEN regexp_replace(l, '^[^\x20\x09-\x0D]+', '') ELSE l END AS l, CASE WHEN n > b + 80 THEN regexp_replace(r, '[^\x20\x09-\x0D]+$', '') ELSE r END AS r FROM c0),
c2 AS (SELECT doc_id, entity, l || chr(1) || r AS around, l AS w, a - length(l) AS shift FROM c1 UNION ALL SELECT doc_id, entity, l || chr(1) || r, r, b FROM c1),
c3 AS (SELECT doc_id, entity, around, shift, regexp_extract_all(w, '\p{L}[\p{L}\p{N}]{2,}') AS v, string_split_regex(w, '\p{L}[\p{L}\p{N}]{2,}') AS g FROM c2),
c4 AS (SELECT doc_id, entity, around, shift, unnest(range(1, len(v) + 1)) AS i, v, g FROM c3 WHERE len(v) > 0),
c5 AS (SELECT doc_id, entity, around, lower(v[i]) AS term, shift + (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::INTEGER AS a, length(v[i]) AS n FROM c4),
near AS (SELECT doc_id, entity, around, term, a, a + n AS b FROM c5 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = c5.doc_id AND s.a < c5.a + n AND s.b > c5.a)),
pairs AS (SELECT entity, term, count(*) AS both_, count(DISTINCT around) AS seen FROM near GROUP BY ALL),
ents AS (SELECT entity, count(*) AS n_entity FROM near GROUP BY entity),
terms AS (SELECT lower(term) AS term, count(*) AS n_term FROM (SELECT unnest(regexp_extract_all(t, '\p{L}[\p{L}\p{N}]{2,}')) AS term FROM d) GROUP BY 1),
telling AS (SELECT entity, term FROM pairs JOIN ents USING (entity) JOIN terms USING (term) WHERE seen >= 2 AND both_ >= 0.5 * n_term AND log2(both_::DOUBLE * (SELECT sum(n_term) FROM terms) / (n_term * n_entity)) >= 8),
told AS (SELECT list(DISTINCT term) AS terms FROM telling),
w0 AS (SELECT doc_id, regexp_extract_all(t, '\p{L}[\p{L}\p{N}]{2,}') AS v, string_split_regex(t, '\p{L}[\p{L}\p{N}]{2,}') AS g FROM d),
w1 AS (SELECT doc_id, v, g, unnest(list_filter(range(1, len(v) + 1), lambda k: list_contains(terms, lower(v[k])))) AS i FROM w0, told),
w2 AS (SELECT doc_id, length(v[i]) AS n, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::INTEGER AS a FROM w1),
whole AS (SELECT doc_id, a, a + n AS b FROM w2 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = w2.doc_id AND s.a < w2.a + w2.n AND s.b > w2.a)),
marked AS (SELECT doc_id, a, b FROM near JOIN telling USING (entity, term) UNION SELECT doc_id, a, b FROM whole),
all_ AS (SELECT doc_id, kind, a, b FROM s UNION ALL SELECT doc_id, 5, a, b FROM marked),
o AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone, count(*) FILTER (WHERE kind = 4) AS n_secret, count(*) FILTER (WHERE kind = 5) AS n_term, count(*) AS n_spans,
  string_agg((['email', 'ip', 'card', 'phone', 'secret', 'term'])[kind + 1] || ':' || a || ':' || b, ',' ORDER BY kind, a, b) AS spans,
  string_agg((['email', 'ip', 'card', 'phone', 'secret', 'term'])[kind + 1] || ':' || a || ':' || b, ',' ORDER BY kind, a, b) FILTER (WHERE kind < 4) AS base FROM all_ GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_secret, 0) AS n_secret, coalesce(n_term, 0) AS n_term, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN o USING (doc_id)
""".replace("{SECRET}", SECRET.replace("'", "''"))
