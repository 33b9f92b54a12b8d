"""Documents from segments: ordered merges, joins of systems and references, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions.text import is_blank, segment_order, segment_prefix
from strandline.operators import boundaries


def ordered_concat(value: Column, *order: Column, separator: str = "\n") -> Column:
    """An aggregate: values in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(value, F.lit("")).alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), separator)


def ordered_list(value: Column, *order: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def merge_system(segments: DataFrame, separator: str = "\n", arrival: str = "arrival") -> DataFrame:
    """A row a document: its source and target texts in order of segment, and the first system's id."""
    order = (F.coalesce(segment_prefix(F.col("seg_id")), F.lit(2**62)), F.col(arrival))
    return segments.groupBy("doc_id").agg(F.min_by("sys_id", arrival).alias("sys_id"), ordered_concat(F.col("src"), *order, separator=separator).alias("src"), ordered_concat(F.col("tgt"), *order, separator=separator).alias("tgt"))


def merge_ref(segments: DataFrame, separator: str = "\n", arrival: str = "arrival") -> DataFrame:
    """The same of a reference, with its segments as lists and their numbers."""
    n = F.coalesce(segment_prefix(F.col("seg_id")), F.lit(2**62))
    order = (n, F.col(arrival))
    return segments.groupBy("doc_id").agg(
        F.min_by("sys_id", arrival).alias("sys_id"),
        ordered_concat(F.col("src"), *order, separator=separator).alias("src"),
        ordered_concat(F.col("tgt"), *order, separator=separator).alias("ref"),
        ordered_list(F.coalesce("src", F.lit("")), *order).alias("src_list"),
        ordered_list(F.coalesce("tgt", F.lit("")), *order).alias("ref_list"),
        ordered_list(n.cast("int"), *order).alias("src_ref_ids"),
    )


def combine(system: DataFrame, ref: DataFrame) -> DataFrame:
    """Each system document with its reference; without one the reference is empty."""
    r = ref.select("doc_id", "ref", "src_list", "ref_list", "src_ref_ids")
    return system.join(r, "doc_id", "left").withColumn("ref", F.coalesce("ref", F.lit(""))).withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in r.dtypes if t.startswith("array")})


def ref_self(ref: DataFrame) -> DataFrame:
    """A reference as its own system: the target is the reference."""
    return ref.withColumn("tgt", F.col("ref"))


def drop_empty_sources(df: DataFrame) -> DataFrame:
    """Parallel lists without the places where the source is empty; lists of unequal length raise."""
    lists = ("src_list", "ref_list", "src_ref_ids")
    same = (F.size("src_list") == F.size("ref_list")) & (F.size("src_list") == F.size("src_ref_ids"))
    z = F.filter(F.arrays_zip(*lists), lambda x: x["src_list"] != "")
    checked = F.when(same, z).otherwise(F.raise_error(F.lit("lists of unequal length")))
    df = df.withColumn("_z", checked)
    return df.withColumns({c: F.col(f"_z.{c}") for c in lists}).drop("_z")


def islands(rows: DataFrame, part: str, key: str, order: str, text: str) -> DataFrame:
    """Runs of consecutive rows of one key within each part: the distributed form."""
    w = Window.partitionBy(part).orderBy(order)
    new = F.coalesce((~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("int"), F.lit(1))
    return rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("island", F.sum("_new").over(w)).groupBy(part, "island", key).agg(F.min(order).alias("first"), F.concat(F.lit(" "), ordered_concat(F.col(text), F.col(order), separator=" ")).alias("text"))


def number_globally(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without gathering the rows: counts of ranges, then numbers within."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    return _numbered(ranged, name)


def _numbered(ranged: DataFrame, name: str) -> DataFrame:
    from strandline.operators.shared import materialised

    ranged = materialised(ranged, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_p", "_n", "_before", "_at")


def number_in_doc(df: DataFrame, *order: str | Column, name: str = "seg_id") -> DataFrame:
    """Numbers from 1 within each document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def drop_last(segments: DataFrame, n: int, order: str = "seg_id") -> tuple[DataFrame, DataFrame]:
    """Each document without its last n segments, documents that would be empty left out; and, a document, what was dropped."""
    w, place = Window.partitionBy("doc_id"), place_of(segments, order)
    ranked = segments.withColumn("_r", F.row_number().over(w.orderBy(place.desc(), F.col(order).desc()))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= n + 1)
    listed = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(order).alias("id"))))
    dropped = ranked.where(F.col("_r") <= n).groupBy("doc_id").agg(F.transform(listed, lambda x: x["id"]).alias("dropped"))
    return ranked.where(F.col("_r") > n).drop("_r", "_n"), dropped


def place_of(segments: DataFrame, order: str = "seg_id") -> Column:
    """What segments are ordered by: ids that are texts go by the number that they spell."""
    return segment_order(F.col(order)) if dict(segments.dtypes)[order] == "string" else F.col(order)


def restrict(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two sets of doc_ids are equal, and how many only one has."""
    x, y = a.select("doc_id").distinct(), b.select("doc_id").distinct()
    only = x.exceptAll(y).select(F.lit("left").alias("side")).unionByName(y.exceptAll(x).select(F.lit("right").alias("side")))
    n = only.agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))
    return n.select((F.col("only_left") + F.col("only_right") == 0).alias("equal"), "only_left", "only_right")


def zip_lines(yaml: DataFrame, src: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Segments and lines by row number; a row without a partner raises."""
    out = yaml.join(src.select("row_idx", F.col("line").alias("src")), "row_idx", "full")
    if ref is not None:
        out = out.join(ref.select("row_idx", F.col("line").alias("ref")), "row_idx", "full")
    whole = F.col("wav").isNotNull() & F.col("src").isNotNull() & (F.col("ref").isNotNull() if ref is not None else F.lit(True))
    return out.where(F.when(whole, True).otherwise(F.raise_error(F.lit("segments and lines of unequal number")).cast("boolean")))


def first_docs(yaml: DataFrame) -> DataFrame:
    """Distinct recordings in order of their first segment."""
    return yaml.groupBy("wav").agg(F.min("row_idx").alias("first"))


def yaml_to_asr(yaml: DataFrame, asr: DataFrame) -> DataFrame:
    """Transcripts of the recordings that segments name; recordings without one are left out."""
    from strandline.functions.text import doc_key

    docs = first_docs(yaml).withColumn("doc_id", doc_key(F.col("wav")))
    return docs.join(asr.withColumn("doc_id", doc_key(F.col("src"))).dropDuplicates(["doc_id"]), "doc_id")


def pair_by_stem(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Two listings of paths joined on the file's name without its ending; unmatched sources are left out."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    a = src.select(F.col("path").alias("src"), stem(F.col("path")).alias("stem"))
    b = tgt.select(F.col("path").alias("tgt"), stem(F.col("path")).alias("stem"))
    return a.join(b, "stem").select("src", "tgt")


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Each left row with the first right row of its key."""
    first = right.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return left.join(first, key)


def usable_segments(segments: DataFrame, yaml_docs: DataFrame, instances: DataFrame) -> DataFrame:
    """Segments of documents that are in the source list and have units."""
    units = instances.where(F.exists("prediction_units", lambda u: F.regexp_replace(u, r"(?U)\s+", "") != "")).select("doc_id")
    return segments.join(yaml_docs.select("doc_id").distinct(), "doc_id", "left_semi").join(units.distinct(), "doc_id", "left_semi")


def ids_to_span(segments: DataFrame, sentences: DataFrame) -> DataFrame:
    """From each segment's sentence ids (1-based, global) the span of the sentences of the same document, first start to last end.

    Ids of other documents are passed over; without any left the span is null."""
    ids = segments.select("doc_id", "seg_id", F.explode("src_ref_ids").alias("i")).withColumn("row_idx", F.col("i").cast("long") - 1)
    hit = ids.join(sentences.select("doc_id", "row_idx", "start_ms", "end_ms"), ["doc_id", "row_idx"])
    span = hit.groupBy("doc_id", "seg_id").agg(F.min_by("start_ms", "row_idx").alias("start_ms"), F.max_by("end_ms", "row_idx").alias("end_ms"))
    return segments.select("doc_id", "seg_id").join(span, ["doc_id", "seg_id"], "left")


def char_overlap(segments: DataFrame, units: DataFrame, bin_size: int = 512) -> DataFrame:
    """The units whose span overlaps each segment's, first and last, never going back behind an earlier segment's end.

    A range join inside a document: spans are dealt to the bins of text they touch, joined on (document, bin), so a long
    document isn't one task."""
    touch = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor((b - 1) / bin_size)))
    s = segments.where((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start"))).select("doc_id", "seg_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"), touch(F.col("char_start"), F.col("char_end")).alias("bin"))
    u = units.where((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start"))).select("doc_id", "unit", F.col("char_start").alias("s"), F.col("char_end").alias("e"), touch(F.col("char_start"), F.col("char_end")).alias("bin"))
    met = s.join(u, ["doc_id", "bin"]).where("s < b AND e > a").groupBy("doc_id", "seg_id").agg(F.min("unit").alias("first"), F.max("unit").alias("last"))
    before = Window.partitionBy("doc_id").orderBy(place_of(met), "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    out = met.withColumn("cursor", F.coalesce(F.max(F.col("last") + 1).over(before), F.lit(0)))
    out = out.withColumn("u_start", F.greatest("first", "cursor")).withColumn("u_end", F.col("last") + 1).where("u_end > u_start")
    return out.select("doc_id", "seg_id", "u_start", "u_end")


def sentence_offsets(docs: DataFrame, splitter: str = "line") -> DataFrame:
    """Sentences with their spans in the whole text. Paragraphs are lines, and so are the splitter "line"'s sentences.

    "learned" learns boundaries from these documents, apart by ``lang`` where there is such a column, and numbers sentences, with scans of the texts in Arrow batches; the others are plug-ins."""
    if splitter == "learned":
        known = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
        return boundaries.learned_sentences(known).withColumnRenamed("pos", "line_no")
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    if splitter == "line":
        # where a text's lines begin is counted in the text: no line is shuffled
        each = F.arrays_zip(F.split(text, "\n", -1).alias("line"), A.line_starts(text).alias("at"))
        lines = docs.select("doc_id", F.posexplode(each).alias("line_no", "l")).select("doc_id", "line_no", "l.line", "l.at")
        at = F.col("at")
        return lines.withColumn("char_start", at).withColumn("char_end", at + F.length("line")).where(~is_blank(F.col("line"))).select("doc_id", "line_no", F.col("line").alias("sentence"), "char_start", "char_end")
    from pyspark.sql.functions import pandas_udf

    from strandline import plugins

    split = plugins.get("splitter", splitter)

    @pandas_udf("array<struct<sentence:string,char_start:int,char_end:int>>")
    def cut(texts):
        def one(t):
            out, base = [], 0
            for line in (t or "").split("\n"):
                if line.strip():
                    out += [{"sentence": s, "char_start": base + a, "char_end": base + b} for s, a, b in split(line)]
                base += len(line) + 1
            return out

        return texts.map(one)

    return docs.select("doc_id", F.posexplode(cut(text)).alias("line_no", "x")).select("doc_id", "line_no", "x.*")


def within_budget(docs: DataFrame, columns: list[str], most: int, count=None) -> DataFrame:
    """Documents whose texts have so many tokens at most together; by default tokens are words."""
    n = count or (lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")))
    total = None
    for c in columns:
        total = n(F.col(c)) if total is None else total + n(F.col(c))
    return docs.withColumn("n_tokens", total).where(F.col("n_tokens") <= most)


def drop_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    n = before.agg(F.count(F.lit(1)).alias("docs")).crossJoin(after.agg(F.count(F.lit(1)).alias("kept")))  # one row each
    return n.select("docs", "kept", F.when(F.col("docs") > 0, (F.col("docs") - F.col("kept")) / F.col("docs") * 100).otherwise(0.0).alias("dropped_percent"))


def order_segments(segments: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Segments of each document in order and in one partition, ties by arrival."""
    return segments.repartition("doc_id").sortWithinPartitions("doc_id", segment_order(F.col("seg_id")), arrival)
