"""Perturbed data sets: sampled merges and drops, carried over to other systems' segments, and ablation scenarios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.documents import ordered_concat


def _draw(*keys: str, seed: int) -> F.Column:
    """A random-looking order of rows, the same in every run and engine: digests of the keys as text."""
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def sample(segments: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of the segments of documents with more than one, one at least: those of the smallest digests, so reruns agree.

    Digests are counted in bins of their first four digits (65,536 rows at most); bins before the last one are taken whole, and only
    the last one is put in order."""
    many = segments.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("_n > 1").drop("_n").withColumn("_h", _draw("doc_id", "seg_id", seed=seed))
    many = many.withColumn("_bin", F.substring("_h", 1, 4))
    counts = sorted((r["_bin"], r["n"]) for r in many.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    left = max(1, -(-int(round(share * n * 1_000_000)) // 1_000_000)) if n else 0
    last = ""
    for last, c in counts:  # noqa: B007
        if c >= left:
            break
        left -= c
    whole = many.where(F.col("_bin") < last)
    return whole.unionByName(many.where(F.col("_bin") == last).orderBy("_h", "doc_id", "seg_id").limit(left)).drop("_h", "_bin")


def sample_merges(segments: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """For each document disjoint pairs of neighbours (first, second), a share of its segments, by hash rank; no pair touches another."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_no")
        ids, rank = pdf["seg_no"].tolist(), pdf["_h"].tolist()
        want, used, out = -(-len(ids) * int(share * 1_000_000) // 1_000_000), set(), []
        for i in sorted(range(1, len(ids) - 1), key=lambda k: rank[k]):
            if len(out) >= want:
                break
            if i not in used and i + 1 not in used and i + 1 < len(ids):
                used |= {i, i + 1}
                out.append((pdf["doc_id"].iloc[0], ids[i], ids[i + 1]))
        return pd.DataFrame(out, columns=["doc_id", "first", "second"])

    rows = segments.select("doc_id", F.col("seg_id").cast("long").alias("seg_no"), _draw("doc_id", "seg_id", seed=seed).alias("_h"))
    return rows.groupBy("doc_id").applyInPandas(pick, f"doc_id {dict(segments.dtypes)['doc_id']}, first long, second long")


def merge_pairs(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Segments with each pair as one: its id is first_second, its texts are joined by a space."""
    member = pairs.select("doc_id", F.col("first").alias("seg_id"), "first", "second").unionByName(pairs.select("doc_id", F.col("second").alias("seg_id"), "first", "second"))
    s = segments.withColumn("seg_id", F.col("seg_id").cast("long")).join(member, ["doc_id", "seg_id"], "left")
    group = F.coalesce("first", "seg_id")
    out = s.groupBy("doc_id", group.alias("_g")).agg(F.max("second").alias("_second"), ordered_concat(F.col("src"), F.col("seg_id"), separator=" ").alias("src"), ordered_concat(F.col("tgt"), F.col("seg_id"), separator=" ").alias("tgt"))
    return out.select("doc_id", F.when(F.col("_second").isNull(), F.col("_g").cast("string")).otherwise(F.concat_ws("_", "_g", "_second")).alias("seg_id"), "src", "tgt")


def propagate_merges(merged: DataFrame, other: DataFrame) -> DataFrame:
    """Another system's segments after merges: each part of a merged segment gets its source and the parts' targets joined in
    order; sources of all others follow too."""
    parts = merged.select("doc_id", F.col("src").alias("new_src"), F.col("seg_id").alias("_whole"), F.posexplode(F.split("seg_id", "_")).alias("_p", "seg_id"))
    hit = other.join(parts, ["doc_id", "seg_id"], "left")
    joined = hit.where("_whole IS NOT NULL").groupBy("doc_id", "_whole").agg(ordered_concat(F.col("tgt"), F.col("_p"), separator=" ").alias("_tgt"))
    out = hit.join(joined, ["doc_id", "_whole"], "left")
    split = F.contains("_whole", F.lit("_"))
    return out.select("doc_id", "seg_id", F.coalesce("new_src", "src").alias("src"), F.when(F.coalesce(split, F.lit(False)), F.col("_tgt")).otherwise(F.col("tgt")).alias("tgt"))


def propagate_drops(dropped: DataFrame, other: DataFrame, side: str = "src") -> DataFrame:
    """Another system's segments with both texts empty where the changed one's ``side`` is."""
    gone = dropped.where(F.col(side) == "").select("doc_id", "seg_id", F.lit(True).alias("_gone")).distinct()
    gone_here = F.coalesce("_gone", F.lit(False))
    out = other.join(gone, ["doc_id", "seg_id"], "left")
    return out.withColumns({c: F.when(gone_here, "").otherwise(F.col(c)) for c in ("src", "tgt")}).drop("_gone")


def recombine(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of merged sources with those of merged targets, of the ids that both have."""
    return sources.select("doc_id", "src").join(targets.select("doc_id", "tgt"), "doc_id")
