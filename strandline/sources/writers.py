"""Sinks: JSON lines and arrays, tab-separated scores, CSV, an HTML report, alignments as text, and a run's metadata.

Tables of any size are written by Spark. Files that are one object by nature (a report, a summary, a chart) go through the driver, a row at a
time where they have many, into whatever file system their path names.
"""

from __future__ import annotations

import json
import platform
import subprocess
import sys
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import html_escape, one_decimal
from strandline.operators.sweeps import format_alignment


def jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines with nulls kept; the commit replaces what was there as a whole."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_file(spark: SparkSession, path: str, chunks: Iterable[str | bytes]) -> None:
    """One file in the file system of its path, put in place as a whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there, begun = hadoop.Path(path), hadoop.Path(f"{path}.tmp")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(begun, True)
    held, size = [], 0
    for c in chunks:
        held.append(c.encode() if isinstance(c, str) else bytes(c))
        size += len(held[-1])
        if size > 1 << 20:
            out.write(bytearray(b"".join(held)))
            held, size = [], 0
    out.write(bytearray(b"".join(held)))
    out.close()
    fs.delete(there, False)
    fs.rename(begun, there)


def write_lines(lines: DataFrame, path: str, before: str = "", after: str = "") -> None:
    """One file of a table of texts in order, each a line, between two others: tasks write its parts beside it, and their bytes go from file to file, so no
    result of a task comes to the driver."""
    spark, parts = lines.sparkSession, f"{path}.parts"
    lines.write.mode("overwrite").text(parts)
    jvm = spark._jvm
    there, begun, folder = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.tmp", parts))
    conf = spark._jsc.hadoopConfiguration()
    fs = there.getFileSystem(conf)
    out = fs.create(begun, True)
    out.write(bytearray((before + "\n").encode()))
    for name in sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")):
        part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.write(bytearray(after.encode()))
    out.close()
    fs.delete(folder, True)
    fs.delete(there, False)
    fs.rename(begun, there)


def json_pretty(df: DataFrame, path: str) -> None:
    """An indented array in one file, for people to read; rows are streamed."""

    def text():
        before = "["
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            yield before + "\n" + "\n".join("  " + x for x in json.dumps(json.loads(r[0]), ensure_ascii=False, indent=2).split("\n"))
            before = ","
        yield "[]" if before == "[" else "\n]"

    write_file(df.sparkSession, path, text())


def vectors(df: DataFrame, text_path: str, vector_path: str, order: str = "text") -> None:
    """(text, vec) as a file of lines and a flat file of 32-bit floats, in one order."""
    import numpy as np

    rows = df.orderBy(order)
    write_file(df.sparkSession, text_path, (r["text"] + "\n" for r in rows.select("text").toLocalIterator()))
    write_file(df.sparkSession, vector_path, (np.asarray(r["vec"], "<f4").tobytes() for r in rows.select("vec").toLocalIterator()))


def wav(spark: SparkSession, path: str, samples: bytes, rate: int = 8000) -> None:
    """16-bit samples of one channel as a RIFF file."""
    import struct

    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(samples))
    write_file(spark, path, [head, samples])


def scores_tsv(row: DataFrame, path: str) -> None:
    """A head and one line, tab-separated, every value with 4 places."""
    values = row.first()
    write_file(row.sparkSession, path, ["\t".join(row.columns) + "\n" + "\t".join(f"{float('nan') if v is None else v:.4f}" for v in values) + "\n"])


def offsets_csv(rows: DataFrame, path: str) -> None:
    rows.orderBy("doc_id", F.expr("try_cast(seg_id AS bigint)"), "seg_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_cards(instances: DataFrame) -> DataFrame:
    """(index, kind, html): a card for each instance."""
    cell = lambda label, c: F.concat(F.lit(f"<dt>{label}</dt><dd>"), c, F.lit("</dd>"))
    text = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    kind = F.col("null_alignment_type")
    html = F.concat(
        F.lit("<article class='card' data-kind='"), kind, F.lit("'><h3>"), html_escape(F.col("doc_id")), F.lit(" #"), html_escape(F.col("seg_id").cast("string")), F.lit("</h3><dl>"),
        cell("Source", text("src")), cell("Target", text("mt")), cell("Reference", text("ref")), cell("First offset", one_decimal(F.col("first_offset"))), cell("End offset", one_decimal(F.col("end_offset"))), F.lit("</dl></article>"),
    )
    return instances.select("index", kind.alias("kind"), html.alias("html"))


def html_report(cards: DataFrame, path: str) -> None:
    """Cards in order under tabs that filter by kind, with counts. Tasks write the cards."""
    counts = {r["kind"]: r["count"] for r in cards.groupBy("kind").count().collect()}  # kinds are three
    tabs = [("all", sum(counts.values())), *((k, counts.get(k, 0)) for k in ("normal", "under_translation", "over_translation"))]
    script = "document.querySelectorAll('[data-filter]').forEach(b=>b.onclick=()=>document.querySelectorAll('.card').forEach(c=>c.hidden=b.dataset.filter!='all'&&c.dataset.kind!=b.dataset.filter))"

    head = "<!doctype html><meta charset='utf-8'><title>Segments</title><nav>" + "".join(f"<button data-filter='{k}'>{k} ({n})</button>" for k, n in tabs) + "</nav><main>"
    write_lines(cards.orderBy("index").select("html"), path, head, f"</main><script>{script}</script>")


def histogram_svg(bins: DataFrame, path: str, width: int = 720, height: int = 240) -> None:
    """Bars of (bin, low, n) as an SVG picture. Bins are few."""
    rows = bins.orderBy("bin").collect()
    most, each = max([r["n"] for r in rows] or [1]) or 1, width / max(1, len(rows))
    bars = (f"<rect x='{i * each:.1f}' y='{height - r['n'] / most * height:.1f}' width='{each - 1:.1f}' height='{r['n'] / most * height:.1f}'><title>{r['low']:g}: {r['n']}</title></rect>" for i, r in enumerate(rows))
    write_file(bins.sparkSession, path, [f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {width} {height}'>", *bars, "</svg>"])


def gap_svg(offsets: DataFrame, path: str, width: int = 720, height: int = 240) -> None:
    """A line a document of the gaps (scores.offset_rows) over its segments, in order. The points are drawn as columns; lines are streamed."""
    from strandline.functions.text import segment_order

    span = offsets.agg(F.min("gap").alias("a"), F.max("gap").alias("b")).first()
    low, high = span["a"] or 0.0, (span["b"] or 0.0) if span["b"] != span["a"] else (span["b"] or 0.0) + 1
    y = F.format_string("%.1f", (F.lit(float(high)) - F.col("gap")) / F.lit(float(high - low)) * height)
    listed = F.array_sort(F.collect_list(F.struct(segment_order(F.col("seg_id").cast("string")).alias("o"), y.alias("y"))))
    x = lambda i, n: F.format_string("%.1f", i * F.lit(float(width)) / F.greatest(n - 1, F.lit(1)))
    lines = offsets.where("gap IS NOT NULL").groupBy("doc_id").agg(listed.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda r, i: F.concat(x(i, F.size("p")), F.lit(","), r["y"])), " ").alias("points"))
    drawn = (f"<polyline fill='none' stroke='black' points='{r['points']}'><title>{r['doc_id']}</title></polyline>" for r in lines.orderBy("doc_id").toLocalIterator())
    write_file(offsets.sparkSession, path, (c for part in ([f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {width} {height}'>"], drawn, ["</svg>"]) for c in part))


def alignments_text(alignments: DataFrame, path: str, with_cost: bool = True, texts: bool = False) -> None:
    """A folder of text files a document, whose lines are in order from file to file. With ``texts`` each alignment has its source's and target's text
    (columns src, tgt) on lines of their own. Tasks take ranges of lines, so a long document is several files."""
    line = format_alignment(F.col("src_idx"), F.col("tgt_idx"), F.col("cost") if with_cost else None)
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " "))
    more = [F.concat(F.lit(" " * 41 + f"{name}:  "), clean(F.col(c))) for name, c in (("SRC", "src"), ("TGT", "tgt"))] if texts else []
    place = ["doc_id", "aln_idx", "_at"]  # with one that tells alike ones apart, as ranges of equal keys can't be cut
    alignments.withColumn("_at", F.xxhash64("src_idx", "tgt_idx", F.rand(0))).repartitionByRange(*place).sortWithinPartitions(*place).select(F.concat_ws("\n", line, *more).alias("value"), "doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)


def drop_log(dropped: DataFrame, path: str) -> None:
    """`doc: id, id` for each document."""
    dropped.select(F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.array_join(F.col("dropped").cast("array<string>"), ", ")).alias("value")).write.mode("overwrite").text(path)


#: Settings that a run's metadata tells; others may hold credentials.
SHOWN = ("spark.app.id", "spark.app.name", "spark.master", "spark.submit.deployMode", "spark.executor.memory", "spark.executor.cores", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")


def _run(*command: str) -> str | None:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def run_metadata(spark: SparkSession, config: dict, started: datetime, status: str = "ok", error: str | None = None) -> dict:
    from importlib import metadata

    now = datetime.now(timezone.utc)
    version = lambda p: next((metadata.version(p) for _ in [0] if _known(metadata, p)), None)
    return {
        "status": status, "started": started.isoformat(), "ended": now.isoformat(), "elapsed_sec": round((now - started).total_seconds(), 3), "host": platform.node(), "python": sys.version.split()[0],
        "spark": spark.version, "packages": {p: version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}, "git": {"commit": _run("git", "rev-parse", "HEAD"), "dirty": bool(_run("git", "status", "--porcelain"))},
        "gpu": _run("nvidia-smi", "-L"), "config": config, "argv": sys.argv, "error": error, "spark_conf": {k: v for k, v in spark.sparkContext.getConf().getAll() if k in SHOWN},
    }


def _known(metadata, name: str) -> bool:
    try:
        metadata.version(name)
        return True
    except metadata.PackageNotFoundError:
        return False


def write_run_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    write_file(spark, path, [json.dumps(meta, ensure_ascii=False, indent=2, default=str)])
