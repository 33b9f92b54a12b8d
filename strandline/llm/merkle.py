"""A Merkle manifest of a table: a tree of digests for each language, a tree over their roots, and proofs.

Every row becomes a leaf. Leaves are dealt out in order, so that a partition holds neighbours, and from then on nodes are
events: an event adds a child's digest, with its place, to a partial parent; when the parent has as many children as its
place in a tree of known size says (all of BRANCH, or what is left for the last one), its digest is the next event. So each
partition builds all parents that lie wholly within it and has at most a few partial ones at its two ends. Their children,
the unresolved frontier, are reshuffled by ranges of partitions that grow by FAN each round, where the same step combines them,
until every root is known. Parents met on the way leave a reverse link each, from its place to its children.

A partition's own parents are cheaper to build again than to keep, so links are stored for the others only. A proof is read by
going up from a leaf through both; each partition gets those links that lie above its first and last leaf, no others.

Rows are ranked by language and doc_id with null ids last, then by their leaf and by the file and place they were read from, so rows
that repeat are spread like any others. The text is read once; what is shuffled is a leaf a row.

Defined results: each of the five fields may be null (`-` in its leaf); rows with a null lang are a tree of their own, the
first; a tampered null text stays null, and a row with a null doc_id isn't tampered with; a tree of one leaf has that leaf as its root, and rows
that repeat are leaves of their own; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import input_bytes, written

_BITS, FAN = 3, 16
BRANCH = 1 << _BITS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Bytes of leaves in a partition.
_PART = 8 << 20


def digest(nodes: list[bytes]) -> bytes:
    """H: the sha256 of the digests' hex texts, joined."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in nodes)).digest()


@lru_cache(maxsize=4096)
def width(n: int, level: int) -> int:
    """The nodes on a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // BRANCH)
    return n


# -- leaves ------------------------------------------------------------------------------------------------------


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(fields[c]) for c in FIELDS)), 256))


def leaves(docs: DataFrame, tampers: Column | None = None) -> DataFrame:
    """doc_id, lang, digest (the leaf), altered (the leaf with the text's A-Z lower-cased, null where the row isn't tampered with or that changes
    nothing), row. ``tampers`` says of which rows; by default those of which 3 divides the crc32 of doc_id."""
    fields = {c: F.col(c) for c in FIELDS}
    if tampers is None:
        tampers = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    lower = fields | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    altered = F.when(tampers & F.col("text").rlike("[A-Z]"), leaf(lower))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(fields).alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("row"))


def dealt(nodes: DataFrame, tree: str, order: list[Column], parts: int) -> tuple[DataFrame, DataFrame]:
    """Nodes dealt out in order of tree and ``order``, with their partition ``part`` (in that order); and for each partition and tree the first and
    last place (``low``, ``high``) of its nodes in a tree of ``n``. Both are written tables."""
    rows = written(nodes.repartitionByRange(parts, F.col(tree).asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "merkle-dealt")
    count = rows.groupBy("part", tree).agg(F.count(F.lit(1)).alias("m"))
    # a row for each partition and tree in it; trees that one partition holds are windows of one row
    whole = Window.partitionBy(tree)
    count = count.withColumn("high", F.sum("m").over(whole.orderBy("part")) - 1).withColumn("low", F.col("high") - F.col("m") + 1).withColumn("n", F.sum("m").over(whole))
    return rows, written(count.drop("m"), "merkle-spans")


def numbered(rows: DataFrame, spans: DataFrame, on: str, order: list[Column]) -> DataFrame:
    """Dealt rows with tree, n and place ``at``, from the spans of their partition. Both sides have the partition as a key, so a large tree is no hot key."""
    rank = F.row_number().over(Window.partitionBy("part", on).orderBy(*order)) - 1
    known = spans.withColumnsRenamed({"part": "_part", on: "_on"}).drop("high")
    joined = rows.withColumn("at", rank).join(known, (F.col("part") == F.col("_part")) & F.col(on).eqNullSafe(F.col("_on")))
    return joined.withColumn("at", F.col("low") + F.col("at")).drop("_part", "_on", "low")


# -- combining ---------------------------------------------------------------------------------------------------


class Combiner:
    """Partial parents. Each event adds a child; a parent that has all its children is linked and becomes an event itself."""

    def __init__(self):
        self.partial: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.size: dict[int, int] = {}
        self.links: list[tuple[int, int, int, list[bytes]]] = []
        self.roots: list[tuple[int, int, int, bytes]] = []

    def add(self, tree: int, n: int, level: int, at: int, node: bytes) -> None:
        while True:
            wide = width(n, level)
            if wide == 1:
                self.roots.append((tree, n, level, node))
                return
            key = (tree, level + 1, at // BRANCH)
            children = self.partial.setdefault(key, {})
            children[at % BRANCH] = node
            if len(children) < min(BRANCH, wide - key[2] * BRANCH):
                self.size[tree] = n
                return
            del self.partial[key]
            run = [children[k] for k in range(len(children))]
            self.links.append((*key, run))
            level, at, node = level + 1, key[2], digest(run)

    def frontier(self):
        """Children of parents that miss others."""
        for (tree, level, at), children in self.partial.items():
            for k, node in children.items():
                yield tree, self.size[tree], level - 1, at * BRANCH + k, node


#: What a round of combining gives: kind 0 an unresolved node, 1 a root, 2 a link.
_EVENTS = "part int, kind int, tree long, n long, level int, at long, digest binary, children array<binary>"


def _emitted(part: int, c: Combiner, links: bool) -> pa.RecordBatch:
    rows = [(0, *x, None) for x in c.frontier()] + [(1, t, n, level, 0, d, None) for t, n, level, d in c.roots]
    if links:
        rows += [(2, t, 0, level, at, None, run) for t, level, at, run in c.links]
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *(pa.array(list(x), k) for x, k in zip(cols, kinds))], names=["part", "kind", "tree", "n", "level", "at", "digest", "children"])


def _combined(links: bool):
    """One task's step over the nodes of a range of partitions, in any order."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = Combiner()
        for batch in table.sort_by([("tree", "ascending"), ("level", "ascending"), ("at", "ascending")]).to_batches():
            for row in zip(*(batch.column(k).to_pylist() for k in ("tree", "n", "level", "at", "digest"))):
                c.add(*row)
        return pa.Table.from_batches([_emitted(key[0].as_py(), c, links)])

    return run


def _parts(spans: DataFrame) -> int:
    """The partitions that rows were in fact dealt to, which need not be as many as asked for."""
    return (spans.agg(F.max("part")).first()[0] or 0) + 1


def resolve(nodes: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """From leaf nodes (part, tree, n, level 0, at, digest): the trees' roots (tree, n, level, digest), and the links above partitions (tree, level, at,
    children). Each round FAN times fewer, larger ranges of partitions combine what the last one left open."""
    roots, links = [], []
    events = written(nodes.groupBy("part").applyInArrow(_combined(False), _EVENTS), "merkle-events")
    while True:
        roots.append(events.where("kind = 1").select("tree", "n", "level", "digest"))
        links.append(events.where("kind = 2").select("tree", "level", "at", "children"))
        if parts <= 1:
            break
        parts = -(-parts // FAN)
        open_ = events.where("kind = 0").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        events = written(open_.groupBy("part").applyInArrow(_combined(True), _EVENTS), "merkle-events")
    return _union(roots), _union(links)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# -- proofs ------------------------------------------------------------------------------------------------------


def _above(spans: DataFrame, links: DataFrame) -> DataFrame:
    """For each partition, the links above the first and the last leaf that it has of a tree."""
    up = spans.select("part", "tree", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("level"))
    ends = F.array_distinct(F.array(*(F.expr(f"shiftright({c}, {_BITS} * level)") for c in ("low", "high"))))
    return up.select("part", "tree", "level", F.explode(ends).alias("at")).join(links, ["tree", "level", "at"]).select("part", "tree", "level", "at", "children")


class Paths:
    """The paths of one partition's leaves, in order: from stored links and from the parents that the partition builds again."""

    def __init__(self, rows: pa.Table, links: pa.Table):
        self.rows = rows.sort_by([("tree", "ascending"), ("at", "ascending")])
        keys = zip(*(links.column(k).to_pylist() for k in ("tree", "level", "at")))
        self.known = dict(zip(keys, links.column("children").to_pylist()))
        c = Combiner()
        self.nodes = list(zip(*(self.rows.column(k).to_pylist() for k in ("tree", "n", "at", "digest"))))
        for tree, n, at, node in self.nodes:
            c.add(tree, n, 0, at, node)
        self.known |= {(t, level, at): run for t, level, at, run in c.links}

    def __iter__(self):
        """For each leaf, from below: its place among its parent's children, and these."""
        last, above = None, []
        for tree, n, at, _ in self.nodes:
            if n == 1:
                yield []
                continue
            if (tree, at // BRANCH) != last:
                last = tree, at // BRANCH
                above, level, place = [], 1, at // BRANCH
                while width(n, level) > 1:
                    above.append((place % BRANCH, self.known[tree, level + 1, place // BRANCH]))
                    level, place = level + 1, place // BRANCH
            yield [(at % BRANCH, self.known[tree, 1, at // BRANCH]), *above]


def folded(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of a path give."""
    for k, run in path:
        node = digest([*run[:k], node, *run[k + 1 :]])
    return node


def siblings(path: list[tuple[int, list[bytes]]]) -> list[bytes]:
    """The siblings of a path, level by level, from left to right."""
    return [x for k, run in path for j, x in enumerate(run) if j != k]


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(rows: pa.Table, links: pa.Table) -> pa.Table:
    """The rows of one partition: what their leaves, tampered with or not, fold to with their siblings. The path above a
    tree comes with the links as levels below 0, its subroot and the root as level 0."""
    paths = Paths(rows, links)
    tops: dict[int, list[tuple[int, list[bytes]]]] = {}
    for (tree, level, at), run in sorted((x for x in paths.known.items() if x[0][1] < 0), reverse=True):
        tops.setdefault(tree, []).append((at, run))
    out = []
    for (tree, _, _, leaf), altered, path in zip(paths.nodes, paths.rows.column("altered").to_pylist(), paths):
        subroot, root = paths.known[tree, 0, 0]
        path = path + tops.get(tree, [])
        fold = folded(leaf if altered is None else altered, path)
        out.append((leaf.hex(), subroot.hex(), root.hex(), digest(siblings(path)).hex(), fold.hex(), fold == root))
    cols = list(zip(*out)) if out else [[]] * 6
    kinds = [pa.string()] * 5 + [pa.bool_()]
    return pa.table([paths.rows.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _tops(rows: pa.Table, links: pa.Table) -> pa.Table:
    """Of subroots: the rows that _proved takes of each tree, with the root that the subroot folds to."""
    paths, out = Paths(rows, links), []
    for name, (_, _, at, node), path in zip(paths.rows.column("lang").to_pylist(), paths.nodes, paths):
        out.append((name, at, 0, 0, [node, folded(node, path)]))
        out += [(name, at, -1 - i, k, run) for i, (k, run) in enumerate(path)]
    cols = list(zip(*out)) if out else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["lang", "tree", "level", "at", "children"])


def manifest(docs: DataFrame, tampers: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The trees, a row each (lang, n, subroot, root), and the rows of ``docs`` with their proofs: doc_id, leaf, subroot, root, proof_sha256, folded_root
    (from the tampered leaf where the row is tampered with), verified (whether that is the root)."""
    spark = docs.sparkSession
    base = written(leaves(docs, tampers), "merkle-leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(base) // _PART)
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest").asc(), F.col("row").asc()]
    rows, spans = dealt(base, "lang", order, parts)

    # a tree over the languages, null first, in the order of their bytes; their places in it number the trees
    langs = written(spans.groupBy("lang").agg(F.max("n").alias("leaves")).withColumn("tree", F.lit(0).cast("long")), "merkle-langs")
    few, by_lang = max(1, input_bytes(langs) // _PART), [F.col("lang").asc_nulls_first()]
    ranked, top_spans = dealt(langs, "tree", by_lang, few)
    ranked = written(numbered(ranked, top_spans, "tree", by_lang), "merkle-trees")
    spans = written(_by_lang(spans, ranked.select("lang", F.col("at").alias("tree"))), "merkle-spans")

    nodes = numbered(rows, spans, "lang", order)
    roots, links = resolve(nodes.select("part", "tree", "n", F.lit(0).alias("level"), "at", "digest"), _parts(spans))
    subroots = written(ranked.join(roots.select(F.col("tree").alias("at"), "digest"), "at").select("part", "tree", "n", "at", "digest", "lang"), "merkle-subroots")
    _, top_links = resolve(subroots.select("part", "tree", "n", F.lit(0).alias("level"), "at", "digest"), _parts(top_spans))
    tops = subroots.groupBy("part").cogroup(_above(top_spans, top_links).groupBy("part")).applyInArrow(_tops, "lang string, tree long, level int, at long, children array<binary>")
    tops = written(tops, "merkle-tops")

    above = _above(spans, links).unionByName(spans.select("part", "tree").join(tops.drop("lang"), "tree").select("part", "tree", "level", "at", "children"))
    above = written(above, "merkle-above")
    proofs = nodes.select("part", "doc_id", "digest", "altered", "tree", "n", "at").groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_proved, _PROOFS)
    hexed = lambda c, i: F.lower(F.hex(c[i]))
    trees = _by_lang(langs.select("lang", F.col("leaves").alias("n")), tops.where("level = 0").select("lang", "children"))
    return trees.select("lang", "n", hexed(F.col("children"), 0).alias("subroot"), hexed(F.col("children"), 1).alias("root")), proofs


def _by_lang(rows: DataFrame, known: DataFrame) -> DataFrame:
    """An inner join on lang, null being a value."""
    return rows.join(known.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]


_H = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_LEAF = "sha256(" + " || ".join(_H.format(c) for c in FIELDS) + ")"
#: The crc32 of decimal digits, bit by bit: each digit is followed by eight shifts.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_prepend(ord(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
_UP = "SELECT f.r, f.{key}, f.level + 1, f.place // 8, sha256(string_agg(CASE WHEN n.place = f.place THEN f.d ELSE n.d END, '' ORDER BY n.place)), any_value(f.siblings) || coalesce(string_agg(n.d, '' ORDER BY n.place) FILTER (n.place <> f.place), '')"
OP11_SQL = f"""
WITH RECURSIVE base AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, row_number() OVER () AS r
    FROM (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.replace("text", f"({_LOWER})").replace("(" + _LOWER + ") IS", "text IS")} END AS altered FROM documents)),
nodes(lang, level, place, d) AS (
    SELECT lang, 0, place, leaf FROM base
    UNION ALL
    SELECT lang, level + 1, place // 8, sha256(string_agg(d, '' ORDER BY place)) FROM (SELECT *, max(place) OVER (PARTITION BY lang) AS last FROM nodes) WHERE last > 0 GROUP BY lang, level, place // 8),
sizes AS (SELECT lang, level, count(*) AS wide FROM nodes GROUP BY lang, level),
trees AS (SELECT n.lang, n.d AS subroot, row_number() OVER (ORDER BY n.lang NULLS FIRST) - 1 AS place FROM nodes n JOIN sizes s ON n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.level WHERE s.wide = 1),
upper_nodes(level, place, d) AS (
    SELECT 0, place, subroot FROM trees
    UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(d, '' ORDER BY place)) FROM (SELECT *, max(place) OVER () AS last FROM upper_nodes) WHERE last > 0 GROUP BY level, place // 8),
upper_sizes AS (SELECT level, count(*) AS wide FROM upper_nodes GROUP BY level),
lower_fold(r, lang, level, place, d, siblings) AS (
    SELECT r, lang, 0, place, coalesce(altered, leaf), '' FROM base
    UNION ALL
    {_UP.format(key="lang")}
    FROM lower_fold f JOIN sizes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.wide > 1
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM f.lang AND n.level = f.level AND n.place // 8 = f.place // 8 GROUP BY f.r, f.lang, f.level, f.place),
upper_fold(r, zero, level, place, d, siblings) AS (
    SELECT f.r, 0, 0, t.place, f.d, f.siblings FROM lower_fold f JOIN sizes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.wide = 1 JOIN trees t ON t.lang IS NOT DISTINCT FROM f.lang
    UNION ALL
    {_UP.format(key="zero")}
    FROM upper_fold f JOIN upper_sizes s ON s.level = f.level AND s.wide > 1 JOIN upper_nodes n ON n.level = f.level AND n.place // 8 = f.place // 8 GROUP BY f.r, f.zero, f.level, f.place),
root AS (SELECT d AS root FROM upper_nodes JOIN upper_sizes USING (level) WHERE wide = 1)
SELECT b.doc_id, b.leaf, t.subroot, root.root, sha256(f.siblings) AS proof_sha256, f.d AS folded_root, f.d = root.root AS verified
FROM base b JOIN trees t ON t.lang IS NOT DISTINCT FROM b.lang JOIN upper_fold f USING (r) JOIN upper_sizes s ON s.level = f.level AND s.wide = 1, root
"""
