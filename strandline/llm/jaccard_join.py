"""N-gram Jaccard join by chosen paths.

Texts are sets of their WORDS-word shingles; two are linked if their Jaccard similarity is SIMILARITY or more. Each set
is embedded as a signature of minhash tokens (place, value). A run splits the sets on a token that they share, and a
bucket that is still large is split again on tokens sampled for it, so a pair goes down the same path with a chance
that grows with its similarity. Small buckets, and those of the last level, are compared by brute force. Runs are
repeated until the pairs at the threshold are met with TARGET recall.

What meets in buckets makes groups; within a group all pairs are then compared by their whole sets, in blocks of
bounded size, so a group has exact links, also those that no run met. Equal word sequences are one class from
the start. Buckets and groups give one row a member (stars and counts), never one a pair.

Result: a row for each document: ``class_id`` (the smallest doc_id that is linked to it, directly or not; of its equals
at least), ``class_node`` (the class itself, as ids may repeat) and ``n_links`` (how many other documents are linked to it directly, copies included).

Defined results: texts of 1 to WORDS - 1 words have one shingle, all their words; texts without words, and nulls, are
linked to none and are their own class; rows that repeat a doc_id are documents of their own; a null doc_id is the
largest; other columns, whatever their names, aren't looked at; a text of any length is taken whole. Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordscan as ws
from strandline.llm.common import docs_of, written
from strandline.llm.components import components

WORDS, SIMILARITY, TARGET = 5, 0.8, 0.9999
TOKENS = 64
#: Buckets of more sets than this are split again, LEVELS times in all; comparisons are in blocks of so many sets.
SMALL, LEVELS, BLOCK, EXACT_BLOCK = 64, 3, 1024, 256
#: Each bucket's sets are counted and joined in up to so many shares.
SHARES = 256
_NULL = 2**63 - 1


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = ws.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def shingles(words: ws.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and for each text the range of its own."""
    at, window = words.windows(size)
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ranges = np.append(0, np.cumsum(n))
    out = np.empty(ranges[-1], np.uint64)
    short = (counts > 0) & (counts < size)
    full = np.repeat(counts >= size, n)
    out[full] = window
    if short.any():
        out[ranges[:-1][short]] = sequence_hashes(words)[short]
    return out, ranges


def sequence_hashes(words: ws.Words) -> np.ndarray:
    """A hash of each text's words in order."""
    place = np.arange(len(words.hash)) - np.repeat(words.range[:-1], words.counts)
    total = np.append(np.uint64(0), np.cumsum(ws.mix(words.hash + ws.mix(place.astype(np.uint64) + np.uint64(7))), dtype=np.uint64))
    return ws.mix(total[words.range[1:]] - total[words.range[:-1]] + words.counts.astype(np.uint64))


def signatures(hashed: np.ndarray, ranges: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """For each text the smallest of its hashes under each of so many permutations; zeros for a text without any."""
    a, b = _coefficients(tokens)
    full = np.flatnonzero(np.diff(ranges))
    out = np.zeros((len(ranges) - 1, tokens), np.uint32)
    if not len(full):
        return out
    begin = ranges[full]
    step = max(1, 1 + int(np.searchsorted(begin, begin[0] + 65536)))
    for i in range(0, len(full), step):  # a stretch that stays in the processor's cache
        lo, hi = begin[i], ranges[full[min(i + step, len(full)) - 1] + 1]
        part, cuts = hashed[lo:hi], begin[i : i + step] - lo
        for k in range(tokens):
            out[full[i : i + step], k] = np.minimum.reduceat((part * a[k] + b[k]) >> np.uint64(32), cuts)
    return out


def _sign(size: int):
    def run(batches):
        for batch in batches:
            for part in ws.slices(batch):
                words = ws.Words(part.column("text"))
                sig = signatures(*shingles(words, size))
                node = sequence_hashes(words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node), pa.array(words.counts > 0), ws.pack(sig.ravel(), np.arange(len(sig) + 1) * TOKENS)], names=["doc_id", "text_hash", "node", "full", "sig"])

    return run


def _sigs(column) -> np.ndarray:
    return ws.unpack(column, np.uint32)[0].reshape(-1, TOKENS)


def _roots(runs: int):
    """The first level: in run r all sets are split on token r."""

    def run(batches):
        for batch in batches:
            sig = _sigs(batch.column("sig"))
            node = batch.column("node").to_numpy()
            salt = ws.mix(np.arange(runs, dtype=np.uint64) + np.uint64(1000))
            bucket = ws.mix(sig[:, :runs].astype(np.uint64) + salt)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array(np.repeat(node, runs))], names=["bucket", "node"])

    return run


def _branch(batches):
    """A further level: a bucket samples one or two of the tokens, 1.25 on average, and is split on the values there."""
    for batch in batches:
        sig = _sigs(batch.column("sig"))
        node, bucket = batch.column("node").to_numpy(), batch.column("bucket").to_numpy().view(np.uint64)
        draw = ws.mix(bucket + np.uint64(5))
        first = (draw % np.uint64(TOKENS)).astype(np.int64)
        second = (first + 1 + (draw >> np.uint64(16)) % np.uint64(TOKENS - 1)).astype(np.int64) % TOKENS
        two = (draw >> np.uint64(40)) % np.uint64(4) == 0
        row = np.append(np.arange(len(node)), np.flatnonzero(two))
        token = np.append(first, second[two])
        child = ws.mix(ws.mix(bucket[row] + token.astype(np.uint64)) + sig[row, token])
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[row])], names=["bucket", "node"])


def agreeing(similarity: float) -> int:
    """Pairs are kept whose signatures agree in so many tokens: 4.2 standard deviations below the mean at the threshold."""
    return math.floor(TOKENS * similarity - 4.2 * math.sqrt(TOKENS * similarity * (1 - similarity)))


def missed(runs: int, similarity: float, levels: int) -> float:
    """The chance that a pair at the threshold is missed. All runs draw from the same tokens, so it is averaged over how many of
    them agree (a): run r's first level keeps the pair if token r agrees, each further one with 0.75 p + 0.25 (1 - q), where p
    is a's share and q the chance that neither of two tokens agrees."""
    n, s, out = TOKENS, similarity, 0.0
    for a in range(n + 1):
        deeper = (0.75 * a / n + 0.25 * (1 - (n - a) * (n - a - 1) / (n * (n - 1)))) ** (levels - 1)
        lost = 1.0 if a < agreeing(s) else sum(math.comb(a, k) * math.comb(n - a, runs - k) / math.comb(n, runs) * (1 - deeper) ** k for k in range(runs + 1))
        out += math.comb(n, a) * s**a * (1 - s) ** (n - a) * lost
    return out


def runs_for(target: float, similarity: float, levels: int) -> int:
    """Runs after which a pair at the threshold was missed with a chance of 1 - target at most, or else a run for each token."""
    return next((r for r in range(1, TOKENS) if missed(r, similarity, levels) <= 1 - target), TOKENS)


def with_sizes(level: DataFrame, shares: int = SHARES) -> DataFrame:
    """The rows (bucket, node) of buckets of two sets or more, with their bucket's size. Rows are dealt by bucket and a share of
    the nodes, for the count as for the join, so a bucket that very many sets fall into is many tasks' work; only its counts,
    one a share, ever meet."""
    dealt = level.withColumn("share", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(shares)))
    counts = dealt.groupBy("bucket", "share").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.collect_list("share").alias("of")).where("size > 1")
    return dealt.join(sizes.select("bucket", "size", F.explode("of").alias("share")), ["bucket", "share"]).select("bucket", "node", "size")


def in_blocks(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """Deal each group's rows into blocks and each pair of blocks to a cell: (cell, side). In a cell of one block side is 0."""
    blocks = F.ceil(F.col(size) / most)
    mine = F.pmod(F.xxhash64("node", F.lit(3)), blocks)
    dealt = rows.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumn("cell", F.xxhash64(group, F.least("_b", "_o"), F.greatest("_b", "_o"))).withColumn("side", F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2)).drop("_b", "_o")


def _cells(batches, most_rows: int = 4000):
    """Whole cells from batches sorted by cell, several at a time: tables, and the bounds of their cells."""
    held: list = []

    def full(table):
        cell = table.column("cell").to_numpy()
        return np.append(0, np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)))

    n = 0
    for batch in batches:
        for i in range(0, batch.num_rows, most_rows):
            held.append(batch.slice(i, most_rows))
            n += held[-1].num_rows
            if n < most_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(full(table)[-2])
            if cut:
                yield table.slice(0, cut), full(table)[:-1]
                table = table.slice(cut).combine_chunks()
            held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, full(table)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pairs_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell to be compared: all pairs of one block, or those across two."""
    if side[0] == 0:
        return np.triu_indices(len(side), 1)
    x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    return np.repeat(x, len(y)), np.tile(y, len(x))


def _meet(least: int):
    """Stars of the sets whose signatures agree in at least so many tokens, within each cell."""

    def run(batches):
        for table, bounds in _cells(batches):
            sig, node, side = _sigs(table.column("sig")), table.column("node").to_numpy(), table.column("side").to_numpy()
            left, right = [], []
            sizes = np.diff(bounds)
            for size in np.unique(sizes):
                begin = bounds[:-1][sizes == size]
                if size <= 32:  # many small cells of one block at once
                    i, j = np.triu_indices(size, 1)
                    one = begin[side[begin] == 0]
                    for k in range(0, len(one), max(1, 200_000 // max(1, len(i)))):
                        b = one[k : k + max(1, 200_000 // max(1, len(i)))]
                        x, y = (b[:, None] + i).ravel(), (b[:, None] + j).ravel()
                        keep = (sig[x] == sig[y]).sum(1) >= least
                        left.append(x[keep]), right.append(y[keep])
                    begin = begin[side[begin] != 0]
                for b in begin:
                    s = side[b : b + size]
                    x, y = (np.arange(size), np.arange(size)) if s[0] == 0 else (np.flatnonzero(s == 1), np.flatnonzero(s == 2))
                    for k in range(0, len(x), 256):
                        same = np.zeros((len(x[k : k + 256]), len(y)), np.uint8)
                        for t in range(TOKENS):
                            same += sig[b + x[k : k + 256], t][:, None] == sig[b + y, t]
                        i, j = np.nonzero(same >= least)
                        left.append(b + x[k + i]), right.append(b + y[j])
            if left:
                label = _labels(len(node), np.concatenate(left), np.concatenate(right))
                far = np.flatnonzero(node[label] != node)
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["u", "v"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in ws.slices(batch):
                words = ws.Words(part.column("text"))
                hashed, ranges = shingles(words, size)
                doc = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
                order = np.lexsort((hashed, doc))
                hashed, doc = hashed[order], doc[order]
                first = np.ones(len(hashed), bool)
                first[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
                cuts = np.append(0, np.cumsum(np.bincount(doc[first], minlength=len(ranges) - 1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sequence_hashes(words).view(np.int64)), ws.pack(hashed[first], cuts)], names=["doc_id", "node", "shingles"])

    return run


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share: products of their incidence, some columns at a time."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        return np.array([[len(sets[0]), x := int((both[1:] == both[:-1]).sum())], [x, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    out = np.zeros((n, n))
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [k, k + columns])
        x = np.zeros((n, columns), np.float32)
        x[row[lo:hi], column[lo:hi] - k] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(numerator: int, denominator: int):
    """Exact links within each cell: for each set the linked documents, and a star of the linked sets."""

    def run(batches):
        for table, bounds in _cells(batches, 512):
            node, side, many = (table.column(c).to_numpy() for c in ("node", "side", "n"))
            flat, at = ws.unpack(table.column("shingles"), np.uint64)
            links, left, right = np.zeros(len(node), np.int64), [], []
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - b < 2:
                    continue
                both = common([flat[at[i] : at[i + 1]] for i in range(b, e)])
                size = np.diff(at[b : e + 1])
                # common / (all - common) >= numerator / denominator
                linked = (numerator + denominator) * both >= numerator * (size[:, None] + size[None, :])
                np.fill_diagonal(linked, False)
                if side[b] != 0:
                    linked &= side[b:e][:, None] != side[b:e][None, :]
                links[b:e] = linked @ many[b:e]
                i, j = np.nonzero(np.triu(linked))
                left.append(b + i), right.append(b + j)
            label = _labels(len(node), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(node))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], names=["node", "links", "star"])

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = (4, 5), target: float = TARGET) -> DataFrame:
    """doc_id, text_hash, node (a hash of the words in order), class_id, class_node (a number of the class; null: no words), n_links for
    each row of the documents."""
    s = similarity[0] / similarity[1]
    runs = min(TOKENS, runs_for(target, s, LEVELS))
    texts = docs_of(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    signed = written(texts.mapInArrow(_sign(words), "doc_id long, text_hash long, node long, full boolean, sig binary"), "signed")
    nodes = signed.where("full").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(_NULL))).alias("least"))
    nodes = written(nodes, "nodes")
    sigs = signed.where("full").join(nodes.select("node", "least"), "node").where(F.coalesce("doc_id", F.lit(_NULL)) == F.col("least")).dropDuplicates(["node"]).select("node", "sig")
    sigs = written(sigs, "signatures")
    # split by chosen paths
    level, leaves = sigs.mapInArrow(_roots(runs), "bucket long, node long"), []
    for depth in range(LEVELS):
        level = written(with_sizes(level), "buckets")
        last = depth == LEVELS - 1
        leaves.append(level if last else level.where(F.col("size") <= SMALL))
        if not last:
            level = level.where(F.col("size") > SMALL).select("bucket", "node").join(sigs, "node").mapInArrow(_branch, "bucket long, node long")
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    # a pair at the threshold agrees in so many tokens but for a chance of about 1e-5
    least = agreeing(s)
    cells = in_blocks(leaf, "bucket", "size", BLOCK).select("cell", "side", "node").join(sigs, "node").select("cell", "side", "node", "sig")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_meet(least), "u long, v long")
    group = components(met)
    # whole sets, compared within groups
    member = written(group.join(nodes, "node").select("node", "component", "n", "least"), "members")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wanted = member.select(F.col("least").alias("doc_id")).distinct()
    sets = docs_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL))).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, node long, shingles binary")
    rows = sets.dropDuplicates(["doc_id", "node"]).join(member.withColumnRenamed("least", "doc_id"), ["doc_id", "node"]).join(sizes, "component")
    cells = in_blocks(rows.select("component", "size", "node", "n", "shingles"), "component", "size", EXACT_BLOCK).select("cell", "side", "node", "n", "shingles")
    exact = written(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_verify(*similarity), "node long, links long, star long"), "links")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(exact.select(F.col("node").alias("u"), F.col("star").alias("v")))
    named = nodes.join(classes, "node", "left").join(links, "node", "left").select("node", "n", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = named.join(ids, "component").select("node", F.col("component").alias("class_node"), F.nullif("class_id", F.lit(_NULL)).alias("class_id"), (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = signed.select("doc_id", "text_hash", "node", "full").join(named.withColumnRenamed("node", "_n"), F.col("full") & (F.col("node") == F.col("_n")), "left")
    return out.select("doc_id", "text_hash", "node", F.when(F.col("full"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "class_node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
k AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, coalesce((SELECT count(*) FROM l WHERE l.a = k.doc_id), 0)::BIGINT AS n_links FROM k
"""
