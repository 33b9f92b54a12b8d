"""A content-addressed store of token ids.

A tokenizer of the tokenizers library encodes the texts; each document's ids, with an end id, are a stream that a
rolling hash over the last WINDOW ids cuts into chunks, so equal passages give equal chunks wherever they stand. A
chunk's address is the hash of its bytes, and it is stored once. A document's recipe lists its chunks' addresses in
order, and the Merkle root of these seals it; a shard's manifest does the same for the roots of its documents.

Files of a store, all Parquet:
``chunks``    address, n (ids), ids (their bytes, little endian, ``width`` each), refs (document and place, packed)
``recipes``   shard, doc_id, text_hash, copies, n_tokens, addresses, root; in ascending order of doc_id, shard by shard
``manifests`` shard, n_documents, n_tokens, root
``store``     n_shards, root: one over the shards' in order

On reading, a recipe's root is recomputed from the addresses of the chunks that were read, each manifest from its recipes, and the
store's root from the manifests; a difference raises.

Before chunks are dealt out by address, those of one batch are merged: a chunk of which there are very many copies
travels once for each batch of input.

Special tokens in a text are encoded as the library does by default. An id that doesn't fit the width raises.

Defined results: a null text counts as empty, its stream is the end id; other columns aren't looked at; rows with one doc_id are ordered by a hash of
their text, equal rows share a recipe (``copies``); a null doc_id comes last; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import wordscan as ws
from strandline.llm.common import input_bytes, shared_folder
from strandline.llm.pieces import Dictionary, Segments, ends_wide, gather

END_ID = 2
#: Chunks end where the rolling hash of so many ids says so, one place in MEAN, and after MOST ids anyway.
WINDOW, MEAN, MOST = 16, 512, 4096
_REF = np.dtype([("id", "<i8"), ("text", "<i8"), ("seq", "<i4")])
_KNOWN: dict = {}


def encoder(path: str) -> Dictionary:
    """This process's tokenizer. Distinct segments are encoded as one text and told apart by the lengths of their tokens."""
    if path not in _KNOWN:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        # the bytes of each id: a byte-level vocabulary spells each byte as one character, and special tokens are ASCII
        length = np.zeros(max(tok.get_vocab().values()) + 1, np.int64)
        for token, i in tok.get_vocab().items():
            length[i] = len(token)

        def encode(s: Segments, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # a segment that begins with a space and ends without one is encoded alike after any other of this kind
            start, end = s.spans(chosen)
            last = s.body[end - 1]
            joins = ws.SPACE[s.body[start]] & ~ws.SPACE[last] & ~((last >= 0x1C) & (last <= 0x1F)) & ~ends_wide(s.body, end)
            order = np.append(np.flatnonzero(joins), np.flatnonzero(~joins))
            n = int(joins.sum())
            raw = gather(s.body, start[order], (end - start)[order]).tobytes()
            ends = np.cumsum((end - start)[order])
            cut = np.append(0, ends)[np.append(np.arange(0, n, 1000), np.arange(n, len(order) + 1))].tolist()
            texts = [raw[a:b].decode() for a, b in zip(cut[:-1], cut[1:])]
            ids = [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            reached = np.cumsum(length[flat])
            cuts = np.append(0, np.searchsorted(reached, ends) + 1) if len(order) else np.zeros(1, np.int64)
            if len(order) and not (reached[cuts[1:] - 1] == ends).all():
                raise ValueError("a token crosses the end of a segment")
            size = np.empty(len(order), np.int64)
            size[order] = np.diff(cuts)
            begin = np.empty(len(order), np.int64)
            begin[order] = cuts[:-1]
            return gather(flat, begin, size), np.append(0, np.cumsum(size))

        _KNOWN[path] = Dictionary(encode)
    return _KNOWN[path]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.insert(ids, at[1:], end)
    return out, at + np.arange(len(at))


def cut_chunks(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, in order, and for each document the range of its chunks."""
    marked = ws.mix(ids.astype(np.uint64) + np.uint64(1))
    cut = np.zeros(len(ids) + 1, bool)
    place, rolled = ws.windows(marked, at, WINDOW)  # only windows within a document
    cut[place[rolled % np.uint64(MEAN) == 0] + WINDOW] = True
    cut[at[:-1]] = True
    cut[-1] = False
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(ids)))
    if (length > MOST).any():
        more = [np.arange(s + MOST, s + n, MOST) for s, n in zip(start[length > MOST], length[length > MOST])]
        start = np.sort(np.concatenate([start, *more]))
    return start, np.searchsorted(start, at)


def _address(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of hashes; an odd last node goes up as it is. The root of no leaves is the hash of nothing."""
    if not leaves:
        return _address(b"")
    level = [_address(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [_address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _chunks(path: str, end: int, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        known = encoder(path)
        for batch in batches:
            for part in ws.slices(batch, "text", 4 << 20):
                ids, at = with_end(*known.column(part.column("text")), end)
                start, ranges = cut_chunks(ids, at)
                stops = np.append(start[1:], len(ids))
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id doesn't fit in {width} bytes")
                raw = ids.astype(kind)
                places: dict[bytes, list[int]] = {}
                data = raw.tobytes()
                for i, (a, b) in enumerate(zip((start * width).tolist(), (stops * width).tolist())):
                    places.setdefault(_address(data[a:b]), []).append(i)
                doc = np.repeat(np.arange(part.num_rows), np.diff(ranges))
                ref = np.zeros(len(start), _REF)
                ref["id"] = part.column("id").to_numpy(zero_copy_only=False)[doc]
                ref["text"] = part.column("hash").to_numpy(zero_copy_only=False)[doc]
                ref["seq"] = np.arange(len(start)) - ranges[doc]
                order = list(places.values())
                counts = np.fromiter(map(len, order), np.int64, len(order))
                flat = np.fromiter((i for x in order for i in x), np.int64, len(start))
                one = np.array([x[0] for x in order], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(places), pa.binary()), pa.array((stops - start)[one], pa.int32()), pa.array([data[a:b] for a, b in zip((start[one] * width).tolist(), (stops[one] * width).tolist())], pa.binary()), ws.pack(ref[flat], np.append(0, np.cumsum(counts)))],
                    names=["address", "n", "ids", "refs"],
                )

    return run


def _unique(batches):
    """Of rows sorted by address, the first of each keeps its ids; later ones, also those of the next batch, add their refs only."""
    last = None
    for batch in batches:
        address = batch.column("address").to_pylist()
        new = np.array([a != b for a, b in zip(address, [last, *address[:-1]])], bool)
        last = address[-1] if address else last
        ids = batch.column("ids")
        yield pa.RecordBatch.from_arrays([batch.column("address"), batch.column("n"), pa.array([x if k else None for x, k in zip(ids.to_pylist(), new.tolist())], pa.binary()), batch.column("refs")], names=["address", "n", "ids", "refs"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, width: int = 2) -> None:
    """Write the store of the documents' ids to a folder that all executors share."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = rows.mapInArrow(_chunks(tokenizer, end, width), "address binary, n int, ids binary, refs binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (64 << 20))
    dealt = chunks.repartition(parts, "address").sortWithinPartitions("address")
    dealt.mapInArrow(_unique, chunks.schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")

    refs = spark.read.schema(chunks.schema).parquet(f"{path}/chunks").select("address", "n", "refs").mapInArrow(_unfolded, "id long, text long, seq int, n int, address binary")
    # equal rows give equal refs: their number at place 0 is the number of copies
    once = refs.groupBy("id", "text", "seq", "address", "n").agg(F.count(F.lit(1)).alias("c"))
    recipe = once.groupBy("id", "text").agg(F.max("c").alias("copies"), F.sum("n").cast("long").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "address"))).alias("x"))
    recipe = recipe.select(F.nullif("id", F.lit(2**63 - 1)).alias("doc_id"), F.col("text").alias("text_hash"), "copies", "n_tokens", F.col("x.address").alias("addresses"), F.col("id").alias("_id"))
    recipe = recipe.repartitionByRange(parts, "_id", "text_hash").sortWithinPartitions("_id", "text_hash").withColumn("shard", F.spark_partition_id()).drop("_id")
    schema = "shard int, doc_id long, text_hash long, copies long, n_tokens long, addresses array<binary>, root binary"
    recipe.mapInArrow(_sealed, schema).write.mode("overwrite").parquet(f"{path}/recipes")
    spark.read.schema(schema).parquet(f"{path}/recipes").select("shard", "doc_id", "text_hash", "copies", "n_tokens", "root").groupBy("shard").applyInArrow(_manifest, "shard int, n_documents long, n_tokens long, root binary").write.mode("overwrite").parquet(f"{path}/manifests")
    _root(spark.read.schema(_MANIFESTS).parquet(f"{path}/manifests")).write.mode("overwrite").parquet(f"{path}/store")


def _root(manifests: DataFrame) -> DataFrame:
    """One row: the number of shards, and a hash over their roots in order. A row a shard of about 64 MB is gathered."""
    ordered = F.array_sort(F.collect_list(F.struct("shard", "root")))
    return manifests.agg(F.count(F.lit(1)).alias("n_shards"), F.sha2(F.array_join(F.transform(ordered, lambda s: F.concat(s["shard"].cast("string"), F.lit(":"), F.hex(s["root"]))), ","), 256).alias("root"))


def _unfolded(batches):
    for batch in batches:
        ref, at = ws.unpack(batch.column("refs"), _REF)
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ref[k])) for k in ("id", "text", "seq")] + [batch.column("n").take(pa.array(row)), batch.column("address").take(pa.array(row))], names=["id", "text", "seq", "n", "address"])


def _sealed(batches):
    names = ["shard", "doc_id", "text_hash", "copies", "n_tokens", "addresses", "root"]
    for batch in batches:
        roots = [merkle(x) for x in batch.column("addresses").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(roots, pa.binary())], names=names)


def _manifest(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
    copies, n = table.column("copies").to_numpy(), table.column("n_tokens").to_numpy()
    return pa.table({"shard": table.column("shard")[:1], "n_documents": pa.array([int(copies.sum())], pa.int64()), "n_tokens": pa.array([int((copies * n).sum())], pa.int64()), "root": pa.array([merkle(table.column("root").to_pylist())], pa.binary())})


# -- reading ----------------------------------------------------------------------------------------------------

_MANIFESTS = "shard int, n_documents long, n_tokens long, root binary"
_CHUNKS = "address binary, n int, ids binary, refs binary"
_RECIPES = "shard int, doc_id long, text_hash long, copies long, n_tokens long, addresses array<binary>, root binary"


def _held(manifest: pa.Table, recipes: pa.Table) -> pa.Table:
    """A shard's manifest, if its recipes give the same."""
    if manifest.num_rows != 1 or not recipes.num_rows or _manifest(recipes).to_pylist() != manifest.to_pylist():
        raise ValueError("a shard's recipes don't match its manifest")
    return manifest


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes, each with ``start``: the ids of all documents before it, from the order of shards and documents."""
    r = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    m = spark.read.schema(_MANIFESTS).parquet(f"{path}/manifests")
    m = m.groupBy("shard").cogroup(r.drop("addresses").groupBy("shard")).applyInArrow(_held, _MANIFESTS)
    sealed = spark.read.schema("n_shards long, root string").parquet(f"{path}/store").first()  # one row
    if sealed is None or tuple(_root(m).first()) != tuple(sealed):
        raise ValueError("the shards' manifests don't match the store's root")
    # one row a shard: shards are of about 64 MB
    before = m.select(F.col("shard").alias("s2"), (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    inside = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    r = r.withColumn("_sum", F.sum(F.col("n_tokens") * F.col("copies")).over(inside) - F.col("n_tokens") * F.col("copies"))
    return r.join(before, F.col("shard") == F.col("s2")).withColumn("start", F.col("_sum") + F.col("before")).drop("s2", "before", "_sum")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` of every document, put together from its chunks; a broken store raises."""
    stored = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").where("ids IS NOT NULL").select("address", "ids")
    r = _recipes(spark, path)
    parts = r.select("doc_id", "text_hash", F.posexplode("addresses").alias("seq", "address")).join(stored, "address", "left")
    whole = parts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "ids"))).alias("x"))
    kind = np.dtype(f"<u{width}")

    def run(batches):
        for batch in batches:
            lists, roots = [], []
            for row in batch.column("x").to_pylist():
                if any(p["ids"] is None or _address(p["ids"]) != p["address"] for p in row):
                    raise ValueError("a chunk is missing or its bytes don't match its address")
                lists.append(np.frombuffer(b"".join(p["ids"] for p in row), kind).astype(np.int32))
                roots.append(merkle([p["address"] for p in row]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(lists, pa.list_(pa.int32())), pa.array(roots, pa.binary())], names=["doc_id", "text_hash", "ids", "read"])

    ids = whole.mapInArrow(run, "doc_id long, text_hash long, ids array<int>, read binary")
    keyed = r.join(ids.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    checked = F.when((F.col("read") == F.col("root")) & (F.size("ids") == F.col("n_tokens")), F.col("ids")).otherwise(F.raise_error(F.lit("a document's chunks don't match its recipe")).cast("array<int>"))
    copy = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copy.select("doc_id", (F.col("start") + F.col("_copy") * F.col("n_tokens")).alias("start"), "n_tokens", checked.alias("ids"))


# crc32 of joined parts: polynomials over two elements modulo the crc's, as numpy arrays


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the polynomial, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def _shifts(n: np.ndarray) -> np.ndarray:
    """x to the power of 8 n, for each n."""
    out = np.full(len(n), 0x80000000, np.uint32)
    square = np.array([0x00800000], np.uint32)  # x ** 8
    n = n.astype(np.uint64)
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(square, (int(odd.sum()),)).copy())
        square, n = _times(square, square), n >> np.uint64(1)
    return out


def _read_chunks(width: int):
    """Of each stored chunk, read and checked: the crc32 of its ids as 32-bit integers."""
    import zlib

    kind = np.dtype(f"<u{width}")

    def run(batches):
        for batch in batches:
            address, ids = batch.column("address").to_pylist(), batch.column("ids").to_pylist()
            if any(_address(x) != a for a, x in zip(address, ids)):
                raise ValueError("a chunk's bytes don't match its address")
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(crc, pa.int64())], names=["address", "crc"])

    return run


def _placed(batches):
    for batch in batches:
        ref, at = ws.unpack(batch.column("refs"), _REF)
        row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ref[k])) for k in ("id", "text", "seq")] + [batch.column(c).take(row) for c in ("n", "crc", "address")], names=["id", "text", "seq", "n", "crc", "address"])


def _joined_crcs(batches):
    for batch in batches:
        x = batch.column("x")
        at = np.asarray(x.offsets).astype(np.int64)
        flat = x.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        size = np.diff(at)
        n, crc = np.asarray(flat.field("n")).astype(np.int64), np.asarray(flat.field("crc")).astype(np.uint32)
        total = np.append(0, np.cumsum(n))
        after = np.repeat(total[at[1:]], size) - total[1:]
        moved = _times(crc, _shifts(after * 4))
        whole = np.bitwise_xor.reduceat(moved, at[:-1]) if len(size) else np.zeros(0, np.uint32)
        address = flat.field("address").to_pylist()
        roots = pa.array([merkle(address[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
        addresses = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat.field("address"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(whole.astype(np.int64)), pa.array(total[at[1:]] - total[at[:-1]]), addresses, roots], names=["id", "text", "ids_crc32", "n", "found", "read"])


def read_checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document. Every stored chunk is read and its address checked; a
    document's checksum is put together from its chunks', so ids don't travel; lengths, addresses in their order and the root are held against
    the recipe's, so a missing chunk or an altered recipe raises."""
    stored = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    read = stored.where("ids IS NOT NULL").select("address", "ids").mapInArrow(_read_chunks(width), "address binary, crc long")
    places = stored.select("address", "n", "refs").join(read, "address").mapInArrow(_placed, "id long, text long, seq int, n int, crc long, address binary").dropDuplicates(["id", "text", "seq"])
    sums = places.groupBy("id", "text").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "address"))).alias("x")).mapInArrow(_joined_crcs, "id long, text long, ids_crc32 long, n long, found array<binary>, read binary")
    r = _recipes(spark, path).withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    out = r.join(sums.withColumnsRenamed({"id": "_i", "text": "_t"}), (F.col("id") == F.col("_i")) & (F.col("text_hash") == F.col("_t")), "left")
    same = (F.col("n") == F.col("n_tokens")) & (F.col("found") == F.col("addresses")) & (F.col("read") == F.col("root"))
    checked = F.when(same, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks don't match its recipe")).cast("long"))
    copy = out.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copy.select("doc_id", (F.col("start") + F.col("_copy") * F.col("n_tokens")).alias("start"), "n_tokens", checked.alias("ids_crc32"))


def op5_id_store(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, path)
