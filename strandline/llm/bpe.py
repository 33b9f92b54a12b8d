"""Byte-level BPE encoding and decoding by recursive queries.

Each partition runs DuckDB in its worker's process. A word's bytes become rows (word, position, token); a recursive
query joins neighbouring tokens to the merge table, contracts each word's leftmost pair of the smallest rank, and ends
when no word has a pair left. Decoding joins ids to the vocabulary and aggregates their bytes in order of position, which the lengths of
tokens cut into sequences.
Only distinct words are encoded: a batch's texts are cut into segments that no token crosses (pieces.py).

A round contracts one pair of each word and keeps all tokens as rows, so what a query holds is the sum of squares of its words' lengths;
words are dealt to queries by that sum. A word of more than LONG bytes is cut into windows of so many. Ids are a word's encoding exactly if each two
neighbours are the encoding of their bytes (a pair of the smallest rank that crosses a seam would show in the pair at the seam), so windows are joined
where the two tokens at the seam stay as they are, and where not, some tokens on both sides are encoded anew, the more
the longer the seams beside them don't hold. Windows are joined in pairs up to BLOCK bytes, these blocks from left to right. Only such a stretch of more than
LONG bytes, as runs of one period may need, goes through a second form of the recursion, which replaces rows in place and contracts every
place of the smallest rank in a round, from the left up to the first where this makes a pair of a smaller rank still.

Defined results: a null or empty text has no ids; special tokens don't exist, their strings are ordinary text; each row is encoded by
itself, so rows that repeat, or a null doc_id, are rows of the result; given columns may have any name but ``ids`` and
``decoded``; a text of any length is taken whole, in parts that no token crosses.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordscan as ws
from strandline.llm.common import free_name
from strandline.llm.pieces import Dictionary, gather

LONG = 64
#: Bytes of a long word that are joined in pairs; beyond these from left to right.
BLOCK = 1 << 15
#: Bytes of text that are cut, encoded and decoded at once.
PART = 2 << 20
#: Of one recursive query: the squares of its words' lengths together, or the bytes of long ones. Its rows stay within the memory limit.
SQUARES, BYTES = 2_000_000, 20_000
#: Ids that one query decodes.
IDS = 300_000

#: Rows are tokens with their right neighbour: place, place of the neighbour (-1: none), token, neighbour's token.
_ENCODE = """
WITH RECURSIVE w(word, pos, npos, tok, next, round) AS (
  SELECT word, pos, npos, tok, next, 0 FROM start
  UNION ALL
  (WITH best AS (
     SELECT word, min((m.rank::BIGINT << 32) | (pos << 16) | npos) AS b FROM w JOIN merges m ON m.l = tok AND m.r = next GROUP BY word
   ), cut AS (
     SELECT b.word, (b >> 32)::INTEGER AS rank, ((b >> 16) & 65535)::INTEGER AS place, (b & 65535)::INTEGER AS gone, w.npos AS npos, w.next AS next
     FROM best b JOIN w ON w.word = b.word AND w.pos = (b.b & 65535)
   )
   SELECT w.word, w.pos,
     CASE WHEN w.pos = place THEN cut.npos ELSE w.npos END,
     CASE WHEN w.pos = place THEN rank ELSE w.tok END,
     CASE WHEN w.pos = place THEN cut.next WHEN w.npos = place THEN rank ELSE w.next END, round + 1
   FROM w JOIN cut ON w.word = cut.word WHERE w.pos <> gone)
), last AS (SELECT word, max(round) AS round FROM w GROUP BY word)
SELECT word, tok FROM w JOIN last USING (word, round) ORDER BY word, pos
"""

_ENCODE_LONG = """
WITH RECURSIVE w(word, pos, npos, tok, next) USING KEY (word, pos) AS (
  SELECT word, pos, npos, tok, next FROM start
  UNION
  (WITH live AS (
     SELECT s.*, m.rank FROM recurring.w s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.next WHERE s.tok >= 0 AND s.word IN (SELECT word FROM w)
   ), best AS (SELECT word, min(rank) AS rank FROM live GROUP BY word HAVING min(rank) IS NOT NULL
   ), hit AS (
     SELECT l.word, l.pos, l.npos, l.rank, row_number() OVER o AS nth, coalesce(lag(l.npos) OVER o = l.pos, false) AS inner_one
     FROM live l JOIN best b ON l.word = b.word AND l.rank = b.rank WINDOW o AS (PARTITION BY l.word ORDER BY l.pos)
   ), cut AS (  -- of places that overlap, every other one
     SELECT * FROM (SELECT *, nth - max(CASE WHEN inner_one THEN 0 ELSE nth END) OVER (PARTITION BY word ORDER BY pos) AS k FROM hit) WHERE k % 2 = 0
   ), met AS (
     SELECT c.word, c.pos, c.rank AS tok, c.npos AS gone, g.npos, g.next, CASE WHEN lag(c.npos) OVER (PARTITION BY c.word ORDER BY c.pos) = p.pos THEN c.rank ELSE p.tok END AS prev
     FROM cut c JOIN live g ON g.word = c.word AND g.pos = c.npos LEFT JOIN live p ON p.word = c.word AND p.npos = c.pos
   ), low AS (
     SELECT word, min(pos) AS pos FROM (
       SELECT word, pos FROM met JOIN merges m ON m.l = met.prev AND m.r = met.tok AND m.rank < met.tok
       UNION ALL SELECT word, pos FROM met JOIN merges m ON m.l = met.tok AND m.r = met.next AND m.rank < met.tok) GROUP BY word
   ), made AS (SELECT met.* FROM met LEFT JOIN low ON low.word = met.word WHERE low.pos IS NULL OR met.pos <= low.pos)
   SELECT l.word, l.pos, coalesce(m.npos, l.npos), CASE WHEN x.word IS NOT NULL THEN -1 ELSE coalesce(m.tok, l.tok) END, coalesce(n.tok, m.next, l.next)
   FROM live l LEFT JOIN made m ON m.word = l.word AND m.pos = l.pos LEFT JOIN made x ON x.word = l.word AND x.gone = l.pos LEFT JOIN made n ON n.word = l.word AND n.pos = coalesce(m.npos, l.npos)
   WHERE m.word IS NOT NULL OR x.word IS NOT NULL OR n.word IS NOT NULL)
)
SELECT word, tok FROM w WHERE tok >= 0 ORDER BY word, pos
"""

_DECODE = "SELECT s.pos // 4096 AS part, string_agg(v.hex, '' ORDER BY s.pos) AS hex FROM ids s JOIN vocab v ON v.rank = s.tok GROUP BY s.pos // 4096 ORDER BY part"


class Bpe:
    """A vocabulary of ranks in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str):
        import base64

        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {b: a for a, b in self.rank.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.length[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "96MB", "temp_directory": "", **{f"allocator_{x}flush_threshold": "8MB" for x in ("", "bulk_deallocation_")}})
        self.db.register("v", pa.table({"rank": pa.array(list(self.rank.values()), pa.int32()), "hex": [k.hex() for k in self.rank]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v ORDER BY rank")
        # every way to make a token of two others: all pairs that may be contracted, with the rank of what they make
        self.db.execute(
            "CREATE TABLE merges AS SELECT a.rank AS l, b.rank AS r, t.rank FROM (SELECT rank, substr(hex, 1, 2 * i) AS x, substr(hex, 2 * i + 1) AS y "
            "FROM (SELECT rank, hex, unnest(range(1, length(hex) // 2)) AS i FROM vocab)) t JOIN vocab a ON a.hex = t.x JOIN vocab b ON b.hex = t.y"
        )

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, ids in zip(short, self._recursive([words[i] for i in short])):
            out[i] = ids
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return out
        blocks = [[words[i][a : a + BLOCK] for a in range(0, len(words[i]), BLOCK)] for i in long]
        cut = [[b[a : a + LONG] for a in range(0, len(b), LONG)] for x in blocks for b in x]
        flat = iter(self._distinct([w for c in cut for w in c]))
        runs = [[next(flat) for _ in c] for c in cut]
        while any(len(r) > 1 for r in runs):
            met = iter(self._joined([(a, b) for r in runs for a, b in zip(r[::2], r[1::2])]))
            runs = [[next(met) for _ in range(len(r) // 2)] + r[len(r) - len(r) % 2 :] for r in runs]
        whole = iter(r[0] for r in runs)
        rest = [[next(whole) for _ in x] for x in blocks]
        while some := [r for r in rest if len(r) > 1]:
            for r, ids in zip(some, self._joined([(r[0], r[1]) for r in some])):
                r[:2] = [ids]
        for i, r in zip(long, rest):
            out[i] = r[0]
        return out

    def _distinct(self, words: list[bytes]) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        which = [number.setdefault(w, len(number)) for w in words]
        ids = self._recursive(list(number))
        return [ids[i] for i in which]

    def _raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of two neighbouring stretches together, for each pair of their ids. ``near`` tokens on both sides of a seam are encoded anew until the
        seams around them hold."""
        out: list = [None] * len(pairs)
        open_, near = list(range(len(pairs))), 0
        while open_:
            middle = self._distinct([self._raw(pairs[i][0][-near:]) + self._raw(pairs[i][1][:near]) for i in open_]) if near else [np.zeros(0, np.int32)] * len(open_)
            tries = []
            for i, m in zip(open_, middle):
                a, b = pairs[i]
                tries.append([a[: max(0, len(a) - near)], m, b[near:]] if near else [a, b])
            seams = [(x[-1:], y[:1]) for t in tries for u in [[p for p in t if len(p)]] for x, y in zip(u[:-1], u[1:])]
            held = iter(len(got) == 2 and got[0] == x[0] and got[1] == y[0] for got, (x, y) in zip(self._distinct([self._raw(x) + self._raw(y) for x, y in seams]), seams))
            left = []
            for i, t in zip(open_, tries):
                if all([next(held) for _ in range(sum(len(p) > 0 for p in t) - 1)]):
                    out[i] = np.concatenate(t)
                else:
                    left.append(i)
            open_, near = left, near * 4 or 2
        return out

    def _recursive(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the recursive query."""
        out: list = [None] * len(words)
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of like lengths have like rounds
        n_short = sum(len(w) <= LONG for w in words)
        short, long = by_length[:n_short], by_length[n_short:]
        size = np.array([len(words[i]) for i in by_length], np.int64)
        parts = [(_ENCODE, short[i:j]) for i, j in _ranges(size[:n_short] ** 2, SQUARES)]
        parts += [(_ENCODE_LONG, long[i:j]) for i, j in _ranges(size[n_short:], BYTES)]
        for query, part in parts:
            size = np.array([len(words[i]) for i in part])
            body = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            word = np.repeat(np.arange(len(part), dtype=np.int32), size)
            pos = (np.arange(len(body)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            tok = self.byte[body]
            end = np.cumsum(size) - 1
            npos, follows = pos + np.int32(1), np.append(tok[1:], np.int32(-1))
            npos[end], follows[end] = -1, -1
            self.db.register("start", pa.table({"word": word, "pos": pos, "npos": npos, "tok": tok, "next": follows}))
            got = self.db.execute(query).fetchnumpy()
            self.db.unregister("start")
            cuts = np.searchsorted(got["word"], np.arange(len(part) + 1))
            tok = np.asarray(got["tok"], np.int32)
            for j, i in enumerate(part):
                out[i] = tok[cuts[j] : cuts[j + 1]]
        return out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and offsets: each match of the pattern is a word."""
        number: dict[str, int] = {}
        parts = [[number.setdefault(p, len(number)) for p in self.split(s)] for s in segments]
        ids = self.encode_words([p.encode() for p in number])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        which = np.fromiter((i for p in parts for i in p), np.int64, sum(map(len, parts)))
        cuts = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        begin = np.cumsum(size) - size
        return gather(flat, begin[which], size[which]), np.append(0, np.cumsum(size[which]))[cuts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each sequence of ids. An id that isn't in the vocabulary raises ValueError."""
        if len(ids) and not set(np.unique(ids).tolist()) <= self.bytes_of.keys():
            raise ValueError("an id is not in the vocabulary")
        raw = []
        for i in range(0, len(ids), IDS):
            some = ids[i : i + IDS]
            self.db.register("ids", pa.table({"pos": pa.array(np.arange(len(some)), pa.int32()), "tok": pa.array(some, pa.int32())}))
            raw += [bytes.fromhex(h) for h in self.db.execute(_DECODE).fetchnumpy()["hex"].tolist()]
            self.db.unregister("ids")
        whole, at = b"".join(raw), np.append(0, np.cumsum(self.length[ids]))[offsets].tolist()
        return [whole[a:b] for a, b in zip(at[:-1], at[1:])]


_KNOWN: dict = {}


def bpe_of(path: str, pattern: str) -> tuple[Bpe, Dictionary]:
    """This process's Bpe of a vocabulary and the segments that it knows."""
    if (path, pattern) not in _KNOWN:
        b = Bpe(path, pattern)
        _KNOWN[path, pattern] = b, Dictionary(lambda s, new: b.encode_segments(s.distinct(new)), most=250_000, short=16)
    return _KNOWN[path, pattern]


def forget(path: str, pattern: str) -> None:
    """Give up this process's Bpe at the end of a task: Spark keeps the process for stages that don't need one."""
    if found := _KNOWN.pop((path, pattern), None):
        found[0].db.close()
        found[1].encode = None
        del found
        gc.collect()
        ws.release()


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id, by default) and ``ids`` of each text."""
    from pyspark.sql import types as T

    columns, text = columns or ["doc_id"], free_name(docs, "_text")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        _, known = bpe_of(path, pattern)
        for batch in batches:
            for part in ws.slices(batch, text, PART):
                ids, at = known.column(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists], names=[*columns, "ids"])
        del known
        forget(path, pattern)

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns and ``decoded``, the bytes of the ids. Distinct runs of ids are decoded once a batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        b, _ = bpe_of(path, pattern)
        for batch in batches:
            size = np.diff(_lists(batch.column("ids"))[1])
            for i, j in _ranges(size, PART // 4):
                part = batch.slice(i, j - i)
                ids, at = _lists(part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(b, ids, at)], names=[*part.schema.names, "decoded"])
        del b
        forget(path, pattern)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass, so that a task has one Python process: the given columns, ``ids``, ``decoded``."""
    from pyspark.sql import types as T

    columns, text = columns or ["doc_id"], free_name(docs, "_text")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        b, known = bpe_of(path, pattern)
        for batch in batches:
            for part in ws.slices(batch, text, PART):
                ids, at = known.column(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, _decoded(b, ids, at)], names=[*columns, "ids", "decoded"])
        del b, known
        forget(path, pattern)

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def _ranges(size: np.ndarray, most: int):
    total = np.append(0, np.cumsum(size))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def _decoded(b: Bpe, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Decodes by the query what differs: ids are cut before those that begin with a space, and each distinct run is decoded once."""
    if not len(ids):
        return pa.array([b""] * (len(at) - 1), pa.binary())
    begins = getattr(b, "begins", None)
    if begins is None:
        begins = b.begins = np.zeros(max(b.bytes_of) + 1, bool)
        begins[[i for i, x in b.bytes_of.items() if x[:1] == b" "]] = True
    cut = begins[ids]
    cut[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(ids))
    raw = np.ascontiguousarray(ids, np.int32).view(np.uint8)
    _, where, which = np.unique(ws.hashes(raw, start * 4, end * 4), return_index=True, return_inverse=True)
    size = (end - start)[where]
    text = b.decode(gather(ids, start[where], size), np.append(0, np.cumsum(size)))
    length = np.fromiter(map(len, text), np.int64, len(text))
    flat = np.frombuffer(b"".join(text), np.uint8)
    begin = np.cumsum(length) - length
    out = gather(flat, begin[which], length[which])
    return ws.pack(out, np.append(0, np.cumsum(length[which]))[np.searchsorted(start, at)])


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
