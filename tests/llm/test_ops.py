"""The ten operators against brute force, and each one's defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import base64
import hashlib
import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import public_tokenizers as P
from strandline.llm import wordscan as ws
from strandline.llm.common import written
from strandline.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A table with every odd case: nulls in all columns, clashing names, repeats and ties.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, text_hash string, size long, _gone int, node int, n_lines int, _text string, _quality int"


def odd_rows():
    long_line = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
    story = "\n".join(f"line {i} of the story that many tell and few have heard" for i in range(8))
    texts = {
        1: story, 2: story, 3: "prefix here\n" + story + "\nsuffix", 4: None, 5: "", 6: "  \t\n \n", 7: "one", 8: "one", 9: long_line, 10: long_line + " tail", 11: "a b c d", 12: "a b c d e",
        13: "dup line here now\n" * 12, 14: "Ünïcödé 漢字 😀 text with　wide spaces", 15: "x" * 5000, 16: "mail bob@site.example.com or +49 (30) 1234567 now",
    }
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t else 0, "k", "k", "h", 1, 2, 3, 4, "t", 5) for i, t in texts.items()]
    rows.append(rows[0])
    rows.append((None, "no id at all but words enough to count as some text", None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((1, "the same id with another text that goes its own way", "en", "s1", 1, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return written(spark.createDataFrame(odd_rows(), SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return written(spark.createDataFrame([], SCHEMA), "empty")


@pytest.mark.parametrize("name", [k for k in QUERIES if k in ORACLE_SQL])
def test_against_sql(spark, duck, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.sql(ORACLE_SQL[name]).df())


def words(t):
    return WORD.findall(t or "")


# -- scanning ----------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a bb\tccc", "", None, " x ", "é 漢\x0bq", "a bb\tccc", "y" * 3_000_000 + " z"]
    w = ws.Words(pa.array(texts))
    raw = w.body.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.range[:-1], w.range[1:])]
    assert got == [words(t) for t in texts]
    assert w.hash[0:3].tolist() == w.hash[w.range[5] : w.range[6]].tolist()
    flat = [x for t in texts for x in words(t)]
    assert len(set(w.hash.tolist())) == len(set(flat))
    other = ws.Words(pa.array(["y" * 2_999_999 + "x", "y" * 3_000_000]))
    assert other.hash[1] == w.hash[-2] != other.hash[0]


def test_slices_cover_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c" * 10])], names=["text"])
    for limit in (1, 15, 1000):
        assert [x for p in ws.slices(batch, limit=limit) for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_cut_batches_of_the_scan_agree():
    rng = np.random.RandomState(3)
    texts = [" ".join("abc"[k] * (1 + k) for k in rng.randint(0, 3, rng.randint(0, 9))) for _ in range(200)]
    whole = ws.Words(pa.array(texts))
    parts = [ws.Words(pa.array(texts[i : i + 7])) for i in range(0, 200, 7)]
    assert np.concatenate([p.hash for p in parts]).tolist() == whole.hash.tolist()


# -- 1 line dedup ------------------------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    """Kept text by row: a counted line goes in any run of counted lines with so many words that also starts earlier, in order of id, text and place."""
    counted = [[k for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in rows]
    runs, order = {}, []
    for i, (doc, t) in enumerate(rows):
        order.append((2**63 if doc is None else doc, t or ""))
        lines, at = (t or "").split("\n"), counted[i]
        size = [len(words(lines[k])) for k in at]
        for a in range(len(at)):
            for b in range(a, min(len(at), a + 40)):  # longer runs are made up of these
                if sum(size[a : b + 1]) >= least:
                    runs.setdefault(tuple(lines[k] for k in at[a : b + 1]), []).append((order[i], a, i))
    gone = [set() for _ in rows]
    for run, at in runs.items():
        first = min(at)[:2]
        for o, a, i in at:
            if (o, a) > first:
                gone[i] |= set(counted[i][a : a + len(run)])
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, (_, t) in enumerate(rows)]


def test_line_dedup_brute(spark):
    from strandline.llm.line_dedup import line_dedup

    rng = np.random.RandomState(5)
    long, pair = "a line of ninety words " * 18, "two words\nand three more"
    rows = [(1, f"one\n{long}\ntwo\nok"), (2, long), (3, f"first here\n{long}\nok"), (4, pair), (5, f"{pair}\nok"), (6, "ok"), (7, f"{long}\n\n{long}")]
    # the longest match of the third is with the second and not with the first place of its fingerprint
    rows += [(8, "k k\nf f f f f\nm m"), (9, "x\ny y\nf f f f f\nz"), (10, "x\ny y\nf f f f f\nz"), (11, "y y\nf f f f f\nm m")]
    rows += [(i, "\n".join(rng.choice(["a", "b", "c d", "e f g", "h i j k l m", "", " "], rng.randint(0, 14)))) for i in range(20, 120)]
    got = {r.doc_id: r.text for r in line_dedup(written(spark.createDataFrame(rows, "doc_id long, text string"), "lines")).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)
    assert got[2] == "" and got[3] == "first here\nok" and got[5] == "ok" and got[6] == "ok" and got[7] == "" and got[10] == ""


def test_fingerprints_carry_the_result(spark, monkeypatch):
    """Few rows are emitted where lines are short, and a fingerprint that isn't the windows' own loses repeats."""
    from strandline.llm import line_dedup as L

    text = "\n".join(f"{chr(97 + i % 26)}{i * 37 % 101}" for i in range(400))
    df = written(spark.createDataFrame([(1, "begin here\n" + text), (2, text + "\nend")], "doc_id long, text string"), "short")
    assert {r.doc_id: r.n_removed for r in L.line_dedup(df).collect()} == {1: 0, 2: 400}
    hashes = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    n = df.select(F.size(F.array_distinct(F.transform(L.fingerprints(hashes, F.transform(hashes, lambda x: F.lit(1)), 5), lambda f: f["at"]))).alias("n")).first().n
    assert n < 400 * 0.42  # windows of five lines: two in six of them
    right = L.fingerprints
    monkeypatch.setattr(L, "fingerprints", lambda h, w, words: F.transform(right(h, w, words), lambda f: F.struct(f["from"].alias("from"), f["k"].alias("k"), (f["from"] - f["from"] % 400 + 1).cast("int").alias("at"))))
    assert sum(r.n_removed for r in L.line_dedup(df).collect()) < 400


def test_line_dedup_odd(spark, odd, empty):
    from strandline.llm.line_dedup import line_dedup

    out = line_dedup(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count()
    by = {r.doc_id: r for r in out.where("doc_id IN (2, 3, 4, 9, 13)").collect()}
    assert by[2]["n_removed"] == 8 and by[3]["text"] == "prefix here\nsuffix" and by[4]["text"] is None and by[13]["n_removed"] == 11
    assert line_dedup(empty).count() == 0
    text = "\n".join(f"one of the many lines number {i % 15000}" for i in range(30000))
    r = line_dedup(written(spark.createDataFrame([(1, text)], "doc_id long, text string"), "long")).first()
    assert r.n_removed == 15000 and r.text == "\n".join(f"one of the many lines number {i}" for i in range(15000))


# -- 2 Jaccard join ----------------------------------------------------------------------------------------------


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    link = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    near = [[j for j in range(len(rows)) if j != i and link(sets[i], sets[j])] for i in range(len(rows))]
    seen, cls = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            stack, group = [i], []
            seen[i] = True
            while stack:
                x = stack.pop()
                group.append(x)
                for y in near[x]:
                    if y not in seen:
                        seen[y] = True
                        stack.append(y)
            ids = [rows[x][0] for x in group if rows[x][0] is not None]
            for x in group:
                cls[x] = min(ids) if ids else None
    return sorted((str(rows[i][0]), str(cls[i]), len(near[i])) for i in range(len(rows)))


def test_jaccard_brute(spark, odd, empty):
    from strandline.llm.jaccard_join import jaccard_join

    rng = np.random.RandomState(11)
    base = [[f"t{rng.randint(500)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randint(len(w))] = f"n{rng.randint(9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "a b", "a b c d e"])]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join(df).collect())
    assert got == brute_links(rows)
    pairs = [(r[0], r[1]) for r in odd_rows()]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join(odd).collect())
    assert got == brute_links(pairs)
    assert jaccard_join(empty).count() == 0


def test_large_buckets_in_blocks(spark, monkeypatch):
    from strandline.llm import jaccard_join as J

    monkeypatch.setattr(J, "SMALL", 4), monkeypatch.setattr(J, "BLOCK", 16), monkeypatch.setattr(J, "EXACT_BLOCK", 8)
    rng = np.random.RandomState(2)
    base = [f"t{i}" for i in range(150)]
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i, k in enumerate(rng.randint(0, 150, 70))]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "hot")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in J.jaccard_join(df).collect())
    assert got == brute_links(rows)


def test_a_hot_bucket_is_many_tasks(spark):
    from strandline.llm.jaccard_join import with_sizes

    rows = [(1, i) for i in range(3000)] + [(2, 5), (3, 1), (3, 2)]
    level = written(spark.createDataFrame(rows, "bucket long, node long"), "level")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = with_sizes(level).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    size = Counter(b for b, _ in rows)
    assert sorted((r.bucket, r.node, r.size) for r in got) == sorted((b, n, size[b]) for b, n in rows if size[b] > 1)
    tasks = Counter(r.task for r in got if r.bucket == 1)
    assert len(tasks) == 4 and max(tasks.values()) < 1500
    assert with_sizes(level.where("false")).count() == 0


def test_components(spark):
    from strandline.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 3)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 200, 300)}


def test_runs_reach_the_target():
    from strandline.llm.jaccard_join import LEVELS, TARGET, TOKENS, agreeing, missed, runs_for

    runs = runs_for(TARGET, 0.8, LEVELS)
    assert missed(runs, 0.8, LEVELS) <= 1 - TARGET < missed(runs - 1, 0.8, LEVELS)
    rng, n, least = np.random.RandomState(8), 20000, agreeing(0.8)
    same = rng.rand(n, TOKENS) < 0.8
    kept = same[:, :3].copy()
    for r in range(3):
        for _ in range(LEVELS - 1):
            first, step = rng.randint(0, TOKENS, n), rng.randint(1, TOKENS, n)
            kept[:, r] &= same[np.arange(n), first] | ((rng.rand(n) < 0.25) & same[np.arange(n), (first + step) % TOKENS])
    assert abs(1 - (kept.any(1) & (same.sum(1) >= least)).mean() - missed(3, 0.8, LEVELS)) < 0.01


# -- 3 BPE -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRICKY = ["hello  world\n\n foo's  bar 　　 x", "", "1" * 3000 + " 2", "\x1c \x1d a\x1c!", "<|endoftext|> the", "a" * 300, " \n\t  ", "é" * 50 + "  y 漢字 " + "ab" * 200, "x\u0085 \u0085y", None, "   a", "'s 't'll I'm"]


def test_bpe_round_trip(spark, odd, empty, reference):
    from strandline.llm.bpe import decode, encode, round_trip

    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = {r.doc_id: r for r in round_trip(df, path, P.PATTERN).collect()}
    parts = {r.doc_id: r for r in decode(encode(df, path, P.PATTERN), path, P.PATTERN).collect()}
    for i, t in rows:
        assert both[i].ids == parts[i].ids == reference.encode_ordinary(t or ""), t
        assert bytes(both[i].decoded) == bytes(parts[i].decoded) == (t or "").encode()
    assert round_trip(odd, path, P.PATTERN, odd.columns).where("ids IS NULL").count() == 0
    assert encode(empty, path, P.PATTERN).count() == 0


def contract(rank, word):
    """The rule by a heap of (rank, place) over a linked list of tokens: always the leftmost pair of the smallest rank."""
    n = len(word)
    token = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i] if token[i] is not None else n
        if j >= n or len(token[i]) + len(token[j]) != size or rank.get(token[i] + token[j]) != r:
            continue
        token[i], token[j], after[i] = token[i] + token[j], None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank.get(token[a] + token[b])) is not None:
                heapq.heappush(heap, (r, a, len(token[a]) + len(token[b])))
    return [rank[t] for t in token if t is not None]


def test_bpe_recursion_is_the_rule(reference):
    from strandline.llm.bpe import bpe_of

    b, _ = bpe_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.RandomState(0)
    some = [bytes(rng.choice(list(b"aeinrst hlo\xc3\xa9"), rng.randint(1, 30)).astype(np.uint8)) for _ in range(300)]
    some += [bytes(rng.choice(list(letters), n).astype(np.uint8)) for letters in (b"a", b"ACGT", b"abcdeinorst", "漢字仮名".encode()) for n in (65, 300, 700)] + [b"ab" * 50_000, b"a" * 100_001, "漢字仮名交じり文".encode() * 1500]
    assert [x.tolist() for x in b.encode_words(some)] == [contract(b.rank, w) for w in some]
    with pytest.raises(ValueError):
        b.decode(np.array([99_999]), np.array([0, 1]))


def test_bpe_long_words(spark, reference):
    """Words of any length: windows of them are joined to what the library gives for the whole."""
    from strandline.llm import bpe as B

    path = P.path("byte_bpe_50k.tiktoken")
    rng = np.random.RandomState(5)
    letters = lambda s, n: "".join(rng.choice(list(s), n))
    texts = ["a" * 1_000_000, letters("abcdefghijklmnopqrstuvwxyz", 1_000_000), "漢字仮名交じり文" * 45_000, "abc" * 350_000, "é" * 10_000_000, letters("ab", 100_000) + " and words", "x" * 65, "abcde" * 13]
    got = {r.doc_id: r for r in B.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert bytes(got[i].decoded) == t.encode() and (len(t) > 2_000_000 or got[i].ids == reference.encode_ordinary(t)), i
    b, _ = B.bpe_of(path, P.PATTERN)
    some = [bytes(rng.choice(list(s.encode()), n).astype(np.uint8)) for s in ("a", "ab", "abc", "etaoin", "0123456789") for n in (65, 127, 128, 129, 1000, 3001) for _ in range(4)]
    assert [x.tolist() for x in b.encode_words(some)] == [contract(b.rank, w) for w in some]


# -- 4 quality rules ---------------------------------------------------------------------------------------------


def base_of(t):
    w = words(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_statistics(spark, odd, empty):
    from strandline.llm.quality_rules import quality_rules

    out = quality_rules(odd, [[("symbols_per_word", True, 0.05)], [("words", False, 0.0)]])
    assert out.columns[:-1] == odd.columns
    for r in out.select("doc_id", "text", f"{out.columns[-1]}.*").collect():
        n, *_, rep = got = base_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == got
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and (not r.base_failed or not r.kept)
    assert quality_rules(empty, []).count() == 0


def test_quality_rules_learn(spark, sf_dir):
    from strandline.llm.quality_rules import cover, learn_rules

    x = np.random.RandomState(0).rand(900, 3)
    bad = (x[:, 0] > 0.8) & (x[:, 1] > 0.5) | (x[:, 2] < 0.1)
    rules = cover(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        inside = np.ones(len(x), bool)
        for j, above, t in r:
            inside &= (x[:, j] > t) == above
        hit |= inside
    assert (hit == bad).mean() > 0.97
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert learn_rules(docs, none) == []
    assert learn_rules(docs, spark.createDataFrame([(None, 0), (1, None), (99999, 0)], "doc_id long, quality int")) == []


# -- 5 id store --------------------------------------------------------------------------------------------------


def test_id_store(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    from strandline.llm.id_store import read_checksums, read_ids, write_store

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>\n\nb<|endoftext|>", "x<|endoftext|>\u3000 y <|endoftext", *TRICKY]
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(special * 2)], "doc_id long, text string")
    for name, df in (("odd", odd), ("empty", empty), ("tricky", tricky)):
        path = str(tmp_path / name)
        write_store(df, path, P.path("byte_bpe_50k.json"))
        ids = read_ids(spark, path).orderBy("start").collect()
        sums = read_checksums(spark, path).orderBy("start").collect()
        rows = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in rows)
        assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == want
        at = 0
        order = [r.doc_id for r in ids if r.doc_id is not None]
        assert order == sorted(order)
        for r, s in zip(ids, sums):
            assert r.start == s.start == at and r.n_tokens == len(r.ids) and s.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += len(r.ids)
    chunks = spark.read.parquet(str(tmp_path / "odd/chunks")).where("ids IS NOT NULL")
    assert chunks.count() == chunks.select("address").distinct().count()


def test_broken_store_raises(spark, tmp_path):
    from strandline.llm.id_store import read_checksums, read_ids, write_store

    path = str(tmp_path / "s")
    write_store(spark.createDataFrame([(1, "some words to keep"), (2, "others to lose")], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    bad = spark.read.parquet(f"{path}/chunks").withColumn("ids", F.expr("cast('xx' AS binary)"))
    bad.write.parquet(f"{path}/bad")
    import shutil

    shutil.rmtree(f"{path}/chunks")
    shutil.move(f"{path}/bad", f"{path}/chunks")
    for read in (read_checksums, read_ids):
        with pytest.raises(Exception, match="chunk"):
            read(spark, path).collect()


def test_altered_seals_raise(spark, tmp_path):
    import shutil

    from strandline.llm.id_store import read_checksums, read_ids, write_store

    path = str(tmp_path / "s")
    text = " ".join(f"word{i * i % 991}" for i in range(3000))
    write_store(spark.createDataFrame([(1, text), (2, text + " tail")], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    assert spark.read.parquet(f"{path}/recipes").where("size(addresses) > 1").count() == 2
    for table, column, value in (("recipes", "addresses", "reverse(addresses)"), ("recipes", "root", "cast('x' AS binary)"), ("manifests", "root", "cast('x' AS binary)"), ("manifests", "shard", "shard + 100"), ("store", "root", "reverse(root)")):
        other = str(tmp_path / f"{table}-{column}")
        shutil.copytree(path, other)
        shutil.rmtree(f"{other}/{table}")
        spark.read.parquet(f"{path}/{table}").withColumn(column, F.expr(value)).write.parquet(f"{other}/{table}")
        for read in (read_checksums, read_ids):
            with pytest.raises(Exception, match="don't match"):
                read(spark, other).collect()


def test_wide_ids_raise(spark, tmp_path):
    from strandline.llm.id_store import write_store

    with pytest.raises(Exception, match="doesn't fit"):
        write_store(spark.createDataFrame([(1, "many different words")], "doc_id long, text string"), str(tmp_path / "w"), P.path("byte_bpe_50k.json"), width=1)


def test_windows_of_any_size():
    h = ws.mix(np.arange(40, dtype=np.uint64))
    for size in (1, 2, 5, 7, 13, 16, 40):
        at, got = ws.windows(h, np.array([0, 17, 17, 40]), size)
        want = {i: ws.mix(np.array([sum(int(x) * pow(int(ws._STEP), size - 1 - j, 2**64) for j, x in enumerate(h[i : i + size])) % 2**64], np.uint64))[0] for a, b in ((0, 17), (17, 40)) for i in range(a, b - size + 1)}
        assert dict(zip(at.tolist(), got.tolist())) == want


def test_crc_of_joined_parts():
    from strandline.llm.id_store import _shifts, _times, merkle

    a, b = b"first part", b"and the second one"
    joined = _times(np.array([zlib.crc32(a)], np.uint32), _shifts(np.array([len(b)])))[0] ^ np.uint32(zlib.crc32(b))
    assert joined == zlib.crc32(a + b)
    assert merkle([]) != merkle([b"x"]) != merkle([b"x", b"x"])


# -- 6 substring dedup -------------------------------------------------------------------------------------------


def brute_substrings(rows, n=13):
    first = {}
    key = lambda d: 2**63 if d is None else d
    for doc, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, 2**64), key(doc))
    out = []
    for doc, t in rows:
        w = words(t)
        gone = {k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < key(doc) for k in range(i, i + n)}
        out.append((str(doc), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_brute(spark, odd, empty):
    from strandline.llm.substring_dedup import substring_dedup

    rng = np.random.RandomState(4)
    passages = [" ".join(f"p{rng.randint(50)}" for _ in range(rng.randint(10, 40))) for _ in range(8)]
    rows = [(i, " ".join([" ".join(f"f{rng.randint(300)}" for _ in range(rng.randint(0, 20))) if rng.rand() < 0.5 else passages[rng.randint(8)] for _ in range(4)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for given, frame in ((rows, df), ([(r[0], r[1]) for r in odd_rows()], odd)):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup(frame).collect())
        assert got == brute_substrings(given)
    assert substring_dedup(empty).count() == 0


def test_anchors_carry_the_result(spark, monkeypatch):
    """Anchors are few; most of a long repeat is matched from them alone, and windows travel only where places go on differently."""
    from strandline.llm import substring_dedup as S

    long = " ".join(f"w{i * 7919 % 10007}" for i in range(2000))
    texts = [long, "one two " + long + " three", long.replace("w7919 ", "")]
    a = S.Anchors(ws.Words(pa.array(texts)), 13, 7)
    assert len(a.hash) < 0.4 * len(a.at)
    docs = pa.table({"doc_id": pa.array([1, 2, 3]), "text": texts, "block": pa.array([0, 0, 0], pa.int32())})
    seeds = S._join_seeds(S._seeds(13, 7, 1)(docs))
    keys, rest = (len(ws.unpack(seeds.column(c), np.uint64)[0]) for c in ("keys", "rest"))
    assert keys > 0.9 * len(set(a.hash.tolist())) and 0 < rest < 20
    rows = list(zip([1, 2, 3], texts))
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "anchors")
    got = lambda: sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in S.substring_dedup(df).collect())
    assert got() == brute_substrings(rows)


# -- 7 mixing ----------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd, empty):
    from strandline.llm.mixing import mix_sources

    rng = np.random.RandomState(9)
    rows = [(i, " ".join(["w"] * int(rng.randint(0, 40))), str(rng.choice(["a", "b", "b", "b", "é", "z"])) if rng.rand() < 0.9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mix_sources(df, chunk=32).toPandas()
    again = mix_sources(df.repartition(3), chunk=32).toPandas()
    assert rows_of(out) == rows_of(again) and len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    for s, g in out.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert abs(g["target"].iloc[0] - want[s]) < 1e-6 and g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - want[s]) <= 40
    assert (out["taken"] <= 3 * out["size"]).all() and abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    odd_out = mix_sources(odd).toPandas()
    assert len(odd_out) == odd.count() and (odd_out["taken"] <= 3 * odd_out["size"]).all()
    assert mix_sources(empty).count() == 0


def test_mixing_is_unbiased(spark):
    from strandline.llm.mixing import mix_sources

    df = written(spark.createDataFrame([(i, "w " * (1 + i % 3), "ab"[i % 4 > 0]) for i in range(40)], "doc_id long, text string, source string"), "few")
    runs = [mix_sources(df, seed=s).select("doc_id", "copies", F.expr("target / source_size").alias("rate")).toPandas().set_index("doc_id") for s in range(12)]
    mean = sum(r["copies"] for r in runs) / len(runs)
    assert abs((mean - runs[0]["rate"]).mean()) < 0.05 and (mean - runs[0]["rate"]).abs().max() < 0.6


# -- 8 classifier ------------------------------------------------------------------------------------------------


def test_classifier(spark, odd, empty):
    from strandline.llm.quality_classifier import fit, score, train

    rng = np.random.RandomState(1)
    x = rng.rand(3000, 4)
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.7)).astype(float)
    forest = train(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    plain = np.full(5, forest.base)
    for t in range(len(forest.feature)):
        for i in range(5):
            node = 0
            while forest.feature[t][node] >= 0:
                node = forest.left[t][node] + (x[i, forest.feature[t][node]] > forest.threshold[t][node])
            plain[i] += forest.value[t][node]
    assert np.allclose(forest.score(x[:5]), 1 / (1 + np.exp(-plain)))
    none = spark.createDataFrame([], "doc_id long, quality int")
    f = fit(odd, none)
    assert {r.score for r in score(odd, f, odd.columns).collect()} == {0.5} and score(empty, f, ["doc_id"]).count() == 0


def test_classifier_held_out(spark):
    from strandline.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9


# -- 9 Matroska --------------------------------------------------------------------------------------------------


def test_matroska(spark, odd, empty):
    from strandline.llm.matroska import packets, parse, payload, read_back, seek, store, write_file

    media = written(store(odd), "media")
    got = read_back(media, ["doc_id", "media"]).collect()
    want = Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    pad = lambda b: b + bytes(-len(b) % 64 if b else 64)
    assert Counter((r.doc_id, bytes(r.payload)) for r in got) == Counter({(d, pad(b)): n for (d, b), n in want.items()})
    p = packets(media).where("doc_id = 9").orderBy("packet").collect()
    file = next(bytes(r.media) for r in got if r.doc_id == 9)
    assert b"".join(file[r.start : r.start + r.length] for r in p) == payload(file) and all(b.time_ns > a.time_ns for a, b in zip(p, p[1:]))
    m = parse(file)
    assert m.tracks[1].codec == "A_PCM/INT/LIT" and m.tracks[1].bits == 8 and all(file[c : c + 4] == bytes.fromhex("1F43B675") for _, _, c in m.cues)
    assert packets(store(empty)).count() == 0
    file = write_file(bytes(range(256)) * 2000)
    whole = parse(file)
    assert len(whole.cues) == 4 and all(seek(file, t)[0] in whole.packets and seek(file, t)[0][1] <= t for t in (0, 1, 20_000_000_000, 63_000_000_000))
    assert [p for t, _, _ in whole.cues for p in seek(file, t)] == whole.packets


def test_matroska_lacing_and_unknown_sizes():
    from strandline.llm import matroska as M

    def file(flags, body):
        block = b"\x81\x00\x05" + bytes([flags]) + body
        cluster = M._id(M.CLUSTER_ID) + b"\x01" + b"\xff" * 7 + M._uint(M.TIMESTAMP, 10) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK_ID, block))
        return M._HEAD + M._id(M.SEGMENT) + b"\xff" + M._INFO + M._TRACKS + cluster + M.element(M.CUES, b"")

    sizes = lambda b: [p[3] for p in M.parse(b).packets]
    assert sizes(file(0x00, b"abc")) == [3]
    assert sizes(file(0x02, b"\x02" + b"\xff\x01" + b"\x02" + b"x" * 256 + b"yy" + b"z")) == [256, 2, 1]
    assert sizes(file(0x06, b"\x02" + bytes([0x84, 0xBE]) + b"aaaa" + b"bbb" + b"cc")) == [4, 3, 2]
    assert sizes(file(0x04, b"\x01" + b"aabb")) == [2, 2]
    assert M.parse(file(0x00, b"abc")).packets[0][1] == 15_000_000
    for broken in (b"", b"\x00" * 20, file(0x04, b"\x01abc"), M._HEAD + M._id(M.SEGMENT) + b"\x8f" + b"x"):
        with pytest.raises(ValueError):
            M.parse(broken)


# -- 10 personal data --------------------------------------------------------------------------------------------


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(g) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(g)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


PRIVATE = [
    "a@b.cc_x@d.ee and a@b.cc.@x.yy", "1 2 3 4 " * 5000, "1" * 20000, "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.0001", "x 4111 1111 1111 1111 y 4111-1111--1111-1111 4111111111111111", "+49 (30) 123456-7 +1+2 +12345678901234567890 + 1",
    "", "😀😀 a@b.co 😀 1.1.1.1", None, "İ é ü +4930123456 bob@bob.bob@bob.com", "a" * 20000 + "@" + "b" * 10 + ".c", "-1-1 - 4111 1111 1111 1111-",
]


def test_base_spans(spark, odd, empty):
    from strandline.llm.pii import KINDS, find, sanitise

    df = written(spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE)], "doc_id long, text string, spans string"), "private")
    for r in find(df).collect():
        assert [(KINDS[s.kind], s.start, s.end) for s in r.spans if s.kind < 4] == base_spans(PRIVATE[r.doc_id] or ""), r.doc_id
    out = {r.doc_id: r for r in sanitise(df).collect()}
    assert out[7].text == "😀😀 <EMAIL> 😀 <IP>" and out[8].text is None and out[2].text == PRIVATE[2] and out[7].spans == "x"
    assert sanitise(odd).count() == odd.count() and find(empty).count() == 0


def test_disclosing_terms(spark):
    from strandline.llm.pii import find, sanitise

    rows = [(i, f"notice {i}: write to zorbulax at chief@corp.example for case {i * 7} of the board") for i in range(6)]
    rows += [(100 + i, " ".join(f"word{(i * k) % 400}x the of and for case board notice write" for k in range(1, 60))) for i in range(60)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "terms")
    found = {r.doc_id: [x for x in r.spans if x.kind == 5] for r in find(df).collect()}
    text = dict(rows)
    assert all({text[i][s.start : s.end] for s in found[i]} == {"zorbulax"} for i in range(6)) and not any(found[i] for i in found if i >= 100)
    assert "zorbulax" not in sanitise(df).where("doc_id = 0").first().text
    copies = written(spark.createDataFrame([(i, rows[0][1]) for i in range(20)] + rows[6:], "doc_id long, text string"), "copies")
    assert not any(s.kind == 5 for r in find(copies).collect() for s in r.spans)


def test_many_entities_in_one_text(spark):
    """Work is linear in the number of entities: 100,000 of them in one text of several MB."""
    from strandline.llm.pii import find, sanitise

    text = "".join(f"writes user{i}@site{i % 50}.example now\n" for i in range(100_000))
    df = written(spark.createDataFrame([(1, text), (2, "token = \"04dbebab91ab85687d33eeaa\" and password: short1 or API_KEY='abcdefghijklmnopq'")], "doc_id long, text string"), "dense").repartition(2)
    got = {r.doc_id: r.spans for r in find(df).collect()}
    assert [(s.start, s.end) for s in got[1] if s.kind == 0] == [m.span() for m in re.finditer(r"user[0-9]+@site[0-9]+[.]example", text)]
    assert [(s.kind, s.start, s.end) for s in got[2]] == [(4, 9, 33)]
    assert sanitise(df).where("doc_id = 1").first().text == re.sub(r"user[0-9]+@site[0-9]+[.]example", "<EMAIL>", text)


def test_planted_terms(spark):
    """Names that stand near one address in several texts are found, with precision and recall; the frequent words around them aren't."""
    from strandline.llm.pii import find

    rng = np.random.RandomState(12)
    name, rows = lambda i: "q" + "".join(chr(97 + (i * 7 + k * k * 3 + i // 26 * k) % 26) for k in range(7)) + str(i), []
    for i in range(40):
        for _ in range(4):
            fill = [" ".join(f"w{rng.randint(800)}e" for _ in range(rng.randint(3, 9))) for _ in range(2)]
            rows.append((len(rows), f"{fill[0]} {name(i)} person{i}@corp.example {fill[1]}"))
    rows += [(len(rows) + i, " ".join(f"w{rng.randint(800)}e" for _ in range(150))) for i in range(200)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "planted")
    text = dict(rows)
    marked = [text[r.doc_id][s.start : s.end] for r in find(df).collect() for s in r.spans if s.kind == 5]
    right = sum(x.startswith("q") for x in marked)
    assert right / len(marked) >= 0.99 and right / 160 >= 0.99


def test_disclosing_terms_everywhere(spark, tmp_path):
    import duckdb

    from strandline.llm.pii import sanitise

    rows = [(i, f"notice {i}: write to zorbulax at chief@corp.example for case {i * 7}" + " -" * 60 + " says Zorbulax" * (i == 0)) for i in range(6)]
    rows += [(10 + i, f"seen {i} times, zorbulax left the house") for i in range(3)] + [(20, "not zorbulax@other.example nor fouézorbulax"), (21, None)]
    rows += [(100 + i, " ".join(f"word{(i * k) % 4000}x" for k in range(1, 201))) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(QUERIES["op10_pii"](spark, str(tmp_path)).toPandas()) == rows_of(c.sql(ORACLE_SQL["op10_pii"]).df())
    out = {r.doc_id: r.text for r in sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("doc_id < 100").collect()}
    assert not any("zorbulax" in out[i].lower() for i in [*range(6), *range(10, 13)])
    assert out[10] == "seen 0 times, <TERM> left the house" and out[20] == "not <EMAIL> nor fouézorbulax" and out[21] is None


# -- the queries' digests ----------------------------------------------------------------------------------------


def test_digests(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_matroska"](spark, sf_dir).collect():
        b = docs[r.doc_id].encode()
        b += bytes(-len(b) % 64 if b else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]))
    for r in QUERIES["op10_pii"](spark, sf_dir).collect():
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op4_quality_rules"](spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_of(docs[r.doc_id])


def test_digests_of_ids(spark, sf_dir, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe"](spark, sf_dir).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
