"""Piecewise fingerprints against a byte-by-byte build and a plain edit distance, and the defined cases."""

import hashlib
import zlib

import numpy as np

from strandline.llm import piecewise as C
from strandline.llm.common import written

SCHEMA = "doc_id long, text string, part int, fingerprint string, hash string, is_last boolean, following string"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_ends(data):
    """For each byte, the hash of the last seven, plus one."""
    out = []
    for p in range(len(data)):
        total = 0
        for k in range(min(7, p + 1)):
            v = ((data[p - k] + 1) * 0x9E3779B1) % 2**32
            total += (v ^ (v >> 15)) * 0x01000193 ** (k + 1)
        total %= 2**32
        total = ((total ^ (total >> 16)) * 0x85EBCA6B) % 2**32
        out.append((total ^ (total >> 13)) + 1)
    return out


def plain_fingerprint(data):
    ends, size = plain_ends(data), 3
    pieces = lambda b: [0] + [p + 1 for p, e in enumerate(ends) if e % b == 0 and p + 1 < len(data)] + [len(data)]
    while sum(e % size == 0 for e in ends) > 63:
        size *= 2
    sign = lambda b: "".join(BASE64[zlib.crc32(data[i:j]) % 64] for i, j in zip(pieces(b), pieces(b)[1:]))
    return f"{size}:{sign(size)}:{sign(2 * size)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j], row[j + 1])
    return row[-1]


def plain_likeness(f, g):
    if f == g:
        return 1.0
    (n, a, b), (m, c, d) = f.split(":"), g.split(":")
    n, m = int(n), int(m)
    pairs = [(a, c), (b, d)] if n == m else [(a, d)] if n == 2 * m else [(b, c)] if m == 2 * n else []
    shares = lambda x, y: any(x[i : i + 4] in y for i in range(len(x) - 3))
    return max((1 - plain_distance(x, y) / (len(x) + len(y)) for x, y in pairs if shares(x, y)), default=0.0)


def plain(rows):
    """Rows by doc_id, each with its next one."""
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        f, g, h = (plain_fingerprint(x.encode()) for x in (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(plain_likeness(f, g), 9), round(plain_likeness(f, h), 9)))
    return out


def shown(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=str)


def texts():
    rng = np.random.RandomState(4)
    story = " ".join(f"word{rng.randint(900)}" for _ in range(700))
    return ["", None, "a", "ab", "aaaaaaaaaa" * 50, "é漢😀" * 40, story, story[:3000] + "changed" + story[3000:], story, "short text", "short text", "0123456" * 9, "\x00\x00\x00", *(" ".join(f"w{rng.randint(50)}" for _ in range(n)) for n in range(1, 60, 3))]


def test_fingerprints(monkeypatch):
    data = [(t or "").encode() for t in texts()]
    want = [plain_fingerprint(d) for d in data]
    assert [C.written_out(*f) for f in C.fingerprints(data)] == want == [C.written_out(*C.fingerprints([d])[0]) for d in data]
    monkeypatch.setattr(C, "_STEP", 11)
    assert [C.written_out(*f) for f in C.fingerprints(data)] == want
    assert [C.parsed(w) for w in want] == C.fingerprints(data) and max(len(x) for f in C.fingerprints(data) for x in f[1:]) <= 64


def test_likeness():
    rng = np.random.RandomState(9)
    sign = lambda n: bytes(rng.choice(list(C.ALPHABET[:6]), n).tolist())
    found = [(int(rng.randint(0, 3)), sign(rng.randint(1, 65)), sign(rng.randint(1, 33))) for _ in range(600)]
    a, b = found[:300] + found[:9], found[300:] + found[:9]
    want = [plain_likeness(C.written_out(*x), C.written_out(*y)) for x, y in zip(a, b)]
    assert np.allclose(C.likeness(a, b), want) and 0 in want and 1 in want and any(0 < w < 1 for w in want)
    assert len(C.likeness([], [])) == 0


def test_edits_keep_likeness():
    rng = np.random.RandomState(3)
    near, far = [], []
    for n in (60, 400, 3000, 20000):
        t = " ".join(f"w{rng.randint(5000)}" for _ in range(n)).encode()
        u = " ".join(f"w{rng.randint(5000)}" for _ in range(n)).encode()
        i = len(t) // 3
        changed = [t[:i] + b" put in " + t[i:], t[:i] + t[i + 20 :], t[:i] + b"X" + t[i + 1 :]]
        f, g = C.fingerprints([t] * 3), C.fingerprints(changed)
        near += C.likeness(f, g).tolist()
        far += C.likeness(C.fingerprints([t]), C.fingerprints([u])).tolist()
    assert min(near) > 0.8 and max(far) == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = C.op13_piecewise(spark, sf_dir)
    assert shown(got) == sorted(plain(docs), key=str)
    rows = got.collect()
    changed = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited for r in changed]) > 0.4 > np.mean([r.near_next for r in changed])


def test_odd_rows(spark):
    rows = [(i, t, 1, "f", "h", True, "x") for i, t in enumerate(texts())]
    for parts in (1, 5):
        df = written(spark.createDataFrame([*rows, (None, "the one without an id", *rows[0][2:])], SCHEMA).repartition(parts), "odd")
        assert shown(C.with_next(df)) == sorted(plain(df.collect()), key=str)
    for few in ([], rows[6:7], rows[6:8], [rows[6]] * 9):
        df = written(spark.createDataFrame(few, SCHEMA), "few")
        assert shown(C.with_next(df)) == sorted(plain(few), key=str)
    long = written(spark.createDataFrame([(1, "0123456789 abcde " * 600_000), (2, "x" * 1_000_000)], "doc_id long, text string"), "long")
    got = {r.doc_id: r for r in C.with_next(long).collect()}
    assert got[1].n_chars == 10_200_000 and got[2].near_next == 0


def test_table_functions(spark):
    df = written(spark.createDataFrame([(i, t, 1, "f", "h", True, "x") for i, t in enumerate(texts())], SCHEMA), "texts")
    out = C.fingerprinted(df)
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "fingerprint_"] and [r.fingerprint_ for r in out.orderBy("doc_id").collect()] == [plain_fingerprint((t or "").encode()) for t in texts()]
    pairs = spark.createDataFrame([("3:ABCD:A", "3:ABCDE:A"), (None, "3:A:A"), ("3:A:A", "3:A:A")], "a string, b string")
    assert [None if r.likeness is None else round(r.likeness, 6) for r in C.compare(pairs, "a", "b").collect()] == [round(8 / 9, 6), None, 1.0]
