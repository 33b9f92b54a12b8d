"""Flat vectors by ranges of records, and WAV files by the heads of their chunks."""

import struct

import numpy as np
import pytest

from strandline.sources import ranged, readers


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_vectors_by_ranges(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(ranged, "RANGE", 100)  # eight records of three floats a task
    x = np.random.default_rng(n).standard_normal((n, 3)).astype("<f4")
    folder = tmp_path / "a b"  # a path that is written otherwise in a URI
    folder.mkdir()
    (folder / "t.txt").write_text("".join(f"line {i}\n" for i in range(n)))
    (folder / "v.bin").write_bytes(x.tobytes())
    got = readers.embeddings(spark, str(folder / "t.txt"), str(folder / "v.bin"))
    assert {r["text"]: r["vec"] for r in got.collect()} == {f"line {i}": v.tolist() for i, v in enumerate(x)}
    raw = spark.read.format("flat_vectors").options(dim=3, length=n * 12, range=100).load(str(folder / "v.bin"))
    assert raw.rdd.getNumPartitions() == -(-n // 8)


def test_a_file_that_ends_early(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n")
    (tmp_path / "v.bin").write_bytes(bytes(20))
    with pytest.raises(ValueError, match="divide"):
        readers.embeddings(spark, str(tmp_path / "t.txt"), str(tmp_path / "v.bin"))
    spark.dataSource.register(ranged.flat_vectors())
    short = spark.read.format("flat_vectors").options(dim=3, length=24).load(str(tmp_path / "v.bin"))
    with pytest.raises(Exception, match="ends within record 1"):
        short.collect()


def test_wav_heads(spark, tmp_path):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    riff = lambda *chunks: b"RIFF" + struct.pack("<I", 4 + sum(map(len, chunks))) + b"WAVE" + b"".join(chunks)
    data = b"data" + struct.pack("<I", 8000) + bytes(8000)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    cases = {"plain": (riff(fmt, data), 0.5), "odd": (riff(odd, fmt, odd, data), 0.5), "cut": (riff(fmt, data)[:-4000], 0.25), "empty": (b"", 0.0), "other": (b"RIFX" + bytes(40), 0.0), "no_fmt": (riff(data), 0.0), "half": (riff(fmt)[:30], 0.0)}
    for name, (content, _) in cases.items():
        (tmp_path / f"{name} %41.wav").write_bytes(content)
        assert readers.wav_seconds(content) == cases[name][1]
    got = {r["path"].rsplit("/", 1)[1].split("%")[0].strip(): r["seconds"] for r in readers.wav_durations(spark, str(tmp_path)).collect()}
    assert got == {k: s for k, (_, s) in cases.items() if k != "empty"}  # Spark lists no empty files
