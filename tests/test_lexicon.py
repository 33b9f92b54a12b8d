"""Tokens by a dictionary: all ways to cut tried one by one, unknown words, stems, and limits."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import lexicon as L
from strandline.functions import text as X


def every_cut(run):
    for at in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [i + 1 for i, x in enumerate(at) if x] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends)]


def test_lattice_is_the_cheapest_of_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        scores = {"".join(rng.choices("ab東12", k=rng.randint(1, 3))): rng.randint(1, 9) for _ in range(rng.randint(1, 6))}
        run = "".join(rng.choices("abc東12", k=rng.randint(1, 9)))
        total = sum(scores.values())
        cost = {w: -math.log(s / total) for w, s in scores.items()}
        rare = max(cost.values()) + 1

        def price(cut):
            at, out = 0, 0.0
            for w in cut:
                end, ways = at + len(w), [cost[w]] if w in cost else []
                same = len({L.char_class(c) for c in w}) == 1
                apart = (not at or L.char_class(run[at - 1]) != L.char_class(w[0])) and (end == len(run) or L.char_class(run[end]) != L.char_class(w[0]))
                if len(w) == 1 or (same and apart):
                    ways.append(rare * (1 + len(w)))
                out, at = out + min(ways, default=math.inf), end
            return out

        got = L.lattice(scores)(run)
        assert "".join(got) == run
        assert price(got) == pytest.approx(min(map(price, every_cut(run))))


def test_japanese_with_unknown_words():
    cut = L.lattice({"私": 5, "は": 9, "学生": 4, "です": 8, "学": 1, "生": 1, "東京": 3, "に": 7})
    assert cut("私は学生です") == ["私", "は", "学生", "です"]
    assert cut("東京にスカイツリー2024年 abc") == ["東京", "に", "スカイツリー", "2024", "年", "abc"]
    assert L.lattice({})("ab 1") == ["ab", "1"] and cut("") == []
    assert sum(map(len, cut("学生" * 100_000))) == 200_000


def test_stems():
    cut = L.stems({"학교": 1.0, "학교에": 1.0, "나": 1.0, "가방": 2.0, "가방을": 1.0})
    assert cut("학교에서 나는 가방을 몰라요") == ["학교에", "서", "나는", "가방", "을", "몰라요"]
    assert L.stems({})(" a  bc\n") == ["a", "bc"]


def test_columns_and_limits(spark):
    words = spark.createDataFrame([("東京", 1.0), ("都", 1.0), ("都", 1.0), ("", 1.0), (None, 1.0), ("x", 0.0)], "word string, score double")
    scores = L.dictionary_of(words)
    assert scores == {"東京": 1.0, "都": 2.0}
    with pytest.raises(ValueError, match="at most 5"):
        L.dictionary_of(words, 5)
    rows = spark.createDataFrame([(1, "東京都。", "JA"), (2, None, "ja"), (3, "a b", "en"), (4, "", "ja")], "i int, t string, lang string")
    out = rows.select("i", X.tokens(F.col("t"), F.col("lang"), {"ja": L.tokens_by(L.lattice(scores))}).alias("w")).collect()
    assert {r["i"]: r["w"] for r in out} == {1: ["東京", "都"], 2: [], 3: ["a", "b"], 4: []}
