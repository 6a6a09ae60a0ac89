"""Phrase mining against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import odd

from siftwell.llm import phrases

ROW = "lang string, text string"


def plainly(rows, min_count=30, max_words=4, held=80, most=2000):
    f, n, out = Counter(), Counter(), defaultdict(list)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    parts = lambda p: {p[:1] + p[s : s + m] for m in range(2, len(p) - 1) for s in range(1, len(p) - m + 1)}
    inside = {q for p, a in found.items() for q in parts(p) if 100 * a >= held * f[q]}
    for p, a in found.items():
        if p not in inside:
            cuts = [(f[p[: k + 1]], f[p[:1] + p[k + 1 :]]) for k in range(1, len(p) - 1)]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:most]))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = ["x", "y", "Z", "zz", ".", "x,", "\n", "\t", "é", "q!", "\r", "\xa0", "", "Ä"]
    return [(rnd.choice(["a", None, "und", "b"]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 200)))])) for _ in range(150)]


@pytest.mark.parametrize("how", [{"min_count": 3}, {"min_count": 5, "max_words": 5, "most": 7}, {"min_count": 2, "max_words": 2}, {"min_count": 12, "held": 40}, {"min_count": 3, "pair_bits": 64}])
def test_phrases(spark, rows, how):
    got = phrases.mine(spark.createDataFrame(rows, ROW), shard_words=500, **how)
    want = plainly(rows, **{k: v for k, v in how.items() if k != "pair_bits"})
    assert want and sorted(map(tuple, got.collect())) == want


def test_shards_of_any_size_and_ties(spark):
    rows = [("en", "one two three"), ("en", "two one. three two")] * 40 + [("en", "b a"), ("en", "a b")] * 33
    for size in (5, 10_000):
        got = phrases.mine(spark.createDataFrame(rows, ROW).repartition(3), shard_words=size).orderBy("rank")
        assert [tuple(r) for r in got.collect()] == [x for x in sorted(plainly(rows), key=lambda x: x[1])]


def test_intervals():
    """All phrases of an index and their counts, extended in any order of sides, against a count."""
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(0, 5, 400), 0)
    want = [Counter(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1) if text[i : i + k].all()) for k in range(5)]
    for sides in ((True, True, True), (False, False, False), (True, False, True), (False, True, False)):
        index = phrases.FmIndex(text, 4, 4)
        found = index.words()
        for k, right in enumerate(sides, 2):
            found = index.extend(*found, right=right)
            assert dict(zip(map(tuple, found[0].tolist()), found[3].tolist())) == dict(want[k])


def test_edges(spark):
    df = spark.createDataFrame([("en", "a b")], ROW)
    assert phrases.mine(df.limit(0)).count() == 0 and phrases.mine(df).count() == 0
    long = [("en", "left right " * 40_000), ("fr", None), (None, "")]
    df = spark.createDataFrame(long, ROW)
    for name in ("shard", "id", "word", "phrase", "n", "rank", "f", "places"):
        df = df.withColumn(name, F.lit("mine"))
    assert sorted(map(tuple, phrases.mine(df, shard_words=1000).collect())) == plainly(long)
    rows = [("und", r["text"]) for r in odd(spark).collect()]
    assert sorted(map(tuple, phrases.mine(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect())) == plainly(rows)


def test_counts_past_64_bits(spark):
    """The score is exact where 2 000 000 a passes a long."""
    a = 9_000_000_000_000
    df = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long")
    assert df.select(F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")).first()[0] == 2_000_000 * a // (2 * a + 3)
