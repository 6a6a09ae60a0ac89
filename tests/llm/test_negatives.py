"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import negatives

ROW = "vec_id long, embedding array<double>, label int"


def plainly(rows, every, positives=5, most=10, low=30, high=90):
    fit = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(fit):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for m, (j, _, w) in enumerate(fit) if m != k)
            own = [(-s, j) for s, j, m in scored if fit[m][1] == label][:positives]
            others = [(-s, j) for s, j, m in scored if fit[m][1] != label]
            for p, pj in own:
                out += [(i, pj, rank, j, p, s) for rank, (s, j) in enumerate([x for x in others if low * p <= 100 * x[0] <= high * p][:most], 1)]
    return sorted(out)


def made(n, width, clusters, labels, seed=5):
    """Rows about a few centres, many equal, some odd: nulls, infinities, short vectors, repeated ids."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        v = [float(round(x)) for x in c] if rnd.random() < 0.2 else [x + rnd.gauss(0, 0.05) for x in c]
        kind = rnd.random()
        v = None if kind < 0.03 else v[:-1] + [rnd.choice([None, float("nan"), float("inf")])] if kind < 0.06 else v[: rnd.randint(0, width)] if kind < 0.09 else v
        rows.append((rnd.choice([i, i, i, None if rnd.random() < 0.1 else i // 3]), v, rnd.choice([None] + list(range(labels)) * 5)))
    return rows


@pytest.mark.parametrize(
    ("shape", "how"),
    [((500, 6, 12, 3), {"shard_rows": 100, "group_rows": (200, 300)}), ((250, 3, 2, 2), {}), ((300, 8, 300, 5), {"shard_rows": 64, "group_rows": (64, 64), "positives": 3, "negatives": 4, "low": 50, "high": 99})],
)
def test_mining(spark, shape, how):
    rows = made(*shape)
    got = negatives.mine(spark.createDataFrame(rows, ROW).repartition(3), F.col("vec_id") % 10 == 0, **how)
    want = plainly(rows, 10, how.get("positives", 5), how.get("negatives", 10), how.get("low", 30), how.get("high", 90))
    assert want and sorted(map(tuple, got.collect())) == want


def test_sums_past_double_precision(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * 2.0**21 for _ in range(40)], i % 3) for i in range(90)]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, ROW), F.col("vec_id") % 10 == 0).collect())) == plainly(rows, 10)


def test_tree_covers_its_rows_and_skips():
    rnd = np.random.default_rng(1)
    vectors = np.floor(256 * np.concatenate([c + rnd.normal(0, 0.02, (200, 16)) for c in rnd.normal(0, 1, (10, 16))]))
    tree = negatives.Tree(vectors)
    assert sorted(tree.order) == list(range(len(vectors)))
    lifted = np.column_stack([vectors, np.sqrt((vectors**2).sum(1).max() - (vectors**2).sum(1))])
    below = lambda k: list(range(*tree.own[k])) + [x for c in tree.children[k] for x in below(c)]
    for k in range(len(tree.own)):
        centre = np.flatnonzero((vectors == tree.centres[k]).all(1))[0]
        assert np.sqrt(((lifted[np.array(tree.order)[below(k)]] - lifted[centre]) ** 2).sum(1)).max() <= tree.radii[k]
    order, rows = np.array(tree.order), np.arange(len(vectors))
    forest = negatives.Forest([(tree, (vectors[order], rows[order], rows[order], rows[order] % 2))])
    met = []
    found = forest.search(vectors[0], [(None, None)], lambda row, label: (met.extend(row.tolist()), row != 0)[1], 5)[0]
    want = sorted((-int(s), r) for r, s in enumerate(vectors @ vectors[0]) if r)[:5]
    assert [(-s, i) for s, i, _ in found] == want and len(met) < len(vectors) / 3


def test_equal_vectors_make_one_node():
    tree = negatives.Tree(np.ones((5000, 4)))
    assert len(tree.own) == 1 and len(tree.order) == 5000
    assert len(negatives.Tree(np.zeros((0, 4))).own) == 0


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, None, 1), (2, [2.0], None), (None, [1.0], 1)], ROW)
    for name in ("row", "of", "shard", "rank", "tree", "windows", "anchor_id"):
        df = df.withColumn(name, F.lit("mine"))
    assert negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0 and negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.5], i % 2) for i in range(30)] + [(40 + i, [0.5, 0.5], i % 2) for i in range(30)], ROW)
    got = sorted(map(tuple, negatives.mine(same, F.col("vec_id") == 0).collect()))
    assert len(got) == 50 and [r[3] for r in got[:10]] == [41, 43, 45, 47, 49, 51, 53, 55, 57, 59] and {r[1] for r in got} == {2, 4, 6, 8, 10}
