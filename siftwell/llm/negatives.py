"""Hard-negative mining by inner product with cover trees.

Rows are dealt to shards of about `shard_rows` rows, and each shard is made into a cover tree once. Its
vectors get one more component, the root of what their squared norm lacks to the shard's largest, so
that they all have one norm and a nearest vector is one of the largest inner product. A node of the
tree covers its rows within a radius; its children are a net of half its radius, and so on down the levels. By
Cauchy-Schwarz the inner product of an anchor with any row of a node lies within |anchor| times the
radius of that with the node's centre.

Each anchor descends the trees of a group of shards best first, for its positives and then for the window of each
positive. Nodes outside the window, or below what the best found rows have, aren't entered; the
rows of the nodes that are entered are verified exactly. Each group of shards gives its first rows, of which the
first overall are taken. Groups and anchors are dealt by number, so no key is hot; a task holds the
trees of one group and one batch of anchors. Inner products are sums of integers in double precision,
exact up to 2^53; where the norms allow more, they are taken in integers of any size.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component take no part; an
empty vector is all zeros, and shorter vectors are filled up with zeros; ties go by the smaller id, rows that
repeat are rows of their own; an anchor without positives, or without rows in the window, gives no
row; an empty table gives none; extra columns are ignored, whatever their names. A score beyond a long is an error, and
the squares of components must fit a double.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import stored

#: Rows of a tree, and of a node that isn't divided.
SHARD_ROWS, LEAF_ROWS = 4096, 32
#: Rows of the trees that a task holds at least and at most; between these, the table is cut into `GROUPS`.
GROUP_ROWS, GROUPS = (4096, 65536), 32
EXACT = 2.0**53


class Tree:
    """A cover tree over the rows of a shard, laid out so that each node's own rows stand together."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        norms = (vectors**2).sum(1)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))])
        squares = (lifted**2).sum(1)
        self.order: list[int] = []
        nodes = []  # centre, radius, first own row, end of own rows, children

        def distances(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(squares[rows] + squares[centre] - 2 * (lifted[rows] @ lifted[centre]), 0))

        # each entry: rows, their centre, the node to hang below
        todo = [(np.arange(len(vectors)), 0, -1)] if len(vectors) else []
        while todo:
            rows, centre, above = todo.pop()
            away = distances(rows, centre)
            radius = float(away.max())
            if above >= 0:
                nodes[above][4].append(len(nodes))
            own, parts = rows, []
            if len(rows) > leaf_rows and radius > 0:
                half, rest, own = radius / 2, rows, []
                while len(rest):  # a net: each centre stands over half the radius from those before it
                    near = distances(rest, rest[0]) <= half
                    near[0] = True
                    part = rest[near]
                    if len(part) > leaf_rows // 4:
                        parts.append((part, int(part[0]), len(nodes)))
                    else:
                        own.append(part)
                    rest = rest[~near]
                own = np.concatenate(own) if own else rows[:0]
            nodes.append((centre, radius, len(self.order), len(self.order) + len(own), []))
            self.order += own.tolist()
            todo += parts
        self.centres = vectors[[x[0] for x in nodes]]
        # rounding of the distances is far below this
        self.radii = np.array([x[1] for x in nodes]) * (1 + 1e-6) + 1e-6 * np.sqrt(squares.max(initial=0))
        self.own = np.array([x[2:4] for x in nodes], np.int64).reshape(-1, 2)
        self.children = [np.array(x[4], np.int64) for x in nodes]


class Forest:
    """The trees of a group of shards, searched together."""

    def __init__(self, planted: list[tuple[Tree, tuple[np.ndarray, ...]]]):
        # each tree with its rows (vector, row, id, label) in its order
        self.trees, self.parts = [x[0] for x in planted], [x[1] for x in planted]
        self.largest = max((float(np.abs(p[0]).max(initial=0)) for p in self.parts), default=0.0)

    def search(self, anchor: np.ndarray, windows: list[tuple[int | None, int | None]], wanted, most: int) -> list[list[tuple[int, int, int]]]:
        """For each window (least, greatest score; None: open) the first `most` (score, id, row) of the rows that
        wanted(row, label) accepts."""
        q = anchor
        exact = float(np.abs(q).max(initial=0)) * self.largest * max(len(q), 1) < EXACT
        norm = float(np.sqrt((q**2).sum()))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: dict[tuple[int, int], tuple] = {}

        def bound(tree: int):
            if tree not in bounds:
                t = self.trees[tree]
                middle, reach = t.centres @ q, norm * t.radii
                slack = 1e-9 * norm * float(np.sqrt((t.centres**2).sum(1)).max(initial=0)) + 1
                bounds[tree] = middle - reach - slack, middle + reach + slack
            return bounds[tree]

        def verified(tree: int, node: int):
            if (tree, node) not in seen:
                first, end = self.trees[tree].own[node]
                vectors, row, vec_id, label = (x[first:end] for x in self.parts[tree])
                score = vectors @ q if exact else np.array([sum(int(a) * int(b) for a, b in zip(v, q)) for v in vectors], object)
                keep = wanted(row, label)
                seen[tree, node] = score[keep], vec_id[keep], row[keep]
            return seen[tree, node]

        out = []
        for low, high in windows:
            low_, high_ = (-np.inf if low is None else low), (np.inf if high is None else high)
            found: list[tuple[int, int, int]] = []
            heap = []

            def push(tree: int, node: int) -> None:
                least, greatest = bound(tree)
                if greatest[node] >= low_ and least[node] <= high_:
                    best = min(greatest[node], high_)
                    if len(found) < most or best >= found[-1][0]:
                        heapq.heappush(heap, (-best, tree, node))

            for tree, t in enumerate(self.trees):
                if len(t.own):
                    push(tree, 0)
            while heap:
                best, tree, node = heapq.heappop(heap)
                if len(found) == most and -best < found[-1][0]:
                    break
                score, vec_id, row = verified(tree, node)
                there = np.flatnonzero((score >= max(low_, found[-1][0] if len(found) == most else low_)) & (score <= high_))
                if len(there):
                    if exact and len(there) > most:  # the first of these by score and id
                        there = there[np.lexsort((row[there], vec_id[there], -score[there]))[:most]]
                    found += [(int(score[k]), int(vec_id[k]), int(row[k])) for k in there]
                    found = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:most]
                for child in self.trees[tree].children[node].tolist():
                    push(tree, child)
            out.append(found)
        return out


def _vector(values, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros."""
    out = np.zeros(width)
    found = np.floor(np.asarray(values, np.float64) * scale)
    out[: len(found)] = found
    return out


def _plant(rows: pa.Table, width: int, scale: float) -> pa.Table:
    """One row with the tree of a shard and its rows in the tree's order."""
    vectors = np.stack([_vector(x.values, width, scale) for x in rows.column("embedding")])
    tree = Tree(vectors)
    order = np.array(tree.order, np.int64)
    tree.order = []
    parts = (vectors[order], *(rows.column(x).to_numpy()[order] for x in ("row", "vec_id", "label")))
    return pa.table({"shard": rows.column("shard")[:1], "tree": pa.array([pickle.dumps((tree, parts))], pa.binary())})


def _search(trees: DataFrame, anchors: DataFrame, groups: int, same: bool, most: int, width: int, scale: float) -> DataFrame:
    """of, place (of the window), score, vec_id, row: the first `most` rows of each window of each anchor in each group.

    anchors: row, label, embedding, windows (array of low and high). Rows of the anchor's label are searched, or of all others.
    """
    names = ["of", "place", "score", "vec_id", "row"]
    planted = trees.select("grp", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("array<struct<low:long,high:long>>").alias("windows"), "tree")
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "row", "label", F.col("embedding").cast("array<double>").alias("embedding"), "windows", F.lit(None).cast("binary").alias("tree"))

    def run(batches):
        group, found_trees, forest = None, [], None
        for batch in batches:
            out = []
            for grp, of, own, vector, windows, tree in zip(*(batch.column(x) for x in ("grp", "row", "label", "embedding", "windows", "tree"))):
                if grp.as_py() != group:
                    group, found_trees, forest = grp.as_py(), [], None
                if tree.is_valid:
                    found_trees.append(pickle.loads(tree.as_py()))
                    continue
                if forest is None:  # a group's trees come before its anchors
                    forest = Forest(found_trees)
                of, own = of.as_py(), own.as_py()
                wanted = (lambda row, label: (label == own) & (row != of)) if same else (lambda row, label: label != own)
                results = forest.search(_vector(vector.values, width, scale), [(w["low"], w["high"]) for w in windows.as_py()], wanted, most)
                out += [(of, place, *x) for place, found in enumerate(results) for x in found]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    dealt = planted.unionByName(asking).repartition(groups, "grp").sortWithinPartitions("grp", F.col("tree").isNull(), "row")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each window over all groups, with their rank."""
    order = Window.partitionBy("of", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, shard_rows: int = SHARD_ROWS, group_rows: tuple[int, int] = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label (whole numbers). Scores are inner products of floor(scale * x). For each row that
    `anchors` accepts, its first `positives` other rows of the same label, and for each of these the first
    `negatives` rows of other labels that score from low to high per cent of it.
    """
    unfit = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~unfit)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", anchors.alias("is_anchor"))
    rows = stored(rows, "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows))
    in_group = max(1, min(group_rows[1], max(group_rows[0], n // GROUPS)) // shard_rows)
    groups = -(-shards // in_group)
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "vec_id", "label", "embedding")
    trees = dealt.groupBy("shard").applyInArrow(lambda t: _plant(t, width, scale), "shard int, tree binary")
    trees = stored(trees.select(F.expr(f"shard div {in_group}").cast("int").alias("grp"), "tree"), "trees")
    asking = rows.where("is_anchor").select("row", "vec_id", "label", "embedding")

    open_window = F.expr("array(named_struct('low', cast(null as long), 'high', cast(null as long)))")
    found = _first(_search(trees, asking.withColumn("windows", open_window), groups, True, positives, width, scale), positives)
    found = stored(found.select("of", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers between low and high per cent of the score
    wide = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct(F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"))
    windows = found.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", window.alias("w")))), lambda x: x["w"]).alias("windows"))
    again = asking.join(windows, asking["row"] == windows["of"]).select("row", "label", "embedding", "windows")
    hard = _first(_search(trees, again, groups, False, negatives, width, scale), negatives)
    hard = hard.select("of", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asking.select(F.col("row").alias("of"), F.col("vec_id").alias("anchor_id"))
    return hard.join(found, ["of", "place"]).join(ids, "of").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
