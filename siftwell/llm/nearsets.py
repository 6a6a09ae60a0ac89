"""Near-duplicates by SimHash and the Jaccard similarity of word shingles.

Words are those of the lower-cased (A-Z) text; a text is the set of its shingles of five words, by XXH64. Two texts are
linked if their sets have a similarity of 0.8 or more. First come the links of `simhash` (four bands, bit planes, at most 3
differing bits) over the fingerprints of the sets, each held against the sets. A pair at 0.8 can differ in more, so
what is left is looked for without it: MinHash picks the texts that can have a partner: `bands` keys
of `rows` minima each, of which a pair at 0.8 shares one with a chance of 1 - (1 - 0.8^5)^20 =
0.9996, and a closer pair sooner. Among those, sets meet by their rarest shingles, of which two similar sets must share one, and
only where the places of that shingle in both leave the similarity possible; both tests are exact. Every candidate
is then held against the sets themselves, so that no pair under 0.8 is linked.

Texts with equal sets are one node. In a bucket (nodes with a key in common) all nodes are first
compared with one of them, `stars` times with another one each; nodes that are in one component by
then need no comparison, the others are compared where they can be similar. So a large group of near copies
doesn't give all its pairs, and none is left out.

Edge cases: null and empty texts have the empty set and are equal; a text of under five words is one
shingle; very long texts are taken whole; a similarity of exactly 0.8 links; of a component the row with the smallest doc_id stays, a null doc_id only if there is no other;
an empty table gives no row. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import simhash
from siftwell.llm.common import schema_with, small_batches, stored, whole_row
from siftwell.llm.graph import components

SHINGLE, SEED = 5, 42
#: Similarity of linked texts, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS, STARS = 20, 5, 2
_draw = np.random.default_rng(SEED)
FLIPS, FACTORS = (_draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band, from the minima of its hash functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[k : k + (1 << 12), None] ^ FLIPS) * FACTORS).min(axis=0))
    raw = least.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, _doc, node (what stands for the set), fp (its SimHash fingerprint) and keys."""
    small_batches(docs.sparkSession)
    packed = docs.select("doc_id", whole_row(docs).alias("_doc"), F.col("text").alias("_text"))
    schema = schema_with(packed.drop("_text").schema, "node long, fp long, keys array<long>")

    def read(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column("_text").to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_doc"), pa.array(nodes), pa.array(fps), listed], names=["doc_id", "_doc", "node", "fp", "keys"])

    return packed.mapInArrow(read, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """node and its set, 8 bytes a shingle."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(read, "node long, hashes binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose sets are similar enough."""

    def read(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                n = (len(a) + len(b)) // 8
                if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append(UNDER * both >= OVER * (n - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(read, "u long, v long")


def _prefixes(sets: DataFrame) -> DataFrame:
    """node, n, key, at: of each set its rarest shingles and their places, so many that two similar sets must have one of them in common.

    In one order of all shingles, here by how many of the sets have them, the first n - ceil(0.8 n) + 1 of two sets with a
    similarity of 0.8 or more overlap. Shingles that one set alone has come first and join nothing.
    """

    def read(batches):
        for batch in batches:
            each = [np.frombuffer(h, np.int64) for h in batch.column("hashes").to_pylist()]
            sizes = [len(e) for e in each]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), sizes)), pa.array(np.concatenate([*each, np.zeros(0, np.int64)])), pa.array(np.repeat(np.array(sizes, np.int32), sizes))], names=["node", "key", "n"])

    every = stored(sets.mapInArrow(read, "node long, key long, n int"), "set-shingles")
    common = every.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rare = every.join(common, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("shared"))
    # n - ceil(0.8 n) + 1 less those of the set alone
    left = F.col("n") - F.ceil(F.col("n") * OVER / UNDER) + 1 - (F.col("n") - F.size("shared"))
    own = F.col("n") - F.size("shared")
    picked = rare.where(left > 0).select("node", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), left.cast("int"))).alias("k", "s"))
    return picked.select("node", "n", "s.key", (F.col("own") + F.col("k")).alias("at"))


def _may_link(at: Column, n: Column, other_at: Column, other_n: Column) -> Column:
    """Whether sets of n and other_n shingles, whose first common one has these places in them, can be similar enough.

    What comes before the first common one is in one of them only: o common and d others make a similarity of o / (o + d).
    """
    return OVER * (at + other_at) <= (UNDER - OVER) * F.least(n - at, other_n - other_at)


def _near_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs u, v of nodes by SimHash: those of equal fingerprints, and the links of fingerprints at most 3 bits apart, by the least node of each."""
    nodes = rows.select("node", "fp").distinct()
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "distinct-fingerprints")
    equal = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    linked = simhash.links(least.select("fp")).join(end("u"), "u").join(end("v"), "v")
    return stored(equal.unionByName(linked.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))).distinct(), "near-fingerprints")


def _roots(rows: DataFrame, stars: int = STARS) -> DataFrame | None:
    """node and root for each node that has a link; None if there is no candidate."""
    keyed = rows.select("node", F.explode("keys").alias("key"))
    several = lambda df: df.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    near = _near_fingerprints(rows)
    by_minima, by_bits = keyed.join(several(keyed), "key").select("node"), near.select(F.explode(F.array("u", "v")).alias("node"))
    met = stored(by_minima.unionByName(by_bits).distinct(), "candidate-nodes")
    if met.isEmpty():
        return None
    one = rows.join(met, "node", "left_semi").groupBy("node").agg(F.min("_row").alias("_row"))
    sets = stored(_sets(rows.join(one.select("_row"), "_row", "left_semi").select("node", F.col("_doc.text").alias("text"))), "candidate-sets")
    prefixes = stored(_prefixes(sets), "prefixes")
    members = stored(prefixes.join(several(prefixes), "key"), "buckets")
    links = stored(_similar(near, sets), "similar")
    roots = components(links)
    for k in range(stars + 1):
        now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # first the set with the fewest rare shingles, likely what the others were made of, then any
        turn = F.col("at").cast("long") if k == 0 else F.xxhash64("node", F.lit(k))
        centre = F.min(F.struct(turn.alias("turn"), "node", "root", "at", "n")).alias("centre")
        open_ = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), centre).where("low < high").select("key", "centre")
        if k < stars:
            met = now.join(open_, "key").where(F.col("root") != F.col("centre.root"))
            found = met.where(_may_link(F.col("at"), F.col("n"), F.col("centre.at"), F.col("centre.n"))).select("node", F.col("centre.node").alias("other"))
        else:
            still = now.join(open_.select("key"), "key", "left_semi").select("key", "node", "root", "at", "n")
            others = still.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "at", "n")])
            found = still.join(others, (still["key"] == others["key"]) & (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")) & _may_link(F.col("at"), F.col("n"), F.col("other_at"), F.col("other_n")))
            found = found.select("node", F.col("other_node").alias("other"))
        pairs = stored(found.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(), "candidates")
        if pairs.isEmpty():
            break
        links = links.unionByName(stored(_similar(pairs, sets), "similar"))
        roots = components(links)
    return roots


def one_of_each(docs: DataFrame, stars: int = STARS) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of rows that repeat it the first as written."""
    rows = stored(_marked(docs).withColumn("_row", F.monotonically_increasing_id()), "marked-sets")
    roots = _roots(rows, stars)
    first = rows.select("node", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("place")).groupBy("node").agg(F.min("place").alias("place"))
    if roots is not None:
        first = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("place").alias("place"))
    return rows.join(first.select("place._row"), "_row", "left_semi").select("_doc.*")
