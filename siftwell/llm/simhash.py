"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint: words of the lower-cased (A-Z) text, shingles of three words, XXH64 with seed 42
of each; a bit is set where more than half of the hashes have it.

Links (at most 3 differing bits): two such fingerprints agree in one of four 16-bit bands, so
each distinct fingerprint goes to four buckets. A bucket of over `bucket_rows` is dealt again by
the four parts of its other 48 bits, of which one must agree too, and what is still larger is
cut into blocks whose pairs are compared in tasks of their own. Inside a bucket fingerprints
are stored as bit planes; a query's distance to all of them is counted at once by two
carry-save counter planes and an overflow plane, and queries whose block has overflowed
everywhere are abandoned. A bucket gives one link for each member of a linked group, not all
its pairs.

Edge cases: null and empty texts have the fingerprint zero and are linked like any other; a text
of one or two words is one shingle; repeated rows share their component; a null doc_id never is
the smallest unless a component has no other; an empty table gives no row. Extra columns are
kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, stored
from siftwell.llm.graph import components

RADIUS, SEED, SHINGLE = 3, 42, 3
BUCKET_ROWS = 8192
#: Rows compared together although their buckets are smaller.
BLOCK_ROWS = 256


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (doc_id) and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["fp long"])

    def read(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fps)], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(read, schema)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of each fingerprint, 64 fingerprints a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    wide[:, : len(fps)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS, step: int = 8) -> np.ndarray:
    """For each query a row of words whose bits mark the fingerprints in planes (n of them) at most `radius` (3) bits away."""
    assert radius == 3, "the two counter planes hold distances up to 3"
    words = planes.shape[1]
    out = np.zeros((len(queries), words), np.uint64)
    beyond = np.full(words, ~np.uint64(0))
    beyond[: n // 64] = 0
    if n % 64:
        beyond[n // 64] = ~np.uint64(0) << np.uint64(n % 64)
    live = np.arange(len(queries))
    ones, twos = np.zeros((len(queries), words), np.uint64), np.zeros((len(queries), words), np.uint64)
    over = np.tile(beyond, (len(queries), 1))
    for bit in range(64):
        flip = np.uint64(0) - ((queries[live] >> np.uint64(bit)) & np.uint64(1))
        differ = planes[bit][None, :] ^ flip[:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if bit % step == step - 1 and bit < 63:  # abandon what has overflowed everywhere
            open_ = (over != ~np.uint64(0)).any(axis=1)
            if not open_.all():
                live, ones, twos, over = live[open_], ones[open_], twos[open_], over[open_]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def linked_groups(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(fingerprint, root) for each member but the least of every linked group of `left`, or of left and right."""
    fps = np.unique(left if right is None else np.concatenate([left, right]))
    n, planes = len(fps), planes_of(fps)
    rows = max(64, min(4096, (1 << 21) // max(1, planes.shape[1])))
    links: list[tuple[int, int]] = []
    seen = np.zeros(n, bool)
    near: dict[int, np.ndarray] = {}
    for k in range(0, n, rows):
        found = within(fps[k : k + rows], planes, n)
        several = np.bitwise_count(found).sum(axis=1) > 1
        near |= {k + int(i): found[i] for i in np.flatnonzero(several)}
    for first in sorted(near):
        if seen[first]:
            continue
        seen[first] = True
        front = [first]
        while front:
            reached = np.bitwise_or.reduce([near[i] for i in front])
            members = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little")[:n])
            front = [int(i) for i in members if not seen[i]]
            seen[front] = True
            links += [(int(fps[i]), int(fps[first])) for i in front]
    return links


def _compare(batches):
    """Links inside runs of rows with the same key; small buckets share a block."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    signed = lambda pairs: pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*pairs)], schema=schema)
    kept: list[np.ndarray] = []
    held, key = 0, None
    links: list[tuple[int, int]] = []

    def flush():
        nonlocal kept, held
        if held > 1:
            links.extend(linked_groups(np.concatenate(kept).view(np.uint64)))
        kept, held = [], 0

    for batch in batches:
        keys, fps = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(keys)]]).tolist()):
            if a == b:
                continue
            if keys[a] != key and held >= BLOCK_ROWS:
                flush()
            key = keys[a]
            kept.append(fps[a:b])
            held += b - a
        if len(links) > 50_000:
            yield signed(links)
            links = []
    flush()
    if links:
        yield signed(links)


def _run(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_compare, "u long, v long")


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links u, v that connect all fingerprints at most 3 bits apart. fps: distinct fp."""
    band = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keyed = fps.select("fp", F.explode(F.array(*[(F.lit(k) * 65536 + band(k)).cast("long") for k in range(4)])).alias("key"))
    keyed, large = _without_large(keyed, bucket_rows)
    out = _run(keyed)
    if large is None:
        return out
    # the 48 bits outside the band, in four parts of 12, of which one must agree
    rest = F.expr("case key div 65536 when 0 then shiftrightunsigned(fp, 16) when 1 then (shiftrightunsigned(fp, 32) * 65536) | (fp & 65535) when 2 then (shiftrightunsigned(fp, 48) * 4294967296) | (fp & 4294967295) else fp & 281474976710655 end")
    parts = F.array(*[(F.lit(p) * 4096 + F.shiftrightunsigned("rest", 12 * p).bitwiseAND(F.lit(4095))).cast("long") for p in range(4)])
    finer = large.withColumn("rest", rest).select("fp", "key", F.explode(parts).alias("part")).select("fp", (F.col("key") * 16384 + F.col("part")).alias("key"))
    finer, huge = _without_large(finer, bucket_rows)
    out = out.unionByName(_run(finer))
    if huge is not None:
        out = out.unionByName(_block_pairs(huge, bucket_rows))
    return out


def _without_large(keyed: DataFrame, bucket_rows: int):
    """The rows in buckets of at most bucket_rows, and those in larger ones (None if there are none)."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bucket_rows)
    sizes = stored(sizes, "large-buckets")
    if sizes.isEmpty():
        return keyed, None
    return keyed.join(sizes, "key", "left_anti"), keyed.join(sizes, "key")


def _block_pairs(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Every pair of blocks of a huge bucket in a task of its own: each row is sent to as many tasks as the bucket has blocks."""
    blocks = F.ceil(F.col("size") / (bucket_rows / 2)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return _run(pairs.select("fp", key.alias("key")))


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable by links; a row for each document."""
    marked = stored(fingerprints(docs), "fingerprints")
    named = _components_of(marked, bucket_rows)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named, "fp").join(least, "root").select("doc_id", "fp", "component_id")


def _components_of(marked: DataFrame, bucket_rows: int) -> DataFrame:
    """fp and the least fingerprint of its component, for each distinct fp."""
    each = stored(marked.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(each, bucket_rows))
    return stored(each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "components")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of rows that repeat it the first as written."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))
    rows = stored(fingerprints(packed, keep=["doc_id", "_doc"]).withColumn("_row", F.monotonically_increasing_id()), "marked")
    named = _components_of(rows, bucket_rows)
    ranked = rows.select("fp", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("place"))
    # the first row of each fingerprint, then of each component: both aggregate before they shuffle
    first = ranked.groupBy("fp").agg(F.min("place").alias("place")).join(named, "fp").groupBy("root").agg(F.min("place").alias("place"))
    return rows.join(first.select("place._row"), "_row", "left_semi").select("_doc.*")
