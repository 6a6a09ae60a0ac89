"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference-cover sample.

A byte goes if a string of `length` (400) bytes that covers it also starts at another place.
Whether the string at s repeats is a matter of the suffix at s and its neighbours in suffix
order to a depth of `length` bytes; suffixes are never sorted all at once:

* Dealing. In each window of `length` bytes the least hash among its `gram`-byte strings is its
  anchor. Equal windows have equal anchors at equal distance, so the suffixes that can tie meet in one
  bucket, that of the anchor's bytes; what stands alone in its bucket can't repeat and is
  left out. Windows in a row with the same anchor form a run; its bytes are its context.
* Copies. Runs with the same context (by a 128-bit BLAKE2 digest) are represented by two of them, so that a passage that
  is copied often is two contexts in its bucket; the sort decides about these, and the others take over what it finds.
* Sorting. Each bucket's contexts are a text whose suffixes are sorted blockwise with a
  difference-cover sample (`coversort`): the sample's suffixes are ranked first, long ties are
  resolved by their ranks. A task takes buckets up to `SORT_BYTES` at a time.
* A bucket of over `bucket_rows` contexts is split by more of its bytes, on either side of the anchor,
  until its parts are small enough to be sorted. A part that has one window left in which all of its rows agree is
  counted by that window's bytes. All of this is exact; no size changes the result.

Edge cases: null and empty texts have no bytes; texts shorter than `length` keep all; very long texts are
read in overlapping slices; matches never cross documents, but the document itself counts; equal windows
tie whatever their documents, and all of them go; rows that repeat a text and doc_id are
places of their own; an empty table gives no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import byte_view, row_slices, same_text, small_batches, stored
from siftwell.llm.coversort import repeated_windows

LENGTH, GRAM = 400, 64
#: Contexts of a bucket, and bytes of several buckets, that are sorted together.
BUCKET_ROWS, SORT_BYTES = 4096, 2 << 20
SLICE_BYTES = 2 << 20
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def samples(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with the same sample, over the rows data[begins:ends]: (sample, first window, last window, gram hash)."""
    n = len(data)
    assert gram % 8 == 0 and (gram <= 32 or gram % 32 == 0) and n < 1 << 24
    padded = np.concatenate([data, np.zeros(gram + 8, np.uint8)])
    few = np.zeros(n + max(0, gram - 32), np.uint64)
    for k in range(min(gram, 32) // 8):
        few += np.ndarray(len(few), "<u8", padded.data, 8 * k, (1,)) * FACTORS[k]
    mixed = few[:n].copy()
    for k in range(1, gram // 32):  # longer strings by the sums of their parts
        mixed *= FACTORS[0]
        mixed += few[32 * k : 32 * k + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= FACTORS[1]
    mixed ^= mixed >> np.uint64(32)
    width = length - gram + 1
    keyed = (mixed & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    whole = -(-max(n, 1) // width) * width
    blocks = np.full(whole, ~np.uint64(0))
    blocks[:n] = keyed
    blocks = blocks.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    out = []
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begins, ends) if b - a >= length] or [np.zeros(0, np.int64)])
    if not len(starts):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    picked = (np.minimum(after[starts], before[starts + width - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate([[True], (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    out = np.stack([picked[first], starts[first], starts[last]], axis=1)
    return out, mixed[picked[first]].view(np.int64)


SAMPLES = "_id long, _same long, at int, first int, last int, gram long, rank binary"


def _sample_rows(length: int, gram: int):
    def read(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column("_bytes"))
            ids, same = batch.column("_id").to_numpy(zero_copy_only=False), batch.column("_same").to_numpy(zero_copy_only=False)
            for a, b in row_slices(offsets, SLICE_BYTES):
                for piece, base in _pieces(data, offsets, a, b, length):
                    lo = piece[0][0]
                    part = data[lo : piece[1][-1]]
                    runs, grams = samples(part, piece[0] - lo, piece[1] - lo, length, gram)
                    if not len(runs):
                        continue
                    raw = part.tobytes()
                    ranks = [blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(runs[:, 1].tolist(), (runs[:, 2] + length).tolist())]
                    row = a + np.searchsorted(offsets[a : b + 1] - lo, runs[:, 1], "right") - 1 if base is None else np.full(len(runs), a)
                    local = runs + (lo - offsets[row])[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(same[row]), *(pa.array(local[:, k].astype(np.int32)) for k in range(3)), pa.array(grams), pa.array(ranks, pa.binary())], names=["_id", "_same", "at", "first", "last", "gram", "rank"])

    return read


def _pieces(data, offsets, a, b, length):
    """Whole rows together; a row that is larger than a slice in overlapping parts, so that each window is in one of them."""
    if offsets[b] - offsets[a] <= SLICE_BYTES or b - a > 1:
        yield (offsets[a:b], offsets[a + 1 : b + 1]), None
        return
    lo = int(offsets[a])
    while lo + length <= offsets[b]:
        hi = min(lo + SLICE_BYTES, int(offsets[b]))
        yield (np.array([lo]), np.array([hi])), lo
        lo = hi - length + 1


def _contexts(length: int):
    """Bytes of the contexts that are asked for."""

    def read(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for i, s, text, asked in zip(*(batch.column(c).to_pylist() for c in ("_id", "_same", "_bytes", "_asked"))):
                for r in asked:
                    row = (i, s, r["at"], r["first"], r["last"], r["gram"], r["role"], r["rank"], text[r["first"] : r["last"] + length])
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["_id", "_same", "at", "first", "last", "key", "role", "rank", "context"])

    return read


#: What a context is in its bucket: alone with its bytes, one of two that stand for all with the same bytes (the first one's
#: spans are those of the others), or the same for rows that agree in doc_id and text, where it stands for two.
ALONE, FIRST, BOTH, SECOND = 0, 1, 2, 3
#: Spans of a text (rank null), or of all contexts of a rank, from their beginning on.
SPANS = "_id long, _same long, rank binary, begin int, end int"


def _sort_buckets(length: int):
    """Spans of the repeated windows of rows that come bucket by bucket; whole buckets are sorted together."""

    def solve(rows):
        ends = np.cumsum([len(r[-1]) for r in rows])
        begins = np.concatenate([[0], ends[:-1]])
        again = repeated_windows(np.frombuffer(b"".join(r[-1] for r in rows), np.uint8), begins, ends, length)
        marks = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
        # a run of places ends with its string at the latest, as the last places of a string are no windows
        starts, stops = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)
        row = np.searchsorted(ends, starts, "right")
        ids, same, first, role = (np.array([r[k] for r in rows]) for k in range(4))
        alone = role[row] == ALONE
        shift = np.where(alone, first[row], 0) - begins[row]
        keep = np.flatnonzero(role[row] != SECOND)
        ranks = [None if alone[k] else rows[row[k]][4] for k in keep.tolist()]
        columns = [pa.array(ids[row][keep]), pa.array(same[row][keep]), pa.array(ranks, pa.binary()), pa.array((starts + shift)[keep].astype(np.int32)), pa.array((stops - 1 + length + shift)[keep].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_same", "rank", "begin", "end"])

    def read(batches):
        # a split bucket's context is in both parts, but only once in a text
        rows, held, key, size = [], set(), None, 0
        for batch in batches:
            for i, s, first, role, rank, k, c in zip(*(batch.column(x).to_pylist() for x in ("_id", "_same", "first", "role", "rank", "key", "context"))):
                if k != key and size >= SORT_BYTES:
                    yield solve(rows)
                    rows, held, size = [], set(), 0
                key = k
                if (i, s, first) not in held:
                    held.add((i, s, first))
                    for r in (FIRST, SECOND) if role == BOTH else (role,):
                        rows.append((i, s, first, r, rank, c))
                        size += len(c)
        if rows:
            yield solve(rows)

    return read


def _without_large(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows in buckets of 2 to bucket_rows contexts, and those in larger ones (None if there are none)."""
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(f"size > {bucket_rows}").select("key"), "large-buckets")
    if sizes.isEmpty():
        return rows, None
    return rows.join(sizes, "key", "left_anti"), rows.join(sizes, "key", "left_semi")


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Each bucket as two: windows that begin at most m bytes before the anchor, and those that begin further off.

    The first share their bytes from `low` before the anchor on to `length` - m behind, the others those from m + 1 before it to
    `length` - `high` behind; rows that differ there part. A row goes where it has windows.
    """
    m = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    nearest, furthest, place = F.col("at") - F.col("last"), F.col("at") - F.col("first"), F.col("at") - F.col("first")

    def part(low, high, number):
        some = (F.greatest(nearest, low) <= F.least(furthest, high)) & (low <= high)
        piece = F.substring(F.col("context"), place - low + 1, low + length - high)
        return F.when(some, F.struct(low.alias("low"), high.alias("high"), F.xxhash64("key", F.lit(number), piece).alias("key")))

    parts = F.array_compact(F.array(part(F.col("low"), m, 0), part(m + 1, F.col("high"), 1)))
    return rows.withColumn("_part", F.explode(parts)).withColumns({c: F.col(f"_part.{c}") for c in ("low", "high", "key")}).drop("_part")


def _merged(windows: DataFrame, length: int) -> DataFrame:
    """Spans (rank, begin, end) of windows (rank, begin); a context has few of them."""
    island = F.col("begin") - F.row_number().over(Window.partitionBy("rank").orderBy("begin"))
    return windows.distinct().withColumn("_island", island).groupBy("rank", "_island").agg(F.min("begin").alias("begin"), (F.max("begin") + length).alias("end")).drop("_island")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spans (_id, _same, begin, end) whose bytes go; they may overlap. rows: _id, _same, _bytes."""
    found = stored(rows.where(F.octet_length("_bytes") >= length).mapInArrow(_sample_rows(length, gram), SAMPLES), "samples")
    place = F.xxhash64("_id", "_same", "first")
    ranks = found.groupBy("gram", "rank").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("other"))
    several = ranks.groupBy("gram").agg(F.count(F.lit(1)).alias("ranks")).where("ranks > 1")
    marked = ranks.join(several, "gram", "left").where("n > 1 or ranks > 1").select("rank", "n", "one", "other")
    # the contexts that say something, on each run; a run that is alone in its bucket says nothing
    role = F.when(F.col("n") == 1, ALONE).when(place == F.col("one"), F.when(F.col("one") == F.col("other"), BOTH).otherwise(FIRST)).when(place == F.col("other"), SECOND)
    said = stored(found.join(marked, "rank").withColumn("role", role).drop("n", "one", "other"), "ranks")
    copies = said.where(f"role is null or role != {ALONE}").select("rank", "_id", "_same", "first")
    kept_rank = F.when(F.col("role").isin(FIRST, BOTH), F.col("rank")).alias("rank")
    by_text = said.where("role is not null").groupBy("_id", "_same").agg(F.collect_set(F.struct("at", "first", "last", "gram", "role", kept_rank)).alias("_asked"))
    shape = "_id long, _same long, at int, first int, last int, key long, role int, rank binary, context binary"
    pulled = stored(rows.join(by_text, ["_id", "_same"]).mapInArrow(_contexts(length), shape), "contexts")
    left, large = _without_large(pulled.withColumns({"low": F.lit(0), "high": F.lit(length - gram)}), bucket_rows)
    sortable = ["_id", "_same", "first", "role", "rank", "key", "context"]
    small = left.select(*sortable)
    counted = None
    while large is not None:  # at most once for each halving of the distance
        parts = stored(_split(large, length), "split-buckets")
        done = parts.where("low = high")
        left, large = _without_large(parts.where("low < high"), bucket_rows)
        small = small.unionByName(left.select(*sortable))
        window = F.substring(F.col("context"), F.col("at") - F.col("first") - F.col("low") + 1, F.lit(length))
        ends = done.select("_id", "_same", "first", "role", "rank", (F.col("at") - F.col("low")).alias("begin"), window.alias("window"))
        counted = ends if counted is None else counted.unionByName(ends)
    decided = stored(small.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_buckets(length), SPANS), "spans")
    spans = decided.where("rank is null").drop("rank")
    shared = decided.where("rank is not null").select("rank", "begin", "end")
    if counted is not None:
        times = F.sum(F.when(F.col("role") == BOTH, 2).otherwise(1))
        again = counted.groupBy("window").agg(times.alias("n")).where("n > 1").select("window")
        tied = stored(counted.where(f"role != {SECOND}").join(again, "window").drop("window"), "counted-windows")
        spans = spans.unionByName(tied.where(f"role = {ALONE}").select("_id", "_same", "begin", (F.col("begin") + length).alias("end")))
        shared = shared.unionByName(_merged(tied.where(f"role != {ALONE}").select("rank", (F.col("begin") - F.col("first")).alias("begin")), length))
    taken = copies.join(shared.distinct(), "rank").select("_id", "_same", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))
    return spans.unionByName(taken)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes); a row for each document."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), same_text().alias("_same"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_bytes"))
    spans = repeated_spans(rows.select("_id", "_same", "_bytes"), length, gram, bucket_rows)
    gone = spans.groupBy("_id", "_same").agg(F.collect_list(F.struct("begin", "end")).alias("_gone"))

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            gone = batch.column("_gone")
            flat, sizes = gone.flatten(), np.asarray(gone.value_lengths().fill_null(0)).astype(np.int64)
            begins, ends, at = flat.field("begin").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False), 0
            for text, n in zip(batch.column("_bytes").to_pylist(), sizes.tolist()):
                kept, runs = text, 0
                if n:
                    marks = np.zeros(len(text) + 1, np.int32)
                    np.add.at(marks, begins[at : at + n], 1)
                    np.add.at(marks, ends[at : at + n], -1)
                    stay = np.cumsum(marks[:-1]) == 0
                    runs = int((~stay[0]) + ((~stay[1:]) & stay[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[stay].tobytes()
                    at += n
                for column, value in zip(out, (len(text), len(text) - len(kept), runs, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(gone, ["_id", "_same"], "left").select("doc_id", "_bytes", "_gone").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and what is left: its bytes, and the text (a character that a cut parts shows as U+FFFD)."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), text.alias("text"))
