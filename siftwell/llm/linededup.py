"""Line dedup over content-defined chunks of lines.

A text is cut into lines at "\\n". A rolling hash over the hashes of two neighbouring lines marks boundaries: where
it is 0 modulo `spread`, a chunk begins before its two lines and ends behind them, wherever they stand in a text. The chunks are
what lies between neighbouring boundaries, and at each mark the two lines of the hash themselves, the
shortest chunk. Lines of any length take part. One such cut misses short passages whose lines give no mark,
so there are `layers` of chunks, each by its own rolling hash; a whole text is a chunk too, so that an equal text goes as a
whole, and so is a line of over `passage` (50) words, which is a passage by itself. All other chunks count if two of
their lines aren't blank.

A chunk that occurs again, in another document or in the same one, is removed everywhere but in its first place: the
document with the smallest doc_id, and there its first occurrence. What is removed always has an earlier copy, so the
first copy of every line stays. Chunks that share the first 64 bits of a 128-bit hash are candidates; the bytes of the candidates are
then compared in groups, and only equal bytes count as repeated.

Edge cases: null texts stay null and empty ones empty; very long texts are read whole; a line of 50 words or fewer by itself is never
removed; rows with the same doc_id count as one document (what they share stays in each, what occurs twice within one
goes); a null doc_id comes before all others; blank lines belong to chunks like others; an empty table gives no
row. Extra columns are kept, whatever their names; n_lines, n_removed and removed_chunks replace columns of those names (`cut` gives
the whole row beside them). doc_id is a number, or else is taken as a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StringType, StructField, StructType

from siftwell.llm.common import same_text, small_batches, stored, whole_row

PASSAGE, SPREAD, LAYERS = 50, 2, 6
FACTOR = 0x9E3779B97F4A7C15
STEP = np.uint64(FACTOR)
FIRST = -(1 << 63)


def chunks_of(texts: list[bytes], passage: int = PASSAGE, spread: int = SPREAD, layers: int = LAYERS):
    """For each text its chunks in order, each once: (first line, end line, first byte, end byte)."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    joined = b"\n".join(texts)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = len(starts)
    begin_of = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begin_of, starts, "right") - 1
    # rows of empty texts have a line of their own, as "" has
    lines = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    filled = np.append(0, np.cumsum(np.fromiter((line.strip() != b"" for line in lines), np.int64, n)))
    head = np.append(True, doc[1:] != doc[:-1])
    tail = np.append(head[1:], True)
    pair = hashes * STEP + np.append(hashes[1:], np.uint64(0))  # the hash of each line and its next
    mixed = (pair ^ (pair >> np.uint64(31))) * STEP
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ranges = []
    for layer in range(layers):
        mark = ((mixed >> np.uint64(63 - 8 * layer - 7)) % np.uint64(spread) == 0) & ~tail  # other bits for each layer
        begins = head | mark
        begins[2:] |= mark[:-2]  # what comes behind the two lines
        a, at = np.flatnonzero(begins), np.flatnonzero(mark)
        ranges += [np.stack([a, np.append(a[1:], n)]), np.stack([at, at + 2])]
    several = np.concatenate(ranges, axis=1)
    a = np.flatnonzero(head)
    whole = np.stack([a, np.append(a[1:], n)])
    alone = np.array([k for k in np.flatnonzero(ends - starts > 2 * passage).tolist() if len(lines[k].split()) > passage], np.int64)
    ranges = [several[:, filled[several[1]] - filled[several[0]] > 1], whole[:, filled[whole[1]] - filled[whole[0]] > 0], np.stack([alone, alone + 1])]
    a, b = np.concatenate(ranges, axis=1)
    # of a text of one line the whole counts only as a passage
    keep = (b - a > 1) | np.isin(a, alone)
    a, b = np.divmod(np.unique(a[keep] * (n + 1) + b[keep]), n + 1)
    base = np.flatnonzero(head)[doc[a]]
    for d, x, y, lo, hi in zip(doc[a].tolist(), (a - base).tolist(), (b - base).tolist(), (starts[a] - begin_of[doc[a]]).tolist(), (ends[b - 1] - begin_of[doc[a]]).tolist()):
        out[d].append((x, y, lo, hi))
    return out


def _hashed(texts: list[bytes], **shape):
    """For each text its chunks with their hashes: (first line, end line, first byte, end byte, hash)."""
    return [[(*c, xxhash.xxh3_128_digest(text[c[2] : c[3]])) for c in found] for text, found in zip(texts, chunks_of(texts, **shape))]


def cut_text(text: bytes, chunks, gone: set[bytes]) -> tuple[bytes, int, int]:
    """What is left of a text, the lines removed and the chunks removed: those in `gone`, and what repeats an earlier chunk of the text."""
    seen, marks, count = {}, None, 0
    for a, b, lo, hi, h in chunks:
        x, y = seen.setdefault(h, (lo, hi))
        if h in gone or x < lo and text[lo:hi] == text[x:y]:
            marks = marks if marks is not None else bytearray(text.count(b"\n") + 1)
            marks[a:b] = b"\1" * (b - a)
            count += 1
    if not count:
        return text, 0, 0
    return b"\n".join(line for line, m in zip(text.split(b"\n"), marks) if not m), sum(marks), count


def remove_repeated(docs: DataFrame, **shape) -> DataFrame:
    """docs with the repeated chunks taken out of text, and n_lines, n_removed (lines) and removed_chunks."""
    counts = ["n_lines", "n_removed", "removed_chunks"]
    own = [c for c in docs.columns if c not in counts]
    return cut(docs, **shape).select(*[F.col("text") if c == "text" else F.col("_doc")[c].alias(c) for c in own], *counts)


def cut(docs: DataFrame, **shape) -> DataFrame:
    """_doc (each row of docs as a struct, but for its text), text without the repeated chunks, n_lines, n_removed (lines) and removed_chunks."""
    small_batches(docs.sparkSession)
    number = isinstance(docs.select("doc_id").schema["doc_id"].dataType, NumericType)
    kind, first = ("long", F.lit(FIRST)) if number else ("string", F.lit(""))
    place = F.col("doc_id").cast("long") if number else F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    rows = docs.select(whole_row(docs.drop("text")).alias("_doc"), F.coalesce(place, first).alias("_id"), same_text().alias("_same"), F.col("text").cast("binary").alias("_bytes"))

    def places(batches):
        for batch in batches:
            each = [{c[4][:8] for c in found} for found in _hashed(batch.column("_bytes").to_pylist(), **shape)]
            of = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
            parts = np.frombuffer(b"".join(h for e in each for h in e), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(of), batch.column("_same").take(of), pa.array(parts)], names=["_id", "_same", "part"])

    def bodies(batches):
        for batch in batches:
            out = [[], [], [], []]
            texts = batch.column("_bytes").to_pylist()
            for i, text, asked, found in zip(batch.column("_id").to_pylist(), texts, batch.column("_asked").to_pylist(), _hashed(texts, **shape)):
                asked, met = {a.to_bytes(8, "little", signed=True) for a in asked}, set()
                for _, _, lo, hi, h in found:
                    if h[:8] in asked and h not in met:
                        met.add(h)
                        for column, value in zip(out, (i, int.from_bytes(h[:8], "little", signed=True), h, text[lo:hi])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["_id", "part", "hash", "body"])

    some = rows.where("octet_length(_bytes) > 0")
    found = stored(some.select("_id", "_same", "_bytes").mapInArrow(places, f"_id {kind}, _same long, part long"), "chunk-places")
    shared = found.groupBy("part").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").select("part")
    asked = found.join(shared, "part").groupBy("_id", "_same").agg(F.collect_list("part").alias("_asked"))
    joined = stored(rows.join(asked, ["_id", "_same"], "left"), "line-candidates")
    held = joined.where("_asked is not null")
    # equal bytes meet in one group; a hash that stands for different bytes, should there be one, is left alone
    equal = held.select("_id", "_bytes", "_asked").mapInArrow(bodies, f"_id {kind}, part long, hash binary, body binary").groupBy("part", "hash", "body").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    repeated = equal.groupBy("part", "hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("bodies")).where("bodies = 1 and first < last").select("part", "hash", "first")
    gone = held.select("_id", "_same", F.explode("_asked").alias("part")).join(repeated, "part").where("_id > first").groupBy("_id", "_same").agg(F.collect_set("hash").alias("_gone"))
    none = F.lit(None).cast("array<binary>").alias("_gone")
    both = held.join(gone, ["_id", "_same"], "left").select("_doc", "_bytes", "_gone").unionByName(joined.where("_asked is null").select("_doc", "_bytes", none))
    inner = StructType([rows.schema["_doc"], StructField("text", StringType())] + [StructField(c, LongType()) for c in ("n_lines", "n_removed", "removed_chunks")])

    def apply(batches):
        for batch in batches:
            texts = batch.column("_bytes").to_pylist()
            chunks = _hashed([t or b"" for t in texts], **shape)
            out = [[], [], [], []]
            for text, found, gone in zip(texts, chunks, batch.column("_gone").to_pylist()):
                kept, removed, count = cut_text(text, found, set(gone or ())) if text else (text, 0, 0)
                for column, value in zip(out, (kept, 0 if text is None else text.count(b"\n") + 1, removed, count)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(out[0], pa.binary()).cast(pa.string())] + [pa.array(c, pa.int64()) for c in out[1:]], names=["_doc", "text", "n_lines", "n_removed", "removed_chunks"])

    return both.mapInArrow(apply, inner)


def digest(found: DataFrame) -> DataFrame:
    """What the query returns: counts, and a digest of the kept text."""
    return found.select("doc_id", "n_lines", "n_removed", "removed_chunks", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
