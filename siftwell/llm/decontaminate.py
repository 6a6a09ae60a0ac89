"""Benchmark decontamination: Wu-Manber multi-pattern search over whole documents.

Texts become words of [0-9a-z] and non-ASCII bytes (A-Z lower-cased), joined by single
spaces. The patterns are the benchmark's windows of `width` consecutive words, each with a
space on both sides, so that a match is a match of whole words. Patterns are grouped by
length; each group has a shift table over hashed blocks, which tells how far a position can
be moved without missing an occurrence, and buckets by the hash of the block that ends the
shortest pattern, whose members are compared byte by byte.

The search reads its text in many lanes at once: each lane looks at the block at its own
position, moves by its own shift and stops at its own end.

Edge cases: a null or empty text has no words, is not contaminated and hits no item; a null
benchmark text or one without words has no window; an item shorter than `width` is one
window; very long texts are searched whole; repeated documents are judged one by one, rows with the same item_id are one item and
share their tables; a share that equals the limit is contaminated; an empty benchmark leaves every document clean. Extra columns are kept by `decontaminate`, dropped by
`benchmark_hits`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import byte_view, row_slices, schema_with, small_batches, stored, whole_row

WIDTH = 13
#: Normalised bytes searched at a time in a worker.
SLICE_BYTES = 2 << 20
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20

SPACE, BREAK = 32, 10
FOLD = np.full(256, SPACE, np.uint8)
FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD_TABLE = FOLD.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD_TABLE).split()


class WuManber:
    """Tables for one group of patterns text[starts:ends], whose shortest has `reach` bytes."""

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray):
        self.text = text
        self.reach = int((ends - starts).min())
        self.block = min(8, self.reach)
        ends_at = _ends_at(np.frombuffer(text, np.uint8))
        spans = self.reach - self.block + 1
        self.bits = int(min(22, max(12, np.ceil(np.log2(4 * len(starts) * spans + 1)))))
        self.shift = np.full(1 << self.bits, spans, np.int32)
        for end in range(self.block - 1, self.reach):  # later ends shift less
            self.shift[self._slot(self._keys(ends_at, starts + end))] = self.reach - 1 - end
        keys = self._keys(ends_at, starts + self.reach - 1)
        order = np.argsort(keys, kind="stable")
        self.suffix, self.starts, self.ends, self.numbers = keys[order], starts[order], ends[order], numbers[order]

    def _keys(self, ends_at: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks that end at some places."""
        return ends_at[at] >> np.uint64(8 * (8 - self.block)) if self.block < 8 else ends_at[at]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, raw: bytes, found) -> None:
        """Calls found(start, pattern number) for each occurrence in text, whose bytes are raw."""
        if len(text) < self.reach:
            return
        ends_at = _ends_at(text)
        lanes = int(np.clip(len(text) // 256, 1, 8192))
        edges = np.linspace(self.reach - 1, len(text), lanes + 1).astype(np.int64)
        at, end = edges[:-1].copy(), edges[1:]
        live = at < end
        at, end = at[live], end[live]
        while len(at):
            keys = self._keys(ends_at, at)
            step = self.shift[self._slot(keys)]
            stop = step == 0
            if stop.any():
                self._confirm(at[stop], keys[stop], raw, found)
                step = np.where(stop, 1, step)
            at = at + step
            live = at < end
            if not live.all():
                at, end = at[live], end[live]

    def _confirm(self, at, keys, raw, found) -> None:
        lo, hi = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        for k in np.flatnonzero(hi > lo):
            start = int(at[k]) - self.reach + 1
            for m in range(lo[k], hi[k]):
                if raw.startswith(self.text[self.starts[m] : self.ends[m]], start):
                    found(start, int(self.numbers[m]))


def _ends_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes that end at each place, as a word whose top bytes are the last ones."""
    return np.ndarray(len(text), "<u8", np.concatenate([np.zeros(8, np.uint8), text]).data, 1, (1,))


class Benchmark:
    """Distinct windows of the items, as places in one joined text, their items, and search tables by length of the windows."""

    def __init__(self, items: list[tuple[list[str], str | None]], width: int = WIDTH):
        self.ids = [ids for ids, _ in items]
        pieces, begins, ends, owners, words, base = [], [], [], [], [], 0
        for number, (_, text) in enumerate(items):
            found = words_of(text)
            if not found:
                continue
            piece = b" " + b" ".join(found) + b" "
            spaces = np.flatnonzero(np.frombuffer(piece, np.uint8) == SPACE)
            n, size = max(1, len(found) - width + 1), min(width, len(found))
            begins.append(base + spaces[:n])
            ends.append(base + spaces[size : size + n] + 1)
            owners.append(np.full(n, number, np.int32))
            words.append(np.full(n, size, np.int32))
            pieces.append(piece)
            base += len(piece)
        self.tables: list[WuManber] = []
        if not pieces:
            return
        text = b"".join(pieces)
        begins, ends, owners, words = map(np.concatenate, (begins, ends, owners, words))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
        order = np.argsort(hashes, kind="stable")
        begins, ends, owners, words, hashes = begins[order], ends[order], owners[order], words[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        for k in np.flatnonzero(~new).tolist():  # equal hashes are held against the bytes
            new[k] = text[begins[k] : ends[k]] != text[begins[k - 1] : ends[k - 1]]
        first = np.flatnonzero(new)
        self.owners, self.offsets, self.words = owners, np.append(first, len(owners)), words[first].tolist()
        starts, stops = begins[first], ends[first]
        # by bit length, so that a short window doesn't shorten the shifts of all
        group = np.frexp((stops - starts).astype(float))[1]
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            self.tables.append(WuManber(text, starts[own], stops[own], own))

    def items_of(self, windows) -> np.ndarray:
        """Numbers of the items that have one of the windows."""
        return np.unique(np.concatenate([self.owners[self.offsets[w] : self.offsets[w + 1]] for w in windows])) if windows else np.zeros(0, np.int32)


_held: dict[str, Benchmark] = {}


def tables_of(key: str, items, width: int) -> Benchmark:
    """The tables of a pass, built once in each Python worker; those of the pass before are let go."""
    if key not in _held:
        _held.clear()
        _held[key] = Benchmark(items.value, width)
    return _held[key]


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, and where each row begins. Rows come as "\\n " + text + " "."""
    folded = FOLD[data]
    folded[offsets[:-1]] = BREAK
    space = folded == SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    position = np.cumsum(keep, dtype=np.int64) - 1
    return folded[keep], position[offsets[:-1]]


def judge(data: np.ndarray, offsets: np.ndarray, bench: Benchmark):
    """For each row: words, [(first word, words)] of the occurrences, numbers of the items."""
    for first, last in row_slices(offsets, SLICE_BYTES):
        lo, hi = offsets[first], offsets[last]
        text, begins = normalise(data[lo:hi], offsets[first : last + 1] - lo)
        spaces = np.cumsum(text == SPACE, dtype=np.int32)
        before = spaces[begins]
        counts = np.diff(np.append(before, spaces[-1])) - 1
        runs: dict[int, list] = defaultdict(list)
        windows: dict[int, set] = defaultdict(set)
        raw = text.tobytes()

        def found(start: int, number: int) -> None:
            row = int(np.searchsorted(begins, start, "right")) - 1
            runs[row].append((int(spaces[start] - before[row]) - 1, bench.words[number]))
            windows[row].add(number)

        for table in bench.tables:
            table.search(text, raw, found)
        for row in range(last - first):
            yield int(counts[row]), runs.get(row, ()), bench.items_of(windows.get(row, ()))


def covered(runs) -> int:
    """Words inside any of the runs."""
    total = end = 0
    for a, n in sorted(runs):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


HITS = "n_words long, n_hit long, n_items long, item_ids array<string>"
RAW = "n_words long, runs array<struct<first:int,n:int>>, item_ids array<string>"


def _of_pass(texts: DataFrame, k: int, passes: int) -> list:
    """ids and text of the benchmark's texts in pass k, of a size that has been checked."""
    part = texts if passes == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
    return [tuple(r) for r in part.select("ids", "text").toLocalIterator()]


def _passes(texts: DataFrame, pass_bytes: int) -> int:
    """How many passes hold at most `pass_bytes` each, by a hash of the text; a text that is larger by itself is a pass of its own size."""
    size = F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda a, i: a + F.length(i) + 8)
    sizes = texts.select("text", size.cast("long").alias("size"))
    total, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    passes = max(1, -(-int(total) // pass_bytes))
    while passes > 1:
        fullest = sizes.groupBy(F.pmod(F.xxhash64("text"), F.lit(passes))).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0]
        if fullest <= max(pass_bytes, largest):
            break
        passes += -(-passes // 4)
    return passes


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: the columns in `keep` (doc_id), n_words, n_hit, n_items, item_ids.

    The benchmark's tables go to every worker only as far as their size is checked: beyond
    `pass_bytes` of text it is split by a hash of its rows, each part is searched in its own
    pass, and the occurrences of all parts are joined by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep or ["doc_id"]
    # items that repeat a text share it
    texts = stored(benchmark.where("text is not null").groupBy("text").agg(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("None"))).alias("ids")), "benchmark")
    passes = _passes(texts, pass_bytes)
    if passes == 1:
        return _one_pass(docs, _of_pass(texts, 0, 1), width, keep, merge=False)
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "text", *[c for c in keep if c != "text"]), "decontaminate")
    parts = None
    for k in range(passes):  # written before the next part of the benchmark is read
        part = stored(_one_pass(docs, _of_pass(texts, k, passes), width, ["_row"], merge=True), "hits")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    start = F.array_sort("runs")
    union = F.aggregate(start, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["first"] + r["n"] - F.greatest(r["first"], a["end"]))).alias("n"), F.greatest(a["end"], r["first"] + r["n"]).alias("end")))
    merged = merged.select("_row", "n_words", union["n"].cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    return docs.join(merged, "_row").select(*keep, "n_words", "n_hit", "n_items", "item_ids")


def _one_pass(docs: DataFrame, rows: list, width: int, keep: list[str], merge: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = schema_with(docs.select(*keep).schema, RAW if merge else HITS)
    key = uuid.uuid4().hex
    names = [*keep, "n_words", *(["runs"] if merge else ["n_hit", "n_items"]), "item_ids"]

    def search(batches):
        bench = tables_of(key, shared, width)
        for batch in batches:
            data, offsets = byte_view(batch.column("_bytes"))
            found = list(judge(data, offsets, bench))
            ids = [sorted({i for owner in owners.tolist() for i in bench.ids[owner]}) for _, _, owners in found]
            words = pa.array([n for n, _, _ in found], pa.int64())
            if merge:
                more = [words, pa.array([[{"first": a, "n": n} for a, n in r] for _, r, _ in found], pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))]
            else:
                more = [words, pa.array([covered(r) for _, r, _ in found], pa.int64()), pa.array([len(i) for i in ids], pa.int64())]
            more.append(pa.array(ids, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + more, names=names)

    text = F.concat(F.lit("\n "), F.coalesce("text", F.lit("")), F.lit(" ")).cast("binary")
    return docs.select(*keep, text.alias("_bytes")).mapInArrow(search, schema)


def contaminated(hits: DataFrame) -> DataFrame:
    """Adds the rule: some word is hit, and hit words are at least a twentieth of all."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows = docs.select("text", whole_row(docs).alias("_doc"))
    found = contaminated(benchmark_hits(rows, benchmark, width, keep=["_doc"]))
    return found.where(~F.col("contaminated")).select("_doc.*")


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns."""
    return contaminated(hits).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
