"""Phrase collocations by FM-indexes over word ids, one for each shard of the corpus.

Texts are cut into pieces and words, and dealt to shards of one language and about `shard_words`
words each, in the order in which they are read. A shard numbers its own words and keeps its texts as
these numbers, with a break after each piece. Counts go in three passes, each over what can still
belong to a phrase, and every pass sums across shards:

1. words, by each shard's own counts;
2. pairs of frequent words: an FM-index of the shard's frequent words (all others are breaks)
   extends the interval of each word to the right;
3. longer phrases: an FM-index of the runs of pairs that may be frequent extends the intervals of pairs to the
   right and to the left in turn, up to the longest phrase. Which pairs may be is told by a bitmap of fixed
   size (8 MB) over the hashes of the frequent ones; a pair that only shares a bit costs work, and is counted out.

An index sorts suffixes by no more words than the longest phrase has, which is all that intervals of
such phrases depend on. Both directions are kept in step: an extension by a word gives the interval in
the index of the reversed text by its rank in the BWT, and in the other by the number of smaller
extensions. A phrase with a rare part is never frequent, so nothing is lost.

Nothing else is kept in one place: shards are rows in the shared folder, frequent words
go back only to shards that have them. Hot words have one row for each shard.

Edge cases: null and empty texts have no words; a null lang is `other`, together with texts of that
name; a very long text lies in one shard, which is larger by it; repeated rows count each; an empty table gives no
phrase; ties in score go by count, then by the phrase's bytes; ties among cuts to the shortest
first part; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.bpe import spread
from siftwell.llm.common import stored

#: Words of a shard, breaks included.
SHARD_WORDS = 2_000_000
#: A-Z in lower case, what ends a piece as a line feed, and the tab as a space.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
BREAK = 0
#: Bits of the map of frequent pairs: its size, whatever the corpus.
PAIR_BITS = 1 << 26


class _Words(dict):
    """Numbers words from 1 as they come; the break is 0, the empty word -1."""

    def __init__(self):
        super().__init__({b"\n": BREAK, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _packed(places: np.ndarray) -> bytes:
    """Numbers of 32 bits, their first bytes first, compressed: most are small."""
    return pa.compress(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _bit(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The place of each pair in a map of `bits` (a power of two) bits."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) & np.uint64(bits - 1)


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bits of all pairs, as 64-bit words: bits / 8 bytes at most come to the driver."""

    def run(batches):
        for batch in batches:
            place = np.sort(_bit(batch.column("first").to_numpy(), batch.column("second").to_numpy(), bits))
            word, begins = np.unique(place >> np.uint64(6), return_index=True)
            set_ = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), begins) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_.view(np.int64))], names=["word", "bits"])

    words = pairs.select("first", "second").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, bits // 64), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _shards(docs: DataFrame, other: str, shard_words: int) -> DataFrame:
    """shard, lang, words, counts, size, places (the shard's texts as `size` numbers of its words, packed)."""
    names = ["shard", "lang", "words", "counts", "size", "places"]

    def run(batches):
        open_: dict[str, tuple[_Words, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def closed(lang):
            nonlocal made
            words, parts = open_.pop(lang)
            places = np.concatenate(parts).astype(np.int32)
            counts = np.bincount(places, minlength=len(words) - 1)[1:]
            made += 1
            row = [[made], [lang], [[w.decode() for w, number in words.items() if number > 0]], [counts.tolist()], [len(places)], [_packed(places)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=names)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                words, parts = open_.setdefault(lang, (_Words(), []))
                found = text.as_py().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                places = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                parts.append(np.append(places[places >= 0], BREAK).astype(np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
                if sizes[lang] >= shard_words:
                    sizes[lang] = 0
                    yield closed(lang)
        for lang in list(open_):
            yield closed(lang)

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(other)).alias("lang"))
    return texts.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, size long, places binary")


class FmIndex:
    """Both directions of an FM-index over the symbols 1..top of `text`; 0 breaks, and is the last symbol."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        self.text, self.top, self.depth, self._sides = text.astype(np.int64), top, depth, {}
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=top + 1))])

    def _bwt(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before the suffixes in order, and for ranks: symbol and place of each in one number, in order."""
        rank, size, known = text, self.top + 1, 1
        while known < self.depth:
            keys = rank * size + np.append(rank[known:], np.zeros(min(known, len(rank)), np.int64))
            known *= 2
            _, rank = np.unique(keys, return_inverse=True)
            size = int(rank.max(initial=0)) + 1
        bwt = text[np.argsort(rank, kind="stable") - 1]
        return bwt, np.sort(bwt * (len(bwt) + 1) + np.arange(len(bwt)))

    def _side(self, right: bool):
        if right not in self._sides:
            self._sides[right] = self._bwt(self.text[::-1] if right else self.text)
        return self._sides[right]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each symbol's phrase (one column), and its interval: start in the text's order, in the reversed text's, and size."""
        size = np.diff(self.starts)[1:]
        there = np.flatnonzero(size)
        start = self.starts[1:-1][there]
        return there[:, None] + 1, start, start, size[there]

    def extend(self, phrases, start, back, size, right: bool):
        """All extensions of the phrases by one symbol that occur, to the right or to the left."""
        bwt, ranks = self._side(right)
        here, there = (back, start) if right else (start, back)
        number = np.repeat(np.arange(len(size)), size)
        keys, count = np.unique(number * (self.top + 1) + bwt[spread(here, size)], return_counts=True)
        of, symbol = keys // (self.top + 1), keys % (self.top + 1)
        # smaller extensions of the same phrase stand before in the other order
        before = np.cumsum(count) - count
        smaller = before - (np.cumsum(size) - size)[of]
        keep = symbol != BREAK
        of, symbol, count, smaller = of[keep], symbol[keep], count[keep], smaller[keep]
        step = self.starts[symbol] + np.searchsorted(ranks, symbol * (len(bwt) + 1) + here[of]) - np.searchsorted(ranks, symbol * (len(bwt) + 1))
        grown = np.column_stack([phrases[of], symbol] if right else [symbol, phrases[of]])
        return (grown, there[of] + smaller, step, count) if right else (grown, step, there[of] + smaller, count)


def _texts(shard: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's text in symbols of its frequent words, breaks run together, and the id of each symbol (from 1)."""
    places = _unpacked(shard.column("places")[0].as_py(), shard.column("size")[0].as_py())
    number, ids = known.column("number").to_numpy(), known.column("id").to_numpy()
    order = np.argsort(ids)
    symbol_of = np.zeros(max(int(places.max(initial=0)), int(number.max(initial=0))) + 1, np.int64)
    symbol_of[number[order]] = np.arange(1, len(order) + 1)
    text = np.append(symbol_of[places], BREAK)
    return text[np.append(True, (text[1:] != BREAK) | (text[:-1] != BREAK))], np.concatenate([[-1], ids[order]])


def _pairs(shard: pa.Table, known: pa.Table) -> pa.Table:
    names = ["first", "second", "n"]
    if not shard.num_rows or not known.num_rows:
        return pa.table({x: pa.array([], pa.int64()) for x in names})
    text, ids = _texts(shard, known)
    phrases, _, _, size = (index := FmIndex(text, len(ids) - 1, 2)).extend(*index.words(), right=True)
    return pa.table({"first": ids[phrases[:, 0]], "second": ids[phrases[:, 1]], "n": size})


def _longer(shard: pa.Table, known: pa.Table, bitmap: np.ndarray, max_words: int) -> pa.Table:
    out = [], []
    if shard.num_rows and known.num_rows:
        text, ids = _texts(shard, known)
        place = _bit(ids[text[:-1]], ids[text[1:]], 64 * len(bitmap))
        linked = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) > 0) & (text[:-1] != BREAK) & (text[1:] != BREAK)
        # a break wherever neighbours aren't such a pair; a word without one goes
        stays = np.append(linked, False) | np.append(False, linked)
        text = np.insert(np.where(stays, text, BREAK), np.flatnonzero(~linked) + 1, BREAK)
        text = text[np.append(True, (text[1:] != BREAK) | (text[:-1] != BREAK))]
        index = FmIndex(text, len(ids) - 1, max_words)
        found = index.extend(*index.words(), right=True)
        for words in range(3, max_words + 1):
            found = index.extend(*found, right=words % 2 == 1)
            out[0].append(pa.ListArray.from_arrays(np.arange(0, found[0].size + 1, words, dtype=np.int32), ids[found[0].ravel()]))
            out[1].append(found[3])
    return pa.table({"phrase": pa.chunked_array(out[0], pa.list_(pa.int64())), "n": np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)})


def counts(docs: DataFrame, min_count: int = 30, max_words: int = 4, other: str = "und", shard_words: int = SHARD_WORDS, pair_bits: int = PAIR_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n: words), (id, lang, word) of frequent words, and (phrase: array of ids, f) of the phrases of 1 to
    max_words words with f >= min_count occurrences."""
    shards = stored(_shards(docs, other, shard_words), "shards")
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    totals = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    places = F.collect_list(F.struct("shard", (F.col("at") + 1).alias("number"))).alias("places")
    frequent = words.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"), places).where(F.col("f") >= min_count)
    frequent = stored(frequent.withColumn("id", F.monotonically_increasing_id()), "words")
    of_words = frequent.select("id", F.explode("places").alias("p")).select("p.shard", "id", F.col("p.number").cast("long").alias("number")).groupBy("shard")
    texts = shards.select("shard", "size", "places").groupBy("shard")

    pairs = texts.cogroup(of_words).applyInArrow(_pairs, "first long, second long, n long")
    pairs = stored(pairs.groupBy("first", "second").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "pairs")
    found = frequent.select(F.array("id").alias("phrase"), "f").unionByName(pairs.select(F.array("first", "second").alias("phrase"), "f"))
    if max_words > 2:
        bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs, pair_bits))
        longer = texts.cogroup(of_words).applyInArrow(lambda a, b: _longer(a, b, bitmap.value, max_words), "phrase array<long>, n long")
        longer = longer.groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        found = found.unionByName(stored(longer, "phrases"))
    return totals, frequent.select("id", "lang", "word"), found


def mine(docs: DataFrame, min_count: int = 30, max_words: int = 4, held: int = 80, most: int = 2000, other: str = "und", shard_words: int = SHARD_WORDS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """The first `most` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut where it scores lowest: floor(2 000 000 a / (l + r)) with l and r the counts of its parts.
    Phrases inside a longer one that has at least `held` per cent of their occurrences are dropped.
    """
    totals, words, found = counts(docs, min_count, max_words, other, shard_words, pair_bits)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = found.where(F.size("phrase") > 1).withColumnRenamed("f", "a")
    inside = candidates.where(F.size("phrase") > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(phrase) - 1), m -> transform(sequence(1, size(phrase) - m + 1), s -> slice(phrase, s, m))))"
    )).alias("phrase")).groupBy("phrase").agg(F.max("a").alias("longest"))
    kept = candidates.join(inside, "phrase", "left").where(F.col("longest").isNull() | (100 * wide("longest") < held * wide("a"))).drop("longest")
    cuts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(phrase, 1, k)"), "rest": F.expr("slice(phrase, k + 1, size(phrase))")})
    cuts = cuts.join(found.select(F.col("phrase").alias("first"), F.col("f").alias("l")), "first").join(found.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
    scored = cuts.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    named = scored.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words, "id").groupBy("phrase")
    named = named.agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = scored.join(named, "phrase").join(totals, "lang").select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
