"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a remainder. A remainder of r ids belongs to
the reciprocal class k = capacity // r: k pieces of at most capacity // k ids share a sequence.
Where the slot would be padded by more than `slack` of the piece, the piece is cut at the
largest reciprocal boundary and the rest goes to a class of its own, so that padding stays
small. Each worker fills the sequences of each class with exactly k pieces on its own, as its
documents stream by. What is left in a worker's unfinished sequences, less than one
sequence for each class, is filled up in a second step over groups of `fan_in` workers' rests,
and the last unfinished sequence of each class of a group is put together with others.

Edge cases: null and empty texts are the single closing id; repeated documents are packed
each; an empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, stored

CAPACITY = 2048
END_ID = 1
#: Padding that a piece may leave in its slot, as a share of the piece, before it is cut.
SLACK = 1 / 64
#: Workers whose unfinished sequences are filled up together.
FAN_IN = 16
#: Words whose ids a worker remembers.
REMEMBERED = 800_000

#: White space as the tokenizer's normaliser sees it; text is split there, as no token crosses it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = re.compile(f"[{WHITE}]+")
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this code point are lower-cased one by one and always composed.
LATIN_END = "\u0250"


class _Learned(dict):
    """A dictionary that asks `learn` for what it lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        self[key] = value = self.learn(key)
        return value


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids of whole texts by a tokenizer whose tokens never cross white space, one distinct word at a time.

    A word of Latin letters, perhaps with ASCII punctuation at its end, is two pieces at most for
    the tokenizer's model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.remembered = Tokenizer.from_file(path), end_id, remembered
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known, self.parts = _Learned(self._learn), _Learned(self._part)
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.new_ids: list[int] = []
        self.new_sizes: list[int] = []

    def _part(self, part: str) -> tuple[int, ...]:
        letters = self.letters
        return tuple([token.id for token in self.model.tokenize("".join([letters[b] for b in part.encode()]))])

    def _learn(self, word: str) -> int:
        core = word.rstrip(PUNCTUATION)
        low = core.lower()
        if low.isalpha() and (low.isascii() or max(low) < LATIN_END):
            got = self.parts[low]
            if len(core) < len(word):
                got = got + self.parts[word[len(core) :]]
        else:
            got = self.tokenizer.encode(word, add_special_tokens=False).ids
        self.new_ids += got
        self.new_sizes.append(len(got))
        return len(self.known)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in `rows`, one after the other, and how many each has."""
        if self.new_sizes:
            self.ids = np.concatenate([self.ids, np.array(self.new_ids, np.int32)])
            self.sizes = np.concatenate([self.sizes, np.array(self.new_sizes, np.int64)])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.new_ids, self.new_sizes = [], []
        sizes = self.sizes[rows] if len(rows) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.int32), sizes

    def encode(self, text: str | None) -> np.ndarray:
        words = [w for w in SPLIT.split(text or "") if w]
        ids, _ = self._gather(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        return np.append(ids, np.int32(self.end_id))

    def encode_column(self, texts: pa.Array):
        """The ids of each text of a string column, with the closing id."""
        if len(self.known) > self.remembered:
            self._forget()
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_pylist()
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        own = np.fromiter(map(self.known.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        rows = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        # leading and trailing white space gives empty words, which have no ids
        ids, sizes = self._gather(rows)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])]
        for k in range(len(texts)):
            yield self.encode(texts[k].as_py()) if odd[k] else np.append(ids[edges[k] : edges[k + 1]], np.int32(self.end_id))


def pieces_of(n: int, capacity: int = CAPACITY, slack: float = SLACK):
    """(start, length, class) of the pieces of a document of n ids."""
    start = 0
    while n - start >= capacity:
        yield start, capacity, 1
        start += capacity
    while start < n:
        rest = n - start
        k = capacity // rest
        if capacity // k - rest > slack * rest:
            k += 1
            rest = capacity // k
        yield start, rest, k
        start += rest


_TOKENIZERS: dict[tuple, WordIds] = {}


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, slack: float = SLACK, fan_in: int = FAN_IN, carry: Callable[[np.ndarray], object] | None = None, carry_type: str = "array<int>") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, slots (the class), sequence_id, offset and
    `carried`: the piece's ids, or what `carry` makes of them where the ids themselves aren't wanted."""
    small_batches(docs.sparkSession)
    make = carry or (lambda ids: ids.tolist())
    schema = f"part long, place long, doc_id long, start long, length long, doc_tokens long, slots long, number long, offset long, carried {carry_type}"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def tokenise(batches):
        key = (tokenizer, end_id)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = WordIds(tokenizer, end_id)
        encode, part = _TOKENIZERS[key].encode_column, TaskContext.get().partitionId()
        open_: dict[int, list] = {}
        made = placed = 0

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:9]] + [pa.array(columns[9], _ARROW[carry_type])], names=names)

        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                for start, length, k in pieces_of(len(ids), capacity, slack):
                    piece = [part, placed, doc_id, start, length, len(ids), k, None, None, make(ids[start : start + length])]
                    placed += 1
                    waiting = open_.setdefault(k, [])
                    waiting.append(piece)
                    if len(waiting) == k:  # the class's count is reached
                        at = 0
                        for w in waiting:
                            w[7], w[8], at = made, at, at + w[4]
                        out += waiting
                        made += 1
                        open_[k] = []
            if out:
                yield batch_of(out)
        rest = [w for waiting in open_.values() for w in waiting]
        if rest:
            yield batch_of(rest)

    pieces = stored(docs.select("doc_id", "text").mapInArrow(tokenise, schema), "packing")
    rest = pieces.where("number is null").withColumn("_group", F.expr(f"part div {fan_in}"))
    in_class = Window.partitionBy("_group", "slots").orderBy("part", "place")
    rest = rest.withColumn("number", F.floor((F.row_number().over(in_class) - 1) / F.col("slots")))
    before = Window.partitionBy("_group", "slots", "number").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    bins = rest.groupBy("_group", "slots", "number").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("fill"))
    merged = bins.where("n < slots").groupBy("_group").applyInPandas(lambda b: _merge(b, capacity), "_group long, slots long, number long, _slots long, _number long, _base long")
    rest = rest.join(merged, ["_group", "slots", "number"], "left")
    into = lambda name: F.coalesce(F.col(f"_{name}"), F.col(name))
    # an id for each sequence: even for a worker's own, odd for those filled from rests
    own = (F.col("part") * (1 << 40) + F.col("number")) * 2
    shared = ((F.col("_group") * (capacity + 1) + into("slots")) * (1 << 28) + into("number")) * 2 + 1
    keep = ["doc_id", "start", "length", "doc_tokens", "slots", "carried"]
    done = pieces.where("number is not null").select(*keep, "offset", own.alias("sequence_id"))
    return done.unionByName(rest.select(*keep, (F.col("offset") + F.coalesce("_base", F.lit(0))).alias("offset"), shared.alias("sequence_id")))


def _merge(bins, capacity: int):
    """Puts a group's unfinished sequences, one of each class at most, together by first fit decreasing."""
    open_, rows = [], []
    for b in bins.sort_values(["fill", "slots"], ascending=False).itertuples():
        into = next((o for o in open_ if o[2] + b.fill <= capacity), None)
        if into is None:
            open_.append(into := [b.slots, b.number, 0])
        rows.append((b[1], b.slots, b.number, into[0], into[1], into[2]))
        into[2] += b.fill
    return pd.DataFrame(rows, columns=["_group", "slots", "number", "_slots", "_number", "_base"])


_ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
