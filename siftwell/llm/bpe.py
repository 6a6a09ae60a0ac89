"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task reads texts in chunks of about `CHUNK` bytes. Texts are cut into units (white space and
the word after it), of which only new ones are cut into the vocabulary's pieces; the new pieces of
a chunk are encoded together. For them an index maps each pair of neighbouring symbols that has a
merge to all its places. Merges are applied in ascending rank: a merge joins the pair at all its
places at once, the places beside them enter the lists of their new pairs, and stale places are
passed over when their turn comes. A merge can only make pairs of a higher rank, as its symbol
occurs in no earlier merge; a vocabulary where that doesn't hold is refused.

Memory of a task: a chunk, and at most `remembered` units with their ids, then these are forgotten.

Edge cases: null and empty texts have no ids; a very long text is a chunk of its own and takes time
linear in its length, one piece of a million letters too; the text of a special token becomes its id;
repeated rows are encoded each; an empty table gives an empty table; extra columns are ignored,
whatever their names. Ids outside the vocabulary decode to nothing, bytes that aren't UTF-8 to U+FFFD.
There are no ties: a pair of equal symbols in a run (aaa) is joined from the left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from siftwell.llm.common import small_batches
from siftwell.llm.packing import _byte_letters

#: Bytes of text that are encoded together.
CHUNK = 8 << 20
#: Units whose ids a task remembers.
REMEMBERED = 400_000
# Fixed value: the pattern of the pieces that merges don't cross.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Letters and digits that came after Unicode 16, which the vocabulary's classes take for signs.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_LATER = "[" + "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in LATER.split(" ")) + "]"
HAS_LATER = regex.compile(_LATER)
#: The same pattern for text with such letters; it is slower.
PIECES_LATER = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--{_LATER}]+| ?[\p{{N}}--{_LATER}]+| ?(?:[^\s\p{{L}}\p{{N}}]|{_LATER})+|\s+(?!\S)|\s+")
#: Pieces never go from a word into the white space after it, so units can be encoded alone.
UNITS = regex.compile(r"\s*\S+|\s+")
DEAD = -1


class Vocabulary:
    """Merges, byte symbols and special tokens of a tokenizer file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        ids, letters = model["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.wall = max([*ids.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([ids[x] for x in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        made = np.full(self.wall, -1)
        made[self.merges[:, 2]] = np.arange(len(pairs))
        if len(np.unique(self.merges[:, 2])) < len(pairs) or (made[self.merges[:, :2]].max(1, initial=-1) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merge that makes its symbol")
        keys = self.merges[:, 0] * (self.wall + 1) + self.merges[:, 1]
        self.rank_order = np.argsort(keys)
        self.keys = np.append(keys[self.rank_order], np.iinfo(np.int64).max)
        byte_of = {x: b for b, x in enumerate(letters)}
        words = [b""] * self.wall
        for token, i in ids.items():
            words[i] = bytes(byte_of[x] for x in token)
        for token, i in self.special.items():
            words[i] = token.encode()
        self.word_sizes = np.array([len(w) for w in words], np.int64)
        self.word_starts = np.cumsum(self.word_sizes) - self.word_sizes
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has no merge."""
        keys = left.astype(np.int64) * (self.wall + 1) + right
        at = np.searchsorted(self.keys, keys)
        found = self.keys[at] == keys
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.rank_order[at[found]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids in UTF-8, as text: what isn't UTF-8 is replaced."""
        ids = ids[(ids >= 0) & (ids < self.wall)]
        return self.word_bytes[spread(self.word_starts[ids], self.word_sizes[ids])].tobytes().decode("utf-8", "replace").encode()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after the other, and how many each has."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    # a wall before each piece and after the last keeps merges inside
    n = len(data) + len(pieces) + 1
    cells = np.arange(len(data)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)
    symbol = np.full(n, v.wall, np.int32)
    symbol[cells] = v.byte_ids[data]
    left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    places_of: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Lists the places whose symbol and the one after it have a merge."""
        ranks = v.ranks(symbol[places], symbol[right[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for rank, begin, end in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:]):
            if rank not in places_of:
                places_of[rank] = []
                heapq.heappush(active, rank)
            places_of[rank].append(places[begin:end])

    enter(cells)
    while active:
        rank = heapq.heappop(active)
        lists = places_of.pop(rank)
        places = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b, made = v.merges[rank].tolist()
        places = places[(symbol[places] == a) & (symbol[right[places]] == b)]
        if a == b and len(places) > 1:  # in a run, every second place from the left
            places = np.sort(places)
            at = np.arange(len(places))
            first = np.append(True, right[places[:-1]] != places[1:])
            places = places[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
        if not len(places):
            continue
        gone = right[places]
        after = right[gone]
        symbol[places], symbol[gone], right[places], left[after] = made, DEAD, after, places
        before = left[places]
        enter(np.concatenate([before[symbol[before] != made], places]))
    alive = symbol != DEAD
    walls = np.flatnonzero(symbol[alive] == v.wall)
    ids = symbol[alive]
    return ids[ids != v.wall], np.diff(walls) - 1


class _Numbers(dict):
    """Numbers keys as they come; `new` has those that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class _Ids:
    """The ids of numbered things, one list after the other."""

    def __init__(self):
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.ids[spread(self.starts[numbers], sizes)] if len(numbers) else np.zeros(0, np.int32), sizes


class Encoder:
    """Encodes columns of texts, and remembers the units and pieces that it has met."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.v, self.remembered = Vocabulary(path), remembered
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self._forget()

    def _forget(self) -> None:
        self.units, self.pieces, self.unit_ids, self.piece_ids = _Numbers(), _Numbers(), _Ids(), _Ids()
        # the empty unit has no ids; a special token, kept apart as bytes, has its own
        for unit in ("", *(s.encode() for s in self.v.special)):
            self.units[unit]
        self.units.new = []
        self.unit_ids.add(np.array(list(self.v.special.values()), np.int32), np.array([0] + [1] * len(self.v.special), np.int64))

    def _learn(self) -> None:
        if not self.units.new:
            return
        cut = PIECES_LATER if HAS_LATER.search("".join(self.units.new)) else PIECES
        found = [cut.findall(unit) for unit in self.units.new]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if self.pieces.new:
            self.piece_ids.add(*encode_pieces(self.v, [p.encode() for p in self.pieces.new]))
        ids, sizes = self.piece_ids.of(numbers)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        self.unit_ids.add(ids, np.diff(edges))
        self.units.new, self.pieces.new = [], []

    def _slowly(self, text: str) -> list[int]:
        """Numbers of the units of any text."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            out += [self.units[part.encode()]] if k % 2 else map(self.units.__getitem__, UNITS.findall(part))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.units) > self.remembered:
            self._forget()
        texts = texts.fill_null("")
        # Cut at single spaces: right where what stands before the space isn't white space.
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        words = distinct.to_pylist()
        numbers = np.fromiter(map(self.units.__getitem__, [" " + w for w in words]), np.int64, len(words))[codes]
        begins, ends = edges[:-1], edges[1:] - 1
        numbers[begins] = [self.units[words[c]] for c in codes[begins].tolist()]
        white = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))[codes]
        white[ends] = False
        first_empty = np.fromiter((not words[c] for c in codes[begins].tolist()), bool, len(begins))
        white[begins[first_empty]] = False
        odd = np.add.reduceat(white, begins) > 0 if len(begins) else np.zeros(0, bool)
        for special in self.v.special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        others = {k: np.array(self._slowly(texts[k].as_py()), np.int64) for k in np.flatnonzero(odd).tolist()}
        self._learn()
        ids, sizes = self.unit_ids.of(numbers)
        at = np.concatenate([[0], np.cumsum(sizes)])[edges]
        return [self.unit_ids.of(others[k])[0] if k in others else ids[at[k] : at[k + 1]] for k in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def _once(known: dict, make, path: str):
    """One encoder or vocabulary for each Python worker and file."""
    if path not in known:
        known[path] = make(path)
    return known[path]


def encode(docs: DataFrame, tokenizer: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id and the `ids` (array<int>) of each text by the tokenizer file at `tokenizer`."""
    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _once(_ENCODERS, Encoder, tokenizer)

        def done(waiting):
            batch = pa.Table.from_batches(waiting).combine_chunks()
            ids = encoder.encode(batch.column("text").combine_chunks())
            edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32)))
            yield from pa.table({"doc_id": batch.column("doc_id"), "ids": lists}).to_batches()

        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.column("text").nbytes
            if size >= chunk:
                yield from done(waiting)
                waiting, size = [], 0
        if waiting:
            yield from done(waiting)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _lists(batch: pa.RecordBatch):
    """The ids of each row as an array; null is empty."""
    for ids in batch.column("ids"):
        yield ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the `text` of each row's ids."""
    kind = encoded.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = _once(_VOCABULARIES, Vocabulary, tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.decode(ids).decode() for ids in _lists(batch)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (unsigned 32 bits, little-endian) and of the decoded text."""
    kind = encoded.select("doc_id").schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        v = _once(_VOCABULARIES, Vocabulary, tokenizer)
        for batch in batches:
            counts, ids_sha, texts_sha = [], [], []
            for ids in _lists(batch):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                texts_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(texts_sha, pa.string())], names=names)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
