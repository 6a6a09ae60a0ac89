"""Byte-level BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SMALL
from test_operators import DOC, odd
from tokenizers import Tokenizer

from siftwell.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "  ", "a", "a ", " a", "  a  b", "don't we'll I'D", "x\n\n y", "\n", "a\xa0b　c", "日本語 テキスト", "a" * 999, "ab" * 500, "<|endoftext|>",
    "hi <|endoftext|> there<|endoftext|><|endoftext|>  x", "\0a <|endoftext", "\0<|endoftext|>", "\x1c a\x1d b", "tab\tx \t y", "é" * 9, "é", "👍🏽 x", "1234567 8", "a\r\nb", "\x85 a",
    "​ x", " " * 50 + "a", "᠎ a ﻿ b", "x " * 300, "a.b,c;d'e \"f\"",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert encoder.v.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_odd_and_random_texts(library):
    encoder = bpe.Encoder(PATH, remembered=500)  # forgets on the way
    check(encoder, library, ODD)
    rnd = random.Random(1)
    letters = list(" \n\tabcAB1'.,<|>é　\x1c日́") + ["<|endoftext|>", "ing", " the", "  "]
    for _ in range(6):
        check(encoder, library, ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(700)])


def test_every_letter_is_cut_as_by_the_library(library):
    """Classes of letters: each code point between letters, digits, signs and white space."""
    cut = library.pre_tokenizer.pre_tokenize_str
    wrong = []
    for c in (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        text = f"a{c}1{c}!{c} {c}"
        pattern = bpe.PIECES_LATER if bpe.HAS_LATER.search(text) else bpe.PIECES
        if len(cut(text)) != len(found := pattern.findall(text)) or [text[a:b] for _, (a, b) in cut(text)] != found:
            wrong.append(hex(ord(c)))
    assert not wrong
    encoder = bpe.Encoder(PATH)
    later = [f"a{c}b {c}{c} 1{c}!" for c in map(chr, (0x558, 0x10940, 0x11DE5, 0x1246F, 0x323B0, 0x3FC3F))]
    check(encoder, library, later + ["plain text"] + later)


def test_runs_and_pieces_of_any_length():
    v = bpe.Vocabulary(PATH)

    def plainly(piece):
        rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges.tolist())}
        ids = [int(v.byte_ids[x]) for x in piece]
        while True:
            pairs = [(rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                return ids
            r, k = min(pairs)
            ids[k : k + 2] = [int(v.merges[r][2])]

    rnd = random.Random(2)
    pieces = [b"a" * n for n in range(1, 40)] + [bytes(rnd.choices(b"abthe ing", k=rnd.randint(1, 60))) for _ in range(200)] + [bytes(rnd.randrange(256) for _ in range(30)) for _ in range(50)]
    ids, sizes = bpe.encode_pieces(v, pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plainly(p) for p in pieces]
    ids, sizes = bpe.encode_pieces(v, [b"ab" * 500_000])  # linear in the length
    assert v.decode(ids) == b"ab" * 500_000


def test_query(spark, library):
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op11_bpe"](spark, SMALL).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_edges(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD)), DOC)
    encoded = bpe.encode(df, PATH, chunk=50)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.encode(df.limit(0), PATH).count() == 0 and bpe.digest(encoded.limit(0), PATH).count() == 0
    got = bpe.encode(odd(spark), PATH)
    assert got.columns == ["doc_id", "ids"] and got.count() == 10 and {len(r["ids"]) for r in got.where("doc_id in (2, 3)").collect()} == {0}
    named = bpe.encode(df.selectExpr("concat('d', doc_id) as doc_id", "text", "'x' as ids"), PATH)
    assert {r["doc_id"] for r in named.collect()} == {f"d{k}" for k in range(len(ODD))}
    bad = spark.createDataFrame([(1, [15496, 999999, -4]), (2, None), (3, [160])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bad, PATH).collect()} == {1: "Hello", 2: "", 3: library.decode([160], skip_special_tokens=False)}


def test_refuses_other_vocabularies(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = [["Ġt", "he"], *spec["model"]["merges"]]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="merge"):
        bpe.Vocabulary(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
