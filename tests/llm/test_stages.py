"""The pipeline's stages one by one on odd rows: nulls, empty and very long texts, repeated rows, clashing names, empty tables."""

import random

import corpus_pipeline
import pytest
from conftest import SMALL
from test_operators import odd


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    df = odd(spark)
    got = stage(spark, df, SMALL)
    rows = got.collect()
    assert stage(spark, df.limit(0), SMALL).count() == 0
    if name != "packing":
        assert got.columns == df.columns and all(r["_id"] == "mine" and r["spans"] == "mine" for r in rows)
    texts = [(r["doc_id"], r["text"]) for r in rows] if "text" in got.columns else []
    if name == "quality rules":
        assert texts == []  # too few words, or words that repeat
    elif name == "line dedup":  # the long text's copy goes as a whole, short single lines stay
        assert len(texts) == 9 and (5, "") not in texts and sorted(t for i, t in texts if i == 1) == ["a text of the day", "a text of the day", "another"] and (2, None) in texts
    elif name == "near dedup":
        assert sorted(i for i, _ in texts if i is not None) == [1, 1, 2, 4] and len(texts) == 5
    elif name == "decontamination":
        assert len(texts) == 10
    else:
        assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1 and sum(r["length"] for r in rows if r["doc_id"] == 3) == 1


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_of_any_name(spark, name, stage):
    """Names that the operators use themselves, with dots and accents, and doc_ids that are texts."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(f"d{n}", "\n".join(" ".join(x for _ in range(8) for x in (rnd.choice(["the", "of", "and"]), word(), word())) for _ in range(4)), n) for n in range(4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n int").selectExpr("doc_id", "text", "n as n_removed", "n as n_lines", "n as removed_chunks", "n as `a.b`", "n as `kept`", "n as _doc", "n as contaminated", "n as node")
    got = stage(spark, df, SMALL)
    assert got.columns == df.columns
    rows = got.collect()
    assert rows and all(r["doc_id"] == f"d{r['n_removed']}" and r["n_removed"] == r["n_lines"] == r["a.b"] == r["kept"] == r["_doc"] == r["node"] for r in rows)
