"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. There is no SQL for the rolling hashes of line dedup and for the packing, so the
whole is tested against a brute-force version.

Edge cases, for every stage: null and empty texts fail the quality rules; taken one by one, the later stages keep null
texts (line dedup), keep one of them (near dedup), call them clean (decontamination) and pack them as one end mark (packing);
very long texts are worked on whole; of rows that tie the one with the smallest doc_id stays, of repeated rows the first as
written; an empty table gives an empty table; extra columns are kept, whatever their names, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, linededup, nearsets, quality
from siftwell.llm.common import stored
from siftwell.llm.queries import packed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; a document of which nothing is left goes."""
    cut = linededup.cut(docs).where("n_removed = 0 or text rlike '[^\\\\s]'")
    own = {c: F.col("text") if c == "text" else F.col("_doc")[c] for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[value.alias(c) for c, value in own.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, SimHash links checked exactly, then what else has a similarity of 0.8."""
    return nearsets.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
