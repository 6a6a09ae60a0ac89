"""The numbered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, linededup, negatives, packing, phrases, pii, quality, secrets, simhash, sql, substrings, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), carry=crc, carry_type="long")
    return pieces.select("doc_id", "start", "length", F.col("carried").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "slots")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.remove_repeated(table(spark, sf_dir, "documents")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_quality, op4_simhash, op5_decontamination, op6_secrets, op7_warc, op8_urls, op9_substrings, op10_lines, op11_bpe, op12_negatives, op13_phrases)}
ORACLE_SQL = sql.ORACLE_SQL
