"""Secret scans: three patterns, and strings that a Markov model finds random, by column functions alone.

The labelled samples come from the corpus: values that the patterns find are random strings; the
plain words of `most_docs` whole documents, and identifiers made of two words in a row and a number, are ordinary ones.
Both sides are bounded by `most_samples` distinct strings. Documents and strings are taken by least hash, so that
repeated runs train on the same ones.
A candidate is a run of `least_length` or more characters of [A-Za-z0-9+/_=-] with letters and
digits, outside the base spans; it is a secret where the mean log-likelihood ratio over its
pairs is above `margin`.

Edge cases: null and empty texts have no span; without any random sample nothing is added to the base;
very long texts and runs are read whole; repeated documents are scanned one by one; spans of different kinds may overlap, those
that begin together come in the order of the kinds; a ratio that equals the margin is no secret; an empty table
gives no row. Extra columns are kept, whatever their names; a column `spans` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import markov
from siftwell.llm.spans import count_of, listed, of_kind, places, redacted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
MOST_SAMPLES, MOST_DOCS, MARGIN = 20_000, 1_000, 0.5
KINDS = ("assign", "access", "hex", "markov")


def _assigned(text: Column) -> Column:
    found = places(text, ASSIGN, F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")))
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_ASSIGNED)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind."""
    access = F.filter(places(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["value"]) >= LEAST_ACCESS)
    kinds = zip(KINDS, (_assigned(text), access, places(text, HEX)))
    return _sorted(F.concat(*[of_kind(k, found, n) for n, (k, found) in enumerate(kinds)]))


def _sorted(spans: Column) -> Column:
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return by_start


def labelled_samples(docs: DataFrame, most_samples: int = MOST_SAMPLES, most_docs: int = MOST_DOCS) -> DataFrame:
    """value, random: what the patterns find, and plain words and the identifiers made of them; at most `most_samples` distinct strings of each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.explode(base_spans(text)).alias("s")).select("s.kind", "s.value")
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    randoms = found.select(secret.alias("value")).where("length(value) >= 16 and value rlike '[0-9]'")
    # the hash that the sample ends at is found on hashes alone
    digests = docs.where("text is not null").select(F.md5("text").alias("h"))
    last = digests.distinct().orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]
    sample = docs.where(F.md5("text") <= F.lit(last)).select("text").distinct()
    words = sample.select(F.regexp_extract_all("text", F.lit(r"(?<![^\x20\n])[A-Za-z][a-z]{5,39}(?=[\x20\n.,])"), F.lit(0)).alias("words"))
    # word_next_12: the number is the word's place
    names = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    named = F.transform(names, lambda p, i: F.concat_ws("_", p["a"], p["b"], (i % 100).cast("string")))
    ordinary = words.select(F.explode(F.concat("words", named)).alias("value"))
    least = lambda df: df.distinct().orderBy(F.md5("value"), "value").limit(most_samples)
    return least(randoms).withColumn("random", F.lit(True)).unionByName(least(ordinary).withColumn("random", F.lit(False)))


def scan(docs: DataFrame, most_samples: int = MOST_SAMPLES, margin: float = MARGIN) -> DataFrame:
    """docs with spans (start, rank, end, kind, value: by start, then kind) of both the patterns and the model."""
    weights = markov.train(labelled_samples(docs, most_samples))
    own = [c for c in docs.columns if c != "spans"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*own).alias("_doc"), base_spans(text).alias("_base"), places(text, RUN).alias("_runs"))
    outside = lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    mixed = lambda r: F.regexp_like(r["value"], F.lit("[A-Za-z]")) & F.regexp_like(r["value"], F.lit("[0-9]"))
    added = F.when(F.size("_runs") == 0, F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(F.filter("_runs", lambda r: mixed(r) & outside(r) & (markov.ratio(r["value"], weights) > margin)))
    rows = rows.select("_doc", "_base", added.alias("_added"))
    model = F.transform(of_kind("markov", F.col("_added"), 3), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in own], _sorted(F.concat("_base", model)).alias("spans"))


def masked(scanned: DataFrame) -> DataFrame:
    """The texts with each secret replaced by the mark of its kind."""
    return scanned.withColumn("text", redacted(F.col("text"), F.col("spans"), {k: f"[{k.upper()}]" for k in KINDS}))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return scanned.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count_of(F.col("spans"), "markov").alias("n_markov"))
