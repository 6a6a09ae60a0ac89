"""URL filter: host rules, and a logistic regression on hashed character n-grams, by column functions alone.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's path; the longest one decides. What no rule decides, the model does. Its labelled table
is bounded by `most_labels` distinct urls, taken by least MD5; each of `rounds` rounds of gradient
descent is an aggregation over it that gives at most `buckets` sums.

Edge cases: a null url or one without "://" has an empty host and path, fits no rule and is judged by
the model's intercept; without labelled urls of both kinds the model allows everything; repeated
urls are judged alike; very long urls are read whole; of rules that fit equally long the first listed decides; log-odds of 0
allow; an empty table gives no row. Extra columns are kept, whatever their names; those named host, path, rule, score and
verdict are replaced.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stored
from siftwell.llm.spans import let

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BUCKETS, SIZES, PRIME = 1024, (3, 4), 1_000_003
MOST_LABELS, ROUNDS, RATE, DECAY = 2_000, 16, 2.0, 1e-4


def with_parts(rows: DataFrame) -> DataFrame:
    """rows with host and path."""
    at = F.instr("url", "://")
    rest = F.when(F.col("url").isNotNull() & (at > 0), F.substring("url", at + 3, F.length("url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return rows.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))


def with_rule(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows with rule and rule_verdict of the longest rule that fits, or nulls."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: F.coalesce(*[F.when(_fits(h, p), F.lit(value(v, h, p))) for v, h, p in longest])
    return rows.withColumns({"rule": pick(lambda v, h, p: h + p), "rule_verdict": pick(lambda v, h, p: v)})


def features(host: Column, path: Column, buckets: int = BUCKETS, sizes=SIZES) -> Column:
    """Buckets of the character n-grams of host and path, each once: their code points as digits to the base 131, modulo a prime."""

    def grams(text: Column, salt: int) -> Column:
        def of(codes):
            def one(n: int):
                number = lambda i: reduce(lambda h, k: h * 131 + F.get(codes, i + k), range(n), F.lit(salt).cast("long"))
                some = F.sequence(F.lit(0), F.size(codes) - n)
                return F.when(F.size(codes) >= n, F.transform(some, lambda i: (number(i) % PRIME % buckets).cast("int"))).otherwise(F.array().cast("array<int>"))

            return F.concat(*[one(n) for n in sizes])

        return let(F.transform(F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != ""), lambda c: F.ascii(c)), of)

    return F.array_distinct(F.concat(grams(host, 1), grams(path, 2)))


def labelled(pages: DataFrame, rules=RULES, most_labels: int = MOST_LABELS) -> DataFrame:
    """url, blocked: distinct urls that a rule decides, at most `most_labels` of them."""
    rows = with_rule(with_parts(pages.select("url").where("url is not null")), rules).where("rule is not null")
    return rows.select("url", (F.col("rule_verdict") == "block").alias("blocked")).distinct().orderBy(F.md5("url"), "url").limit(most_labels)


def score(weights: list[float], bias: float) -> Column:
    """Log-odds of blocking."""
    table = F.expr(f"cast(split('{','.join(f'{w:.6f}' for w in weights)}', ',') as array<double>)")
    return F.lit(bias) + F.aggregate(F.col("_features"), F.lit(0.0), lambda a, k: a + F.get(table, k))


def fit(labels: DataFrame, buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression. labels: url, blocked."""
    rows = stored(with_parts(labels).select(features(F.col("host"), F.col("path"), buckets).alias("_features"), F.col("blocked").cast("double").alias("y")), "labelled-urls")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < positive < n:
        return [0.0] * buckets, -1.0
    weights, bias = [0.0] * buckets, math.log(positive / (n - positive))
    for _ in range(rounds):
        error = rows.select("_features", (F.col("y") - 1 / (1 + F.exp(-score(weights, bias)))).alias("e"))
        sums = error.select(F.explode(F.concat(F.col("_features"), F.array(F.lit(-1)))).alias("k"), "e").groupBy("k").agg(F.sum("e").alias("g")).collect()  # at most buckets + 1 rows
        weights = [w * (1 - rate * decay) for w in weights]
        for r in sums:
            if r["k"] < 0:
                bias += rate * r["g"] / n
            else:
                weights[r["k"]] += rate * r["g"] / n
    return weights, bias


RESULTS = ("host", "path", "rule", "score", "verdict")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, score (log-odds of blocking) and verdict."""
    weights, bias = fit(labelled(pages, rules) if labels is None else labels)
    own = [c for c in pages.columns if c not in RESULTS]
    rows = with_rule(with_parts(pages.select(F.struct(*own).alias("_page"), "url")), rules)
    rows = rows.withColumn("_features", features(F.col("host"), F.col("path"))).withColumn("score", score(weights, bias))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select(*[F.col("_page")[c].alias(c) for c in own], "host", "path", "rule", "score", verdict.alias("verdict"))
