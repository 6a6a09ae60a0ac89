"""Two character Markov models compared by log-likelihood ratio, by column functions alone.

Training counts the character pairs of labelled strings with aggregations; what reaches the
driver are at most 2 x 70 x 70 counts. Scoring looks pairs up in one array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.spans import let

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: States: 0 for any other character, then those of the alphabet.
STATES = len(ALPHABET) + 1


def _pairs(text: Column) -> Column:
    """Numbers of the character pairs of a string."""
    states = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(states, lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a * STATES + b))


def train(samples: DataFrame, smoothing: float = 0.5, backing: float = 5.0) -> list[float]:
    """log P(next | this, random) - log P(next | this, ordinary) for each pair. samples: value, random (boolean).

    A pair's probability backs off to that of its second character, weighted like `backing` pairs.
    """
    rows = samples.where(F.length("value") > 1).select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = {kind: [0.0] * (STATES * STATES) for kind in (True, False)}
    for r in rows.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * STATES ** 2 rows
        counts[r["random"]][r["pair"]] += r["n"]

    def logs(c: list[float]) -> list[float]:
        whole = sum(c) + smoothing * STATES
        alone = [(sum(c[b::STATES]) + smoothing) / whole for b in range(STATES)]
        totals = [sum(c[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        return [math.log((n + backing * alone[k % STATES]) / (totals[k // STATES] + backing)) for k, n in enumerate(c)]

    return [round(a - b, 4) for a, b in zip(logs(counts[True]), logs(counts[False]))]


def ratio(text: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of a string; 0 if it has none."""
    table = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<double>)")
    total = F.aggregate(_pairs(text), F.lit(0.0), lambda a, p: a + F.get(table, p))
    return F.when(F.length(text) > 1, total / (F.length(text) - 1)).otherwise(F.lit(0.0))
