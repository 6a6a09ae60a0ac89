"""Quality rules: a threshold table compiled into one projection, by column functions alone.

Every document gets its counts (words, characters, symbols, repeated lines, repeated 8-word
windows, stop words), and the table's rules become one CASE that names the first rule that a
document breaks. Two rules are the base: too few words, too many words in repeated windows.

Edge cases: a null text counts as one without words and fails the base; so does an empty one;
ratios are over one word at least; repeated documents are judged one by one; an empty table gives
no row. `passing` keeps every column as it is; `judged` replaces columns that have the names of its
measures and uses names that begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import whole_row

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by are be this at or an from",
    "le la les de des du et un une en est que qui dans pour au par sur il ce",
    "der die das und in zu den von mit ist des auf für ein eine dem nicht im sich als auch",
    "el la los las de que y en un una por con no se del para es al lo su",
)

#: (rule, measure, comparison, threshold): a document that satisfies one of these is rejected. The base rules come first.
THRESHOLDS = [
    ("too_few_words", "n_words", "<", 20),
    ("repeated_windows", "100 * n_repeat_words / greatest(n_words, 1)", ">", 30),
    ("symbols_per_word", "n_symbols / greatest(n_words, 1)", ">", 0.25),
    ("shouts_per_word", "n_shouts / greatest(n_words, 1)", ">", 0.5),
    ("short_words", "word_chars / greatest(n_words, 1)", "<", 2.0),
    ("long_words", "word_chars / greatest(n_words, 1)", ">", 40.0),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", ">", 0.5),
    ("few_stop_words", "case when n_words >= 50 then n_stop_words / n_words else 1 end", "<", 0.01),
]
BASE = ("too_few_words", "repeated_windows")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]


def _blank(text: Column) -> Column:
    return F.translate(text, WHITE, " " * len(WHITE))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measures that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({form for line in STOP_WORDS for w in line.split() for form in (w, w.capitalize())})
    rows = docs.withColumn("_words", F.array_remove(F.split(_blank(text), " "), ""))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.trim(_blank(line)) != ""))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
    })
    rows = rows.drop("_lines")
    # windows by hash; only where a hash comes twice are the windows' own words compared
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - WINDOW + 1)
    at = lambda i, k: F.get(F.col("_hashes"), i + (k - 1))
    hashed = F.when(F.col("n_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    rows = rows.withColumn("_windows", hashed)
    rows = rows.withColumn("_again", F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False))).drop("_windows", "_hashes")
    spelt = F.when(F.col("_again"), F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("s"), i.alias("i")))))
    rows = rows.withColumn("_sorted", spelt).drop("_words")
    same = lambda j, k: F.get(F.col("_sorted"), j)["s"] == F.coalesce(F.get(F.col("_sorted"), k)["s"], F.lit(""))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0))))), lambda j: F.get(F.col("_sorted"), j)["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(0).cast("long"))
    # as a generated row, the measures are computed once: a filter on them isn't pushed into their expressions
    own = [c for c in docs.columns if c not in MEASURES]
    return rows.select(*own, F.inline(F.array(F.struct(*MEASURES))))


def broken_rule(thresholds=THRESHOLDS) -> Column:
    """The first rule that a measured document breaks, or null."""
    return F.coalesce(*[F.when(F.expr(f"({measure}) {comparison} {threshold}"), F.lit(rule)) for rule, measure, comparison, threshold in thresholds])


def judged(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """docs with measures, broken_rule, base_failed and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured(docs).withColumns({"base_failed": base, "broken_rule": broken_rule(thresholds)})
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull())


def passing(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    rows = docs.select("text", whole_row(docs).alias("_doc"))
    return judged(rows, thresholds).where("kept").select("_doc.*")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_shouts")
