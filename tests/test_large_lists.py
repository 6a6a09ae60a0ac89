"""Operators on large dictionaries, lists and groups against their plain forms."""

import random
import time

from pyspark.sql import functions as F
from test_golden import values

from siftwell.functions import extract, text
from siftwell.operators import facets, rules, scoring, state


def test_scores_by_an_index_equal_the_plain_ones(spark):
    from conftest import SMALL
    from siftwell.sources.fixtures import postings

    rows = postings(spark, SMALL).withColumn("company", F.when(F.col("seq") % 9 == 0, None).otherwise(text.canonical_company(F.col("company"))))
    extra = [(10**6 + n, t, c, p) for n, (t, c, p) in enumerate([(None, None, None), ("", "Black Box Corp", "SF, Boston"), ("intern engineer intern", "Box Box", "new york new york"), ("Sre/devops!", "goldman-sachs group", "x")])]
    rows = rows.select("seq", "title", "company", "location").unionByName(spark.createDataFrame(extra, "seq long, title string, company string, location string"))
    names = ["seq", "role_points", "company_points", "location_points", "score", "score_label", "matched_keywords"]
    want = scoring.scored(rows).select(*names)
    got = scoring.scored_by(rows, scoring.dictionary_rows(spark)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keywords_with_a_word_in_common(spark):
    """As many companies as keywords, all of one first word: by that word alone they would make 3.6 billion pairs (no end in 80 s)."""
    n = 60_000
    listed = spark.range(n).select(F.lit("company").alias("component"), F.lit("listed").alias("tier"), F.lit(9).alias("tier_ord"), F.lit(5).alias("points"), F.col("id").cast("int").alias("kw_ord"), F.concat(F.lit("customer#"), "id").alias("keyword"))
    rows = spark.range(n + 2).select(F.col("id").alias("seq"), F.lit("intern").alias("title"), F.concat(F.lit("The Customer #"), "id", F.lit(" Ltd")).alias("company"), F.lit(None).cast("string").alias("location"))
    began = time.monotonic()
    got = scoring.scored_by(rows, scoring.dictionary_rows(spark).unionByName(listed)).groupBy("company_points").agg(F.count("seq").alias("n"), F.max("seq").alias("last"))
    assert sorted(map(tuple, got.collect())) == [(0, 2, n + 1), (5, n, n - 1)]
    assert time.monotonic() - began < 60


def test_a_hundred_thousand_domains(spark):
    listed = spark.range(100_000).select(F.concat(F.lit("site"), "id", F.lit(".example.com")).alias("domain")).unionByName(spark.createDataFrame([("Simplify.Jobs",)], "domain string"))
    urls = ["https://site7.example.com/x", "https://a.b.site99999.example.com", "https://site100000.example.com/", "https://example.com/", "https://notsimplify.jobs/", "https://www.simplify.jobs:80/p", "no url", None]
    df = spark.createDataFrame([(n, u) for n, u in enumerate(urls)], "n int, url string")
    assert [r["aggregator"] for r in rules.aggregator_links(df, listed).orderBy("n").collect()] == [True, True, False, False, False, True, True, True]
    short = spark.createDataFrame([("simplify.jobs",)], "domain string")
    assert [r["aggregator"] for r in rules.aggregator_links(df, short).orderBy("n").collect()] == values(spark, urls, rules.aggregator_link(F.col("x"), ["simplify.jobs"]))


def test_places_in_groups_of_any_size(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["huge", "huge", "huge", "small", None]), n, rnd.randint(0, 50)) for n in range(4000)]
    df = spark.createDataFrame(rows, "g string, n int, x int")
    got = facets.page_numbers(df, "g", [F.desc("x"), "n"], 7, parts=9)
    want = {}
    for group in {r[0] for r in rows}:
        for place, (_, n, _) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1])), 1):
            want[n] = (place, -(-place // 7))
    assert got.columns == ["g", "n", "x", "place", "page"] and {r["n"]: (r["place"], r["page"]) for r in got.collect()} == want


def test_presence(spark):
    shots = {"t": {1: {"a", "b"}, 2: {"b", "c"}, 3: set(), 4: {"a", "c"}, 5: {"a", "c"}}, "u": {2: {"a"}}}
    rows = spark.createDataFrame([(t, ts, i) for t, all_ in shots.items() for ts, ids in all_.items() for i in sorted(ids)], "target string, ts int, job_id string")
    taken = spark.createDataFrame([(t, ts) for t, all_ in shots.items() for ts in all_], "target string, ts int")
    got = {(r["target"], r["ts"]): (r["kept"], r["gone"], r["added"]) for r in facets.snapshot_changes(rows.unionByName(rows), taken).collect()}
    want = {}
    for t, all_ in shots.items():
        before = set()
        for ts, ids in sorted(all_.items()):
            want[t, ts] = (len(ids & before), len(before - ids), len(ids - before))
            before = ids
    assert got == want


def test_leave_one_out(spark):
    rows = [(s, a, p) for s in ("x", "y") for a in (True, False, None) for p in (1, 5)]
    df = spark.createDataFrame(rows, "source string, applied boolean, points int")
    filters = {"source": F.col("source") == "x", "applied": F.col("applied"), "points": F.col("points") > 3}
    got = facets.leave_one_out(df, filters, {"source": ("source", F.array("source")), "applied": ("applied", F.array("applied")), "all": (None, F.array(F.lit("all"))), "none": ("points", F.lit(None).cast("array<string>"))})
    assert {tuple(r) for r in got.collect()} == {("all", "all", 1), ("applied", None, 1), ("applied", "false", 1), ("applied", "true", 1), ("source", "x", 1), ("source", "y", 1)}


def test_references_that_are_no_characters(spark):
    rows = ["&#9999999;", "&#x110000;", "&#xD800; &#55296;", "&#x10FFFF;|&#65;", "a &#0000065; &#x1F600;"]
    got = values(spark, rows, text.strip_html(F.col("x")))
    assert got == ["&#9999999;", "&#x110000;", "&#xD800; &#55296;", "\U0010ffff|A", "a A \U0001f600"]
    assert values(spark, rows, text.strip_markdown(F.col("x")))[:3] == rows[:3]


# --- costly expressions are worked out once ------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pay_without_figures_is_fast(spark):
    """Numbers that aren't there aren't cast: it took a failed cast for each pattern and field."""
    rows = spark.range(200_000).select(F.concat(F.lit("a $ sign in row "), "id").alias("x"))
    began = time.monotonic()
    assert rows.where(extract.salary(F.col("x")).isNotNull()).count() == 0
    assert time.monotonic() - began < 15


def test_pay_and_white_space(spark):
    texts = ["a\u00a0 b $25\t-\n\n30 / hr", "$ 25\u00a0- $30/hr", "x\ty 12 $95k", "$95 \t k", "Unpaid $95k", "no   compensation; $95k", "uNpAiD, $95k", "compensation of $95k", "pro\u00a0bono $95k"]
    got = [r and (r["text"], r["min"], r["max"], r["unit"]) for r in values(spark, texts, extract.salary(F.col("x")))]
    assert got == [("$25 - 30 / hr", 25, 30, "hourly"), ("$ 25 - $30/hr", 25, 30, "hourly"), ("$95k", 95_000, 95_000, "yearly"), ("$95 k", 95_000, 95_000, "yearly"), None, None, None, ("$95k", 95_000, 95_000, "yearly"), ("$95k", 95_000, 95_000, "yearly")]


def test_described_rows_look_for_their_heading_once(spark):
    plan = plan_of(spark.createDataFrame([("a",)], "x string").select(text.trimmed_description(F.col("x")).alias("t")))
    assert plan.count("your role") == 1


def test_tokens_are_made_once_for_all_keywords(spark):
    from conftest import SMALL
    from siftwell import bindings

    plan = plan_of(bindings.QUERIES["f11_roles"](spark, SMALL))
    assert plan.count("[^a-z0-9]+") <= 6


def test_rows_of_a_table_with_many_splits_are_dealt_out(spark):
    from siftwell.sources.fixtures import postings

    path = "/root/testdata/sf0.01"
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "32k")
        splits = spark.read.parquet(f"{path}/orders.parquet").rdd.getNumPartitions()
        assert splits >= spark.sparkContext.defaultParallelism
        assert postings(spark, path).rdd.getNumPartitions() == 4 * splits
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_descriptions_are_cleaned_once(spark):
    rows = spark.createDataFrame([(1, "a", "x", "c")], "id int, description string, source string, company string")
    assert plan_of(state.description_plan(rows)).count("WHAT WE OFFER") == 1


def test_the_hard_filter_lowers_a_title_once_for_all_fragments(spark):
    from conftest import SMALL
    from siftwell import bindings

    assert plan_of(bindings.QUERIES["a15_digest_line"](spark, SMALL)).lower().count("contains(lower(") == 0
