"""Golden values, and properties of the operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import extract, text
from siftwell.operators import dedup, facets, rules, scoring, state
from siftwell.operators.location import all_countries, location_class
from siftwell.plans import ingest
from siftwell.sources import payloads

AS_OF = datetime.datetime(2026, 6, 5, tzinfo=datetime.timezone.utc)


def values(spark, rows, column, name="x"):
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], f"n int, {name} string")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def test_company(spark):
    pairs = {
        "Itron, Inc.": "Itron", "Synopsys Inc": "Synopsys", "Persistent Systems, LLC": "Persistent Systems", "Fortera Corporation": "Fortera", "Base Power Company": "Base Power",
        "Al Warren Oil Company, Inc.": "Al Warren Oil", "The Bancorp Bank, N.A.": "The Bancorp Bank", "Samsung Research America (SRA)": "Samsung Research America", "NVIDIA AI": "NVIDIA",
        "Perplexity AI": "Perplexity", "Adobe Systems": "Adobe", "Amazon.com": "Amazon", "CACI International": "CACI", "Character AI": "Character AI",
        "Palo Alto Networks": "Palo Alto Networks", "Costco": "Costco", "Smiths Detection": "Smiths Detection",
    }
    got = values(spark, list(pairs), text.canonical_company(F.col("x")))
    assert got == list(pairs.values())
    assert values(spark, got, text.canonical_company(F.col("x"))) == got


def test_links(spark):
    pairs = {
        "https://a.example/jobs/7774031?utm_source=Simplify&ref=Simplify": "https://a.example/jobs/7774031",
        "https://a.example/j?gh_jid=4691297005&gh_src=Simplify": "https://a.example/j?gh_jid=4691297005",
        "https://a.example/viewjob?jk=5672f4d7e4739c43&utm_source=Simplify": "https://a.example/viewjob?jk=5672f4d7e4739c43",
        "https://a.example/job?mobile=true&needsRedirect=false&utm_source=Simplify&ref=Simplify": "https://a.example/job?mobile=true&needsRedirect=false",
        "https://a.example/x#top": "https://a.example/x#top", "https://a.example/x#ref=1": "https://a.example/x", "": "",
    }
    got = values(spark, list(pairs), text.strip_tracking(F.col("x")))
    assert got == list(pairs.values()) and values(spark, got, text.strip_tracking(F.col("x"))) == got


def test_key(spark):
    df = spark.createDataFrame([("Stripe", "Software Engineer Intern, Summer 2025 (Remote)"), ("Stripe", "Software Engineer Intern"), ("Stripe", "Backend Engineer Intern")], "c string, t string")
    a, b, c = (r[0] for r in df.select(text.normalized_key(F.col("c"), F.col("t"))).collect())
    assert a == b == "stripe::software engineer" != c


@pytest.mark.parametrize("title,tokens", [("Intern (Fall / Winter 2026)", ["fall-2026", "winter-2026"]), ("Co-op (Summer/Fall 2026)", ["fall-2026", "summer-2026"]), ("Intern - Summer 2026", ["summer-2026"]), ("Fall 2026 / Spring 2027", ["fall-2026", "spring-2027"]), ("Intern '26", []), ("Intern 2027", ["year-2027"]), ("2026 Summer Intern", ["summer-2026"])])
def test_seasons(spark, title, tokens):
    assert values(spark, [title], extract.season_tokens(F.col("x"))) == [tokens]


def test_expired(spark):
    old = ["Summer 2023", "Summer 2025", "(Fall 2025)", "Winter 2026", "Spring 2026"]
    new = ["Fall 2026", "Winter 2027", "no season", "Fall 2025 / Spring 2027", "Summer 2026"]
    column = extract.expired(extract.season_with_default(extract.season_tokens(F.col("x")), AS_OF), AS_OF)
    assert values(spark, old + new, column) == [True] * 5 + [False] * 5


def test_locations(spark):
    kinds = {
        "non_us": ["Cambridge, United Kingdom", "Hsinchu, Taiwan", "Moscow, Russia", "Abidjan, Ivory Coast", "Edinburgh, Scotland", "DE - Berlin", "CA-ON-MISSISSAUGA-P22M01", "IN-Pune"],
        "us": ["Las Cruces, New Mexico", "AZ - Chandler", "CA - San Francisco"], "unknown": ["", "Remote"],
    }
    for kind, rows in kinds.items():
        assert values(spark, rows, location_class(F.col("x"))) == [kind] * len(rows)


def test_locations_by_all_countries(spark):
    countries = all_countries(spark)
    assert len(countries) > 240 and not {"us", "pr", "gu"} & {two for two, _, _ in countries}
    kinds = {
        "non_us": ["Nairobi, Kenya", "Tallinn, Estonia", "Office in Kazakhstan", "Reykjavik, Iceland", "Ulaanbaatar, MNG", "LK-Colombo-001", "Hsinchu, Taiwan", "Leeds, England"],
        "us": ["Atlanta, Georgia", "San Juan, PR", "AZ - Chandler", "New York, NY", "Cambridge, MA USA"], "unknown": ["", "Remote"],
    }
    for kind, rows in kinds.items():
        assert values(spark, rows, location_class(F.col("x"), countries)) == [kind] * len(rows)
    assert values(spark, ["Office in Kazakhstan"], location_class(F.col("x"))) == ["unknown"]


@pytest.mark.parametrize("title,place,reason", [("SWE Intern", "London, UK", "non_us"), ("SWE Intern", "New York, NY", None), ("PhD Intern – Research", "New York, NY", "phd_required"), ("🔒 Backend Engineer Intern", "Remote", "closed"), ("Marketing Intern", "San Francisco, CA", "non_swe"), ("Software Engineer Intern - Summer 2020", "Remote in USA", "expired_season"), ("Software Engineer Intern - Summer 2099", "Remote in USA", None)])
def test_hard_filter(spark, title, place, reason):
    df = spark.createDataFrame([(title, place)], "title string, location string")
    assert rules.hard_filtered(df, AS_OF).first()["exclusion_reason"] == reason


@pytest.mark.parametrize("title,company,place,score", [("Software Engineer Intern", "Anthropic", "San Francisco, CA", 100), ("General Business Intern", "Corp LLC", "Columbus, OH", 0), ("Software Engineer Intern", "Corp LLC", "", 40), ("Undergrad Engineering Intern", "Apple", "United States", 83), ("Software Engineering Intern", "Corp LLC", "", 40), ("Software Engineer Intern", "Snyk", "", 60), ("", "Black Box Corp", "", 0), ("", "Box Inc", "", 20), ("", "Two Sigma Investments LLC", "", 70), (None, None, None, 0)])
def test_score(spark, title, company, place, score):
    df = spark.createDataFrame([(title, company, place)], "title string, company string, location string")
    assert scoring.scored(df).first()["score"] == score


def test_salary(spark):
    rows = ["Internship Unpaid. $120,000-$180,000 in assets.", "We raised $50,000-$75,000 in our seed round.", "SWE Intern $25-30/hr", "New Grad $120-180k", None, "$1/hr"]
    got = [r and (r["unit"], r["min"], r["max"]) for r in values(spark, rows, extract.salary(F.col("x")))]
    assert got == [None, None, ("hourly", 25.0, 30.0), ("yearly", 120_000.0, 180_000.0), None, None]


def test_boards(spark):
    urls = ["https://nvidia.wd5.myworkdayjobs.com/NVIDIAExternalCareerSite/job/12345", "https://intel.wd1.myworkdayjobs.com/en-US/External/job/123", "https://boards.greenhouse.io/anthropic/jobs/123", "https://ats.rippling.com/en-US/inspectoriocareers/jobs/ab", "https://apply.workable.com/quadric-dot-i-o-inc/j/52EA39411C/apply", "https://linkedin.com/jobs/view/123"]
    got = [r and (r["ats"], r["slug"], r["board"]) for r in values(spark, urls, extract.board_address(F.col("x")))]
    assert got == [("workday", "nvidia", "NVIDIAExternalCareerSite"), ("workday", "intel", "External"), ("greenhouse", "anthropic", None), ("rippling", "inspectoriocareers", None), ("workable", "quadric-dot-i-o-inc", None), None]


def test_html(spark):
    assert values(spark, ["<p>a&amp;b</p><br>c &#8217;&#x2014;", "<br><br>", None], text.strip_html(F.col("x"))) == ["a&b \nc ’—", "", None]


def test_trim_is_idempotent(spark):
    rows = ["", "Job Details: x", "Who We Are " + "blah " * 60 + "TEAM OVERVIEW: We build. " + "word " * 200, "x. " * 900]
    once = values(spark, rows, text.trimmed_description(F.col("x")))
    assert once[:2] == rows[:2] and once[2].startswith("TEAM OVERVIEW") and len(once[3]) <= 2000 and once[3].endswith(".")
    assert values(spark, once, text.trimmed_description(F.col("x"))) == once


def sequential(rows):
    links, keys, out = set(), set(), {}
    for seq, link, key in sorted(rows):
        if link and link in links:
            out[seq] = "same_link"
        elif key in keys:
            out[seq] = "same_key"
        else:
            out[seq] = "keep"
            links.add(link)
            keys.add(key)
    return out


def test_batch_outcome(spark):
    fixed = [(1, "L1", "K1"), (2, "L1", "K2"), (3, "L2", "K2"), (4, "L3", "K1"), (5, "L3", "K3")]
    rnd = random.Random(5)
    for rows in (fixed, [(n, rnd.choice(["", *"abcdefgh"]), rnd.choice("uvwxyz")) for n in range(60)]):
        df = spark.createDataFrame(rows, "seq long, stripped string, normalized_key string")
        assert {r["seq"]: r["outcome"] for r in dedup.batch_outcome(df).collect()} == sequential(rows)


def test_disappeared(spark):
    store = spark.createDataFrame([("gone", "Greenhouse", "acme", "1", False), ("present", "Greenhouse", "acme", "2", False), ("other", "Greenhouse", "beta", "1", False), ("source", "Lever", "acme", "1", False), ("old", "Greenhouse", "acme", "1", True)], "id string, source string, target string, job_id string, archived boolean")
    scan = spark.createDataFrame([("Greenhouse", "acme", "2")], "source string, target string, job_id string")
    assert [r["id"] for r in state.disappeared(store, scan).collect()] == ["gone"]


def test_groups(spark):
    rows = [("Acme", 80, True), ("Acme", 90, False), ("Beta", 95, False), ("Quadric", 1, False), ("QUADRIC", 1, False), ("", 2, False)]
    df = spark.createDataFrame(rows, "company string, score int, applied boolean").withColumn("posted_at", F.lit(AS_OF))
    got = {r["company"]: (r["postings"], r["mean_score"], r["applied_rows"]) for r in facets.company_groups(df).collect()}
    assert got == {"Acme": (2, 85, 1), "Beta": (1, 95, 0), "Quadric": (2, 1, 0), "Unknown": (1, 2, 0)}


def test_facets_and_table(spark):
    body = '{"facets":[{"facetParameter":"jobFamilyGroup","values":[{"descriptor":"Intern Group","id":"x"},{"descriptor":"Sales","id":"y"}]},{"facetParameter":"workerSubType","values":[{"descriptor":"Intern","id":"int1"},{"descriptor":"Intern (Fixed Term)","id":"int2"}]},{"facetParameter":"other","values":[{"descriptor":"Intern","id":"z"}]}]}'
    df = spark.createDataFrame([("s", "t", None, body)], "source string, target_slug string, fetched_at timestamp, body string")
    assert payloads.intern_facets(df).first()["facets"] == {"jobFamilyGroup": ["x"], "workerSubType": ["int1", "int2"]}
    cell = lambda *x: "<tr>" + "".join(f"<td>{y}</td>" for y in x) + "</tr>"
    html = "<table><tr><th>C</th></tr>" + cell("🔥 Apple", "SWE", "NYC</br>SF", '<a href="https://simplify.jobs/p/1">x</a>', "1d") + cell("↳", "SWE", "NYC", "x", "1d") + cell("Box", "SWE", "NYC", "Summer 2026", '<a href="https://a.example/1">x</a><a href="https://boards.greenhouse.io/b/jobs/1">x</a>', "1d") + "</table>"
    rows = payloads.table_rows(df.withColumn("body", F.lit(html))).orderBy("company").collect()
    assert [(r["company"], r["location"], r["link"], r["season"]) for r in rows] == [("Apple", "NYC", "https://simplify.jobs/p/1", None), ("Box", "NYC", "https://boards.greenhouse.io/b/jobs/1", "Summer 2026")]


def test_cards(spark):
    df = spark.createDataFrame([("Goalbound Software Engineering Internship $25/hr · Internship · x", "Goalbound", "Promoted∙Melrose, MA∙3wk ago"), ("Rubbl Software Engineering Intern Internship Remote 2wk ago", "Rubbl", "5d ago")], "label string, company string, footer string")
    assert [(r["role"], r["pay"], r["card_location"]) for r in payloads.cards(df).collect()] == [("Software Engineering Internship", "$25/hr", "Melrose, MA"), ("Software Engineering Intern", None, "")]


def test_versions_are_replay_safe(spark, tmp_path):
    table = state.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    assert table.commit(spark.range(3), 0) and not table.commit(spark.range(9), 0) and table.read().count() == 3
    assert table.commit(spark.range(5), 1) and table.read().count() == 5


def test_counts_conserve(spark):
    from conftest import SMALL
    from siftwell.bindings import enriched

    rows = enriched(spark, SMALL)
    st, inc = rows.where("stored"), rows.where("not stored")
    outcomes, after = ingest.ingest(st, inc, AS_OF)
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert sum(counts.values()) == inc.count()
    assert after.count() == st.count() + counts["keep"]


def test_change_errors_and_streaks(spark):
    df = spark.createDataFrame([("applied", "maybe"), ("applied_at", "2026-01-01T00:00:00Z"), ("application_url", "ftp://x"), ("colour", "x"), ("application_status", "x" * 201)], "field string, value string")
    assert [r[0] for r in df.select(rules.change_error()).collect()] == ["not_boolean", None, "not_a_url", "unknown_field", "too_long"]
    runs = spark.createDataFrame([("r", n, s) for n, s in enumerate([-1, 200, -1, -1, -1, 200])], "run string, seq int, status int")
    assert [(r["streak"], r["unchecked"]) for r in facets.error_streaks(runs, 3).orderBy("seq").collect()] == [(1, False), (0, False), (1, False), (2, False), (3, False), (0, True)]


def test_stream_of_new_rows(spark, tmp_path):
    from siftwell.streaming import jobs

    spark.createDataFrame([("a", AS_OF), ("a", AS_OF), ("b", AS_OF)], "id string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = jobs.new_rows(jobs.file_stream(spark, str(tmp_path / "in"), "id string, at timestamp"), "at")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
