"""The write path: batches settled in order, link upgrades, the parted table and its streams, the outbox."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from test_golden import AS_OF

from siftwell.operators import rules, settle, shared, state
from siftwell.plans import ingest
from siftwell.streaming import jobs
from siftwell.streaming.store import PartedTable

ROW = "seq long, stripped string, normalized_key string, owner_link string"


def in_order(rows):
    """{seq: (outcome, by, upgrade)} by a plain loop."""
    links, out = {}, {}
    owners = {key: (None, "simplify.jobs" in own) for _, _, key, own in rows if key and own is not None}
    for seq, link, key, _ in sorted(rows, key=lambda r: r[0]):
        held = owners.get(key) if key else None
        if link and link in links:
            out[seq] = ("same_link", links[link], False)
        elif held:
            upgrade = held[1] and bool(link) and "simplify.jobs" not in link
            out[seq] = ("known_key" if held[0] is None else "same_key", held[0], upgrade)
            if upgrade:
                owners[key], links[link] = (held[0], False), seq
        else:
            out[seq] = ("keep", None, False)
            if key:
                owners[key] = (seq, "simplify.jobs" in (link or ""))
            if link:
                links[link] = seq
    return out


def settled(spark, rows, **how):
    got = settle.settle(spark.createDataFrame(rows, ROW), **how)
    return {r["seq"]: (r["outcome"], r["by"], r["upgrade"]) for r in got.collect()}


@pytest.mark.parametrize("how", [{}, {"rounds": 1}, {"rounds": 1, "component_rows": 4}])
def test_settle(spark, how):
    rnd = random.Random(5)
    own = {k: rnd.choice(["simplify.jobs/x", "https://a", None]) for k in "uvwxyzabc"}
    links = ["", None] + [f"{front}{n}" for n in range(30) for front in ("l", "simplify.jobs/")]
    keys = [*own, *(f"k{n}" for n in range(30)), "", None]
    rows = [(n, rnd.choice(links), (key := rnd.choice(keys)), own.get(key)) for n in range(200)]
    want = in_order(rows)
    assert {o for o, _, _ in want.values()} == {"keep", "same_link", "same_key", "known_key"} and any(u for *_, u in want.values())
    assert settled(spark, rows, **how) == want


def test_an_upgrade_blocks_a_later_row(spark):
    rows = [(1, "simplify.jobs/1", "K", None), (2, "L2", "K", None), (3, "L2", "K3", None), (4, "L4", "K", None), (5, "L4", "K5", None)]
    assert settled(spark, rows) == in_order(rows)
    assert settled(spark, rows)[3][0] == "same_link" and settled(spark, rows)[5][0] == "keep"


def test_long_chains_and_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(settle, "stored", lambda df, f=settle.stored: (written.append(1), f(df))[1])
    rows = [(n, f"L{(n + 1) // 2}", f"K{n // 2}", None) for n in range(10_000)]
    assert settled(spark, rows) == in_order(rows) and len(written) < 60
    written.clear()
    star = [(n, "one link" if n % 2 else f"L{n}", "one key" if n % 3 else f"K{n}", None) for n in range(3000)]
    assert settled(spark, star) == in_order(star) and len(written) < 20


def posting(n, company, title, link, **more):
    return {"seq": n, "company": company, "title": title, "link": link, "location": "New York, NY", "source": "Lever", "seen_at": AS_OF, "description": None, "archived": False, "failed_check_count": 0, "applied": False, "hidden": False} | more


SCHEMA = "seq long, company string, title string, link string, location string, source string, seen_at timestamp, description string, archived boolean, failed_check_count int, applied boolean, hidden boolean"


def frame(spark, rows):
    from siftwell.functions.text import posting_id

    raw = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    return ingest.enriched(raw.withColumn("id", posting_id(F.col("company"), F.col("title"), F.col("link"))), AS_OF)


def title(word):
    return f"{word} Software Engineer Intern"


STORED = [posting(1, "Acme", title("Alpha"), "https://simplify.jobs/p/1"), posting(2, "Beta", title("Beta"), "https://b.example/2"), posting(3, "Old", title("Old"), "https://o.example/3", archived=True)]
BATCH = [
    posting(10, "Acme", title("Alpha"), "https://a.example/10", description="told"),  # absorbed, upgrades
    posting(11, "Gamma", title("Gamma"), "https://a.example/10"),  # its link is blocked by the upgrade
    posting(12, "Delta", title("Delta"), "https://simplify.jobs/p/12"),  # kept
    posting(13, "Delta", title("Delta"), "https://d.example/13?utm_source=x", description="more"),  # absorbed by it, upgrades
    posting(14, "Delta", title("Delta"), "https://simplify.jobs/p/12"),  # the kept row again
    posting(15, "Beta", title("Other"), "https://b.example/2?ref=x"),  # a stored link
    posting(16, "Old", title("Old"), "https://o.example/3"),  # an archived row comes back
    posting(17, "Zed", "Marketing Intern", "https://z.example/17"),
]


def test_ingest_in_order(spark):
    store, batch = frame(spark, STORED), frame(spark, BATCH)
    outcomes, after = ingest.ingest(store, batch, AS_OF)
    assert {r["seq"]: r["outcome"] for r in outcomes.collect()} == {10: "known_key", 11: "same_link", 12: "keep", 13: "same_key", 14: "refresh", 15: "known_link", 16: "refresh", 17: "non_swe"}
    rows = {r["company"]: r for r in after.collect()}
    assert len(rows) == 4 and after.count() == 4
    assert rows["Acme"]["link"] == "https://a.example/10" and rows["Acme"]["description"] == "told" and rows["Acme"]["source"] == "Lever"
    assert rows["Delta"]["link"] == "https://d.example/13" and rows["Delta"]["description"] == "more" and rows["Delta"]["seq"] == 12
    assert not rows["Old"]["archived"]


def test_two_streams_of_the_write_path(spark, tmp_path):
    """A fast and a slow stream into one table; replays change nothing; what is written grows with the batch."""
    store = PartedTable(spark, str(tmp_path / "store"), parts=8)
    store.commit("seed", 0, lambda now: frame(spark, STORED))
    enrich = lambda rows: frame(spark, [r.asDict() for r in rows.drop("id").collect()])
    for name, some in (("fast", BATCH[:4]), ("slow", BATCH[4:])):
        spark.createDataFrame([tuple(r.values()) for r in some], SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    for checkpoint, name in (("f", "fast"), ("s", "slow"), ("again", "fast")):
        stream = jobs.file_stream(spark, str(tmp_path / name), SCHEMA)
        jobs.into_parts(stream, store, name, str(tmp_path / checkpoint), jobs.ingested(AS_OF, enrich)).awaitTermination()
    assert store.version() == 3
    want = ingest.ingest(frame(spark, STORED), frame(spark, BATCH), AS_OF)[1]
    key = ["id", "link", "description", "archived", "score"]
    assert sorted(map(str, store.read().select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_parts_that_a_batch_touches(spark, tmp_path):
    store = PartedTable(spark, str(tmp_path / "t"), parts=16)
    assert store.read() is None and store.version() == 0
    assert store.commit("a", 0, lambda now: spark.range(1000).selectExpr("id", "id as seq"))
    folders = lambda: {n: len([p for p, _, _ in store.files.names(f"data/{n}") if p.startswith("part=")]) for n, _, _ in store.files.names("data")}
    before = folders()
    assert list(before.values()) == [16]
    assert store.commit("b", 0, lambda now: spark.range(3, 4).selectExpr("id", "id + 5000 as seq"))
    assert sorted(folders().values()) == [1, 16]  # one part of sixteen is written anew
    assert not store.commit("b", 0, None) and store.commit("b", 1, lambda now: now.limit(0))
    assert store.read().count() == 1000 and store.read().where("seq > 4000").count() == 1
    assert store.vacuum(keep=1, least_age=0) == 1 and store.read().count() == 1000 and store.version() == 3


def test_writers_at_once(spark, tmp_path):
    """Four writers of the same rows: every commit counts, in one order or another."""
    store = PartedTable(spark, str(tmp_path / "t"), parts=4)
    store.commit("seed", 0, lambda now: spark.range(10).selectExpr("id", "0L as n"))
    errors = []

    def write(name):
        try:
            for batch in range(3):
                PartedTable(spark, store.path).commit(name, batch, lambda now: now.selectExpr("id", "n + 1 as n"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(f"w{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.version() == 13 and {r["n"] for r in store.read().collect()} == {12}


def test_health_as_a_stream(spark, tmp_path):
    """Down, recovered, too old, and an alert that wasn't delivered and so is given again."""
    day, clock = 86_400, [100 * 86_400]
    now = clock[0]
    (tmp_path / "in").mkdir()

    def land(n, rows):
        spark.createDataFrame(rows, "source string, kind string, at long").coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))

    def run(n):
        stream = jobs.file_stream(spark, f"{tmp_path}/in/*", "source string, kind string, at long")
        changes = jobs.health_changes(stream, now=lambda at=clock[0]: at)
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}"))
        changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
        return {r["source"]: r["transition"] for r in spark.read.parquet(str(tmp_path / "out" / f"n={n}")).collect()}

    land(0, [("quiet", "fetched", now - 2 * day), ("fine", "fetched", now - 60), ("lost", "fetched", now - 9 * day), ("unsent", "fetched", now - 3 * day)])
    assert run(0) == {"quiet": "down", "unsent": "down"}
    land(1, [("quiet", "delivered", now), ("unsent", "fetched", now - 3 * day)])
    assert run(1) == {"unsent": "down"}  # not delivered: again
    clock[0] = now + day
    land(2, [("quiet", "fetched", now + day - 5), ("unsent", "fetched", now + day - 5)])
    assert run(2) == {"quiet": "recovered"}
    land(3, [("quiet", "cleared", now + day), ("unsent", "fetched", now + day)])
    assert run(3) == {}


def test_outbox(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id string, title string")
    line = spark.createDataFrame([("2 new",)], "line string")
    assert {r["id"] for r in state.outbox_append(spark, path, "r1", rows("a", "b"), line).collect()} == {"a", "b"}
    assert {r["id"] for r in state.outbox_append(spark, path, "r2", rows("b", "c"), line).collect()} == {"c"}
    assert {r["id"] for r in state.outbox_append(spark, path, "r1", rows("x"), line).collect()} == {"a", "b"}  # a replay
    assert sorted((r["run"], r["id"], r["digest"]) for r in spark.read.parquet(path).collect()) == [("r1", "a", "2 new"), ("r1", "b", "2 new"), ("r2", "c", "2 new")]


def test_reasons_are_counted_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([("SWE Intern", "London, UK"), ("SWE Intern", "New York, NY"), ("Marketing Intern", "NYC"), ("Cook", "NYC")], "title string, location string")
    counts = rules.write_passing(rows, AS_OF, str(tmp_path / "out"))
    assert counts == {"non_us": 1, "not_intern": 1, "non_swe": 1, "phd_required": 0, "closed": 0, "expired_season": 0, "passed": 1}
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["location"] == "New York, NY"


def test_shared_files(spark, tmp_path):
    files = shared.Files(spark, str(tmp_path))
    assert files.create("a/x", "one") and not files.create("a/x", "two") and files.text("a/x") == "one"
    assert [n for n, _, _ in files.names("a")] == ["x"] and files.names("b") == []
