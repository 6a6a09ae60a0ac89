"""Upkeep of the stored table: versions, upserts, patches, archival, link health, clean-up plans."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import extract, text
from siftwell.operators.rules import aggregator_link, link_verdict, placeholder_reason
from siftwell.operators.shared import Files


class VersionedTable:
    """A Parquet table whose versions are whole folders; a one-row log of batch and folder, appended last, makes a version current.

    A batch that is committed again is skipped, so that a replayed micro-batch changes nothing. Single writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch long, folder string, committed timestamp").parquet(f"{self.path}/_versions")
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def committed(self, batch: int) -> bool:
        log = self._log()
        return log is not None and not log.where(F.col("batch") == batch).isEmpty()

    def read(self) -> DataFrame | None:
        log = self._log()
        newest = log and log.orderBy(F.desc("committed"), F.desc("batch")).first()
        return self.spark.read.parquet(newest["folder"]) if newest else None

    def commit(self, df: DataFrame, batch: int) -> bool:
        if self.committed(batch):
            return False
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        log = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"), F.current_timestamp().alias("committed"))
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/_versions")
        return True


def upsert(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows by key: the new one where there is one."""
    fresh = new.select(key, F.struct(*store.columns).alias("_new"))
    both = store.select(key, F.struct(*store.columns).alias("_old")).join(fresh, key, "full_outer")
    return both.select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def merged_defaults(state: DataFrame, defaults: DataFrame, key: str = "key") -> DataFrame:
    """Keyed state over its defaults: values of the state, where it has them."""
    joined = defaults.alias("d").join(state.alias("s"), key, "full_outer")
    return joined.select(key, F.coalesce("s.value", "d.value").alias("value"))


def newest_first(df: DataFrame, at: str) -> Column:
    """What the newest row is told by: its time, then event_id where there is one, then the other columns, so that equal times give one answer."""
    more = [c for c in ("event_id", "status", "value") if c in df.columns]
    return F.struct(at, *more)


def patched(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Store with the latest valid change (id, field, value, ts) of each field applied."""
    fields = ["applied", "hidden", "archived"]
    latest = changes.where(F.col("field").isin(fields)).groupBy("id", "field").agg(F.max_by("value", newest_first(changes, "ts")).alias("value"))
    wide = latest.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("value") == "true")).alias(f"_{f}") for f in fields])
    joined = store.join(wide, "id", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields if f in store.columns}).select(*store.columns)


def archived_by_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    marked = store.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return marked.withColumn("archived", F.coalesce("_gone", F.lit(False)) | F.col("archived")).select(*store.columns)


def archived_by_age(store: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    return store.withColumn("archived", F.col("archived") | (F.col("seen_at") < F.lit(as_of) - F.expr(f"interval {days} days")))


def archived_by_season(store: DataFrame, as_of: datetime.datetime) -> DataFrame:
    tokens = extract.season_with_default(extract.season_tokens(F.col("title")), as_of)
    return store.withColumn("archived", F.col("archived") | extract.expired(tokens, as_of))


def disappeared(store: DataFrame, scan: DataFrame) -> DataFrame:
    """Active rows of a scanned (source, target) whose job id the scan doesn't have. scan: source, target, job_id."""
    targets = scan.select("source", "target").distinct()
    live = store.where(~F.col("archived")).join(targets, ["source", "target"], "left_semi")
    return live.join(scan.select("source", "target", "job_id").distinct(), ["source", "target", "job_id"], "left_anti")


def checked_links(store: DataFrame, checks: DataFrame) -> DataFrame:
    """Store after link checks (id, status, checked_at): dead and aggregator links are archived, good ones reset."""
    new = checks.groupBy("id").agg(F.max_by("status", newest_first(checks, "checked_at")).alias("_status"), F.max("checked_at").alias("_at"))
    joined = store.join(new, "id", "left")
    verdict = F.when(F.col("_status").isNull(), None).when(aggregator_link(F.col("link")), "aggregator").otherwise(link_verdict(F.col("_status")))
    joined = joined.withColumn("_verdict", verdict)
    dead = F.col("_verdict").isin("aggregator", "permanent")
    fine = F.col("_verdict") == "ok"
    return joined.withColumns({
        "archived": F.when(dead, True).when(fine & (F.col("failed_check_count") > 0), False).otherwise(F.col("archived")),
        "failed_check_count": F.when(dead, 2).when(fine, 0).otherwise(F.col("failed_check_count")),
    }).select(*store.columns, F.col("_verdict").alias("verdict"))


def due_for_check(store: DataFrame, history: DataFrame, source: str, as_of: datetime.datetime, days: int = 7, most: int | None = None) -> DataFrame:
    """Active rows of a source never checked, or last checked before the time to live."""
    last = history.groupBy("id").agg(F.max("checked_at").alias("last_checked"))
    due = store.where(~F.col("archived") & (F.col("source") == source)).join(last, "id", "left").where(F.col("last_checked").isNull() | (F.col("last_checked") < F.lit(as_of) - F.expr(f"interval {days} days")))
    return due.orderBy(F.asc_nulls_first("last_checked"), "id").limit(most) if most else due


def live_links(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows whose link isn't known to be gone; an unchecked link passes, an empty one doesn't."""
    last = checks.groupBy("id").agg(F.max_by("status", newest_first(checks, "checked_at")).alias("_status"))
    return rows.join(last, "id", "left").where(~F.coalesce(F.col("_status").isin(404, 410), F.lit(False)) & (F.coalesce("link", F.lit("")) != "")).drop("_status")


def outbox_append(spark: SparkSession, path: str, run: str, rows: DataFrame, digest: DataFrame | None = None) -> DataFrame:
    """Puts the alert rows (id and more) of a run into an outbox, without those that another run has delivered; gives the run's rows as stored.

    A run has a folder of its own and is written once: a replay finds it and changes nothing. digest: one row (line), its text.
    """
    files = Files(spark, path)
    if not any(name == "_SUCCESS" for name, _, _ in files.names(f"run={run}")):
        others = [name for name, _, _ in files.names("") if name.startswith("run=") and name != f"run={run}"]
        new = rows
        if others:
            done = spark.read.option("basePath", path).parquet(*[f"{path}/{name}" for name in others])
            new = rows.join(done.select("id").distinct(), "id", "left_anti")
        if digest is not None:
            new = new.crossJoin(F.broadcast(digest.limit(1).select(F.col("line").alias("digest"))))  # one row
        new.write.mode("overwrite").parquet(f"{path}/run={run}")
    return spark.read.parquet(f"{path}/run={run}")


def link_plan(store: DataFrame) -> DataFrame:
    """id, before, after of links that cleaning changes."""
    return store.select("id", F.col("link").alias("before"), text.strip_tracking(F.col("link")).alias("after")).where("before <> after")


def description_plan(store: DataFrame) -> DataFrame:
    """id, action (delete, clear, update), after: what cleaning does to descriptions."""
    clean = text.trimmed_description(text.strip_markdown(F.coalesce("description", F.lit(""))))

    def planned(after):
        action = F.when(F.col("reason").isNotNull(), "delete").when(F.col("description").isNull(), None).when(F.length(after) < 50, "clear").when(after != F.col("description"), "update")
        return F.struct(action.alias("action"), after.alias("after"))

    # as a generated row the text is cleaned once, not again for the filter and for each column
    rows = store.withColumn("reason", placeholder_reason()).select("id", F.inline(F.array(text.let(clean, planned))))
    return rows.where("action is not null").select("id", "action", F.when(F.col("action") == "update", F.col("after")).alias("after"))


def repair_plan(bad: DataFrame, good: DataFrame, targets: DataFrame, store: DataFrame, checks: DataFrame) -> DataFrame:
    """id, action (update or drop), link, new_id of rows with a bad board link.

    The board is the target's by slug, or by name, or the one most used with the host in good links.
    bad: id, title, company, link, host, slug; good: host, board; targets: slug, name, board; checks: link, status.
    """
    learned = good.groupBy("host").agg(F.mode("board", True).alias("learned"))
    by_slug = targets.select("slug", F.col("board").alias("by_slug"))
    by_name = targets.select(F.lower("name").alias("_name"), F.col("board").alias("by_name")).dropDuplicates(["_name"])
    rows = bad.join(by_slug, "slug", "left").join(by_name, F.lower(bad["company"]) == F.col("_name"), "left").join(learned, "host", "left")
    rows = rows.withColumn("board", F.coalesce("by_slug", "by_name", "learned")).where("board is not null")
    rows = rows.withColumn("new_link", F.concat(F.lit("https://"), "host", F.lit("/"), "board", F.regexp_extract("link", r"(/job/.*)$", 1)))
    rows = rows.join(checks.where("status = 200").select(F.col("link").alias("new_link")), "new_link", "left_semi")
    rows = rows.withColumn("new_id", text.posting_id(F.col("company"), F.col("title"), F.col("new_link")))
    taken = store.select(F.col("id").alias("new_id")).distinct().withColumn("_taken", F.lit(True))
    return rows.join(taken, "new_id", "left").select("id", F.when(F.col("_taken").isNotNull(), "drop").otherwise("update").alias("action"), F.col("new_link").alias("link"), "new_id")


def without_rows(store: DataFrame, test: Column) -> DataFrame:
    """The rows for which a test isn't true."""
    return store.where(~F.coalesce(test, F.lit(False)))


def fixpoint(store: DataFrame, name: str, test: Column) -> DataFrame:
    """name, left, settled: whether a clean-up has left nothing to do."""
    return store.agg(F.count_if(test).alias("left")).select(F.lit(name).alias("name"), "left", (F.col("left") == 0).alias("settled"))


def backup(store: DataFrame, plan: DataFrame, path: str) -> None:
    """The rows that a plan touches, written before it is applied."""
    store.join(plan.select("id").distinct(), "id", "left_semi").write.parquet(path)


def discovered_targets(known: DataFrame, found: DataFrame, denied: DataFrame) -> DataFrame:
    """Targets (ats, slug, board) after discovery: denied slugs go from both sides, new ones come, missing boards are filled."""
    allow = lambda df: df.join(denied.select("slug").distinct(), "slug", "left_anti")
    fresh = allow(found).groupBy("slug").agg(F.min("ats").alias("_ats"), F.max("board").alias("_board"))
    joined = allow(known).join(fresh, "slug", "full_outer")
    status = F.when(F.col("ats").isNull(), "added").when(F.col("board").isNull() & F.col("_board").isNotNull(), "enriched").otherwise("kept")
    return joined.select("slug", F.coalesce("ats", "_ats").alias("ats"), F.coalesce("board", "_board").alias("board"), status.alias("status"))


def attached_targets(listings: DataFrame, targets: DataFrame) -> DataFrame:
    """Listings (link) with the ats, target_slug and job_id of the target that their board address names.

    Of several targets with the same board and slug the first in configuration order (ord) counts; a listing whose address
    names no job id is dropped, one whose board isn't a target keeps nulls. targets: ats, slug, ord.
    """
    first = targets.groupBy(F.col("ats").alias("_ats"), F.lower("slug").alias("_key")).agg(F.min_by("slug", "ord").alias("target_slug"))
    rows = listings.withColumn("_a", extract.board_address(F.col("link"))).where("_a.job_id is not null and _a.job_id <> ''")
    joined = rows.join(first, (F.col("_a.ats") == F.col("_ats")) & (F.lower("_a.slug") == F.col("_key")), "left")
    return joined.select(*listings.columns, F.col("_ats").alias("ats"), "target_slug", F.col("_a.job_id").alias("job_id"))


def new_candidates(mined: DataFrame, known: DataFrame) -> DataFrame:
    return mined.select("ats", "slug").distinct().join(known.select("ats", "slug").distinct(), ["ats", "slug"], "left_anti")


def priority_union(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several lists; of equal keys (whatever their case) the earliest list's."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_prio", F.lit(n)) for n, f in enumerate(frames)])
    columns = [c for c in all_.columns if c != "_prio"]
    picked = all_.groupBy(*[F.lower(c).alias(f"_{c}") for c in key]).agg(F.min_by(F.struct(*columns), F.struct("_prio", *columns)).alias("_row"))
    return picked.select("_row.*")


def quiet_transitions(fetches: DataFrame, alerts: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """source, transition (down or recovered) from the last fetches and the alerts that were delivered."""
    last = fetches.groupBy("source").agg(F.max("fetched_at").alias("last"))
    age = F.lit(as_of).cast("long") - F.col("last").cast("long")
    joined = last.join(alerts.select("source", "alerted_at"), "source", "left")
    change = F.when((age > 86400) & (age <= 7 * 86400) & F.col("alerted_at").isNull(), "down").when((age <= 86400) & F.col("alerted_at").isNotNull(), "recovered")
    return joined.withColumn("transition", change).where("transition is not null").select("source", "transition", "last")
