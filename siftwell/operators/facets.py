"""Aggregations for lists, facets, groups, health and change reports."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.extract import season_sort_key, season_tokens
from siftwell.functions.text import trimmed_description
from siftwell.operators import shared
from siftwell.operators.rules import ROLES, in_role

LIST_FIELDS = ["id", "title", "company", "location", "link", "source", "posted_at", "seen_at", "score", "score_label", "matched_keywords", "applied", "hidden", "archived", "is_new"]


def list_fields(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in LIST_FIELDS if c in df.columns])


def stats(df: DataFrame) -> DataFrame:
    """kind (total, source, label), name, n and newest seen_at: one pass by grouping sets; rows never scored are `unscored`."""
    rows = df.select("source", F.coalesce("score_label", F.lit("unscored")).alias("label"), "seen_at")
    grouped = rows.groupingSets([[F.col("source")], [F.col("label")], []], "source", "label").agg(F.count(F.lit(1)).alias("n"), F.max("seen_at").alias("newest"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "source").otherwise("label")
    return grouped.select(kind.alias("kind"), F.coalesce("source", "label", F.lit("")).alias("name"), "n", "newest")


def by_reason(df: DataFrame) -> DataFrame:
    return df.where("exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def source_counts(df: DataFrame) -> DataFrame:
    """Rows and new rows of each source; without one: Unknown."""
    return df.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("is_new").alias("net_new"))


def source_health(log: DataFrame, as_of: datetime.datetime, retired: list[str] | None = None) -> DataFrame:
    """Of (source, seen_at): total, last 24 hours, last 7 days, newest, and whether the source has gone quiet."""
    now = F.lit(as_of)
    rows = log.where(~F.col("source").isin(retired)) if retired else log
    within = lambda hours: F.count_if(F.col("seen_at") >= now - F.expr(f"interval {hours} hours"))
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), within(24).alias("last_24h"), within(168).alias("last_7d"), F.max("seen_at").alias("last_seen"))
    return out.withColumn("quiet", (F.col("last_24h") == 0) & (F.col("last_7d") > 0))


def health_with_cycle(health: DataFrame, cycle: DataFrame) -> DataFrame:
    """Health full-outer the last cycle's raw and net-new counts."""
    return health.join(cycle, "source", "full_outer").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "last_24h", "last_7d", "raw", "net_new")])


def season_facet(df: DataFrame) -> DataFrame:
    """token, n in chronological order; df is filtered by everything but the season."""
    rows = df.select(F.explode(season_tokens(F.col("title"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(season_sort_key(F.col("token")))


def tab_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("all_rows"), F.count_if("applied").alias("applied_rows"), F.count_if(~F.col("applied")).alias("open_rows"))


def keyword_set(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.transform("matched_keywords", lambda k: F.lower(k))).alias("keyword")).distinct()


def role_counts(df: DataFrame) -> DataFrame:
    """role, n for each role with a posting: one pass, a row of flags to rows."""
    flags = df.select(F.explode(F.array_compact(F.array(*[F.when(in_role(F.col("matched_keywords"), r), F.lit(r)) for r in ROLES]))).alias("role"))
    return flags.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def hidden_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("hidden").alias("hidden_rows"))


def dynamic_sources(df: DataFrame) -> DataFrame:
    """The sources that have rows, with how many, in order."""
    return df.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def leave_one_out(df: DataFrame, filters: dict[str, Column], facets: dict[str, tuple[str | None, Column]]) -> DataFrame:
    """facet, value, n of several facets in one pass: each counts the rows that pass all filters but its own.

    filters: the test of each; facets: the filter of its own (None: none) and the array of values that a row counts for. A
    row keeps the filters that it fails as bits, so each is tested once.
    """
    bit = {name: 1 << k for k, name in enumerate(filters)}
    failed = reduce(lambda a, b: a + b, [F.when(F.coalesce(test, F.lit(False)), 0).otherwise(bit[name]) for name, test in filters.items()], F.lit(0))
    values = {f"_v{k}": F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: x.cast("string")) for k, (_, v) in enumerate(facets.values())}
    rows = df.select(failed.alias("_failed"), *[v.alias(c) for c, v in values.items()])
    counted = []
    for (facet, (own, _)), c in zip(facets.items(), values):
        passes = F.col("_failed").bitwiseAND(F.lit(~bit[own] if own else -1)) == 0
        counted.append(F.when(passes, F.transform(c, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))).otherwise(F.array()))  # noqa: B023
    return rows.select(F.explode(F.concat(*counted)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def company_groups(df: DataFrame) -> DataFrame:
    """One row per company whatever its casing: shown name, postings, rounded mean score, applied, newest.

    The shown name is the most frequent casing, then that with fewer capitals, then the first.
    """
    name = F.when(F.trim(F.coalesce("company", F.lit(""))) == "", "Unknown").otherwise(F.trim("company"))
    rows = df.withColumn("_name", name).withColumn("group_key", F.lower("_name"))
    cased = rows.groupBy("group_key", "_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("score", F.lit(0))).alias("points"), F.count_if("applied").alias("applied_rows"), F.max("posted_at").alias("newest"))
    capitals = F.length(F.regexp_replace("_name", "[^A-Z]", ""))
    shown = F.min_by("_name", F.struct(-F.col("n"), capitals, "_name"))
    out = cased.groupBy("group_key").agg(shown.alias("company"), F.sum("n").alias("postings"), F.round(F.sum("points") / F.sum("n")).cast("int").alias("mean_score"), F.sum("applied_rows").alias("applied_rows"), F.max("newest").alias("newest"))
    return out


def score_histogram(df: DataFrame) -> DataFrame:
    """band, n over six bands of the score (null as 0)."""
    s = F.coalesce("score", F.lit(0))
    band = F.when(s == 0, "0").when(s < 25, "1-24").when(s < 45, "25-44").when(s < 60, "45-59").when(s < 75, "60-74").otherwise("75+")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def score_summary(df: DataFrame) -> DataFrame:
    """label (null: all), n, mean and greatest score (null as 0)."""
    rows = df.select("score_label", F.coalesce("score", F.lit(0)).alias("score"))
    out = rows.rollup("score_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.max("score").alias("most"), F.grouping("score_label").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("score_label", F.lit("unscored"))).alias("label"), "n", "mean", "most")


def trim_report(df: DataFrame, text: str = "text") -> DataFrame:
    """stage (before, after trimming), bucket, n, chars: what trimming does to the lengths of descriptions that aren't empty."""
    t = F.coalesce(text, F.lit(""))
    stages = F.array(F.struct(F.lit("before").alias("stage"), t.alias("t")), F.struct(F.lit("after").alias("stage"), trimmed_description(t).alias("t")))
    rows = df.where(t != "").select(F.explode(stages).alias("s")).select("s.stage", F.col("s.t").alias("text"))
    return length_histogram(rows, by=["stage"])


def most_trimmed(df: DataFrame, most: int = 5, text: str = "text", key: str = "id") -> DataFrame:
    """The rows that lose most by trimming: key, before, after (lengths)."""
    t = F.coalesce(text, F.lit(""))
    rows = df.select(key, F.length(t).alias("before"), F.length(trimmed_description(t)).alias("after"))
    return rows.orderBy(F.desc(F.col("before") - F.col("after")), key).limit(most)


def check_counts(due: DataFrame, checks: DataFrame) -> DataFrame:
    """eligible, checked, closed, open and failed of the rows that were due: one row. checks: id, verdict (null: open)."""
    last = due.select("id").join(checks.select("id", F.coalesce("verdict", F.lit("ok")).alias("verdict")), "id", "left")
    closed, failed = F.col("verdict").isin("permanent", "aggregator"), F.col("verdict").isin("error", "transient")
    seen = F.col("verdict").isNotNull()
    return last.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(seen).alias("checked"), F.count_if(closed).alias("closed"), F.count_if(seen & ~closed & ~failed).alias("open"), F.count_if(failed).alias("failed"))


def length_histogram(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """bucket, n: the first bound that is not below the text's length."""
    n = F.length(F.coalesce(text, F.lit("")))
    bounds = [250, 500, 1000, 2000, 4000]
    bucket = F.coalesce(*[F.when(n <= b, F.lit(str(b))) for b in bounds], F.lit("over 4000"))
    return df.groupBy(*(by or []), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(n.cast("long")).alias("chars"))


def latest_by_key(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key; of equal times that with the greatest other columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(at, *[c for c in df.columns if c not in (key, at)])).alias("_row")).select("_row.*")


def digest_line(df: DataFrame, shown: int = 5) -> DataFrame:
    """One line for an alert: how many, the first few, how many more. df: title, company, place (what orders them)."""
    first = df.select("place", F.concat_ws(" @ ", "title", "company").alias("item")).orderBy("place").limit(shown)
    top = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda r: r["item"]), "; ").alias("items"))
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" +"), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    # one row each
    return counted.join(F.broadcast(top), F.lit(True)).select(F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " new posting: ").otherwise(" new postings: "), "items", more).alias("line"))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """By source: rows, rows with the column, share, and whether more than half lack it."""
    filled = F.count_if(F.coalesce(column, F.lit("")) != "")
    out = df.groupBy("source").agg(F.count(F.lit(1)).alias("total"), filled.alias("filled"))
    return out.withColumns({"share": F.round(F.col("filled") / F.col("total"), 4), "drift": F.col("filled") * 2 < F.col("total")})


def expired_by_season(df: DataFrame, tokens: str = "season") -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token")


def strategy_yield(found: DataFrame, known: DataFrame) -> DataFrame:
    """Of (strategy, ats, slug): raw, unique and new finds of each strategy."""
    fresh = found.join(known.select("ats", "slug").distinct().withColumn("_known", F.lit(True)), ["ats", "slug"], "left")
    pair = F.struct("ats", "slug")
    return fresh.groupBy("strategy").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct(pair).alias("unique_found"), F.count_distinct(F.when(F.col("_known").isNull(), pair)).alias("new_found"))


def yield_per_call(found: DataFrame, known: DataFrame, calls: DataFrame) -> DataFrame:
    """strategy_yield with calls and new finds per call. calls: strategy, calls."""
    per_call = F.round(F.col("new_found") / F.greatest("calls", F.lit(1)), 2)
    return strategy_yield(found, known).join(calls, "strategy").withColumn("per_call", per_call)


def union_of_new(found: DataFrame, known: DataFrame) -> DataFrame:
    """ats, slug, strategies: the new finds of all strategies together, with how many have each."""
    fresh = found.join(known.select("ats", "slug").distinct(), ["ats", "slug"], "left_anti")
    return fresh.groupBy("ats", "slug").agg(F.count_distinct("strategy").alias("strategies"))


def year_buckets(df: DataFrame, at: str) -> DataFrame:
    year = F.year(at)
    return df.groupBy(F.when(year < 2015, "<2015").otherwise(year.cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def change_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """old, new, n of a recomputed column, by id."""
    both = before.select("id", F.col(column).alias("old")).join(after.select("id", F.col(column).alias("new")), "id")
    return both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def paged(df: DataFrame, order: list, size: int, page: int) -> DataFrame:
    """One page of the ordered rows, the page clamped to the last; only the rows up to its end are gathered."""
    total = df.count()
    last = max(1, -(-total // size))
    return df.orderBy(*order).offset((min(max(page, 1), last) - 1) * size).limit(size)


def page_numbers(df: DataFrame, group: str, order: list, size: int, parts: int | None = None) -> DataFrame:
    """Rows of each group with their place and page, whatever the size of a group.

    The rows are dealt by range of group and order, so that a large group lies in several parts; each part is numbered on its
    own, and the rows of the same group in the parts before it are added. `order` must tell all rows of a group apart.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.stored(df.repartitionByRange(parts, F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    same = [rows[group].eqNullSafe(offsets[group]), rows["_part"] == offsets["_part"]]
    placed = rows.join(offsets, same).select(*[rows[c] for c in df.columns], (F.col("_place") + F.col("_before")).alias("place"))
    return placed.withColumn("page", F.ceil(F.col("place") / size).cast("int"))


def sample_by(df: DataFrame, label: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each label, the same ones for the same seed."""
    more = [c for c in ("seq",) if c in df.columns]
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(seed)))), "id", *more)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def error_streaks(df: DataFrame, bail: int = 15) -> DataFrame:
    """Of (run, seq, status): the streak of transport errors at each row, and whether the run had bailed before it."""
    run = Window.partitionBy("run").orderBy("seq")
    rows = df.withColumn("error", F.col("status") == -1)
    rows = rows.withColumn("island", F.sum((~F.col("error")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("error").cast("int")).over(Window.partitionBy("run", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("streak", F.coalesce(streak, F.lit(0)))
    bailed = F.min(F.when(F.col("streak") >= bail, F.col("seq"))).over(Window.partitionBy("run"))
    return rows.withColumn("unchecked", F.coalesce(F.col("seq") > bailed, F.lit(False))).drop("error", "island")


def snapshot_changes(rows: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Of presence rows (target, ts, job_id): ids kept, gone and new against the target's snapshot before.

    Each id's snapshots are joined to intervals of presence: it is new where one begins, kept inside, and gone at the
    snapshot after its end. No row holds more than one id. snapshots: target, ts, where some have no id at all.
    """
    taken = (snapshots if snapshots is not None else rows).select("target", "ts").distinct()
    numbered = taken.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("ts")))
    seen = rows.select("target", "ts", "job_id").distinct().join(numbered, ["target", "ts"])
    by_id = Window.partitionBy("target", "job_id").orderBy("n")
    kept, ends = F.lag("n").over(by_id) == F.col("n") - 1, F.coalesce(F.lead("n").over(by_id) != F.col("n") + 1, F.lit(True))
    marks = seen.select("target", "n", F.coalesce(kept, F.lit(False)).alias("kept"), ends.alias("ends"))
    here = marks.groupBy("target", "n").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("added"), F.count_if("ends").alias("ended"))
    gone = here.select("target", (F.col("n") + 1).alias("n"), F.col("ended").alias("gone"))
    all_ = numbered.join(here.drop("ended"), ["target", "n"], "left").join(gone, ["target", "n"], "left")
    return all_.select("target", "ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "gone", "added")])


def activity_windows(df: DataFrame) -> DataFrame:
    """Of (source, seen_at): rows in each 7-day window, sliding by a day."""
    return df.groupBy("source", F.window("seen_at", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
