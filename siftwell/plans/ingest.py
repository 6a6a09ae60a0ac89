"""The write path as one plan: enrich, filter, de-duplicate, refresh the store, and pick the alerts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import extract, text
from siftwell.operators import dedup, rules, scoring, settle, shared

#: Sources whose pay isn't read from the text.
UNPARSED = ["Handshake"]


def enriched(df: DataFrame, as_of: datetime.datetime, described: str | None = None) -> DataFrame:
    """Canonical company, score, salary, season, link and key; the description is trimmed last."""
    rows = scoring.scored(df.withColumn("company", text.canonical_company(F.col("company"))))
    if described:
        own = F.coalesce("salary_text", F.lit("")) != "" if "salary_text" in df.columns else F.lit(False)
        found = F.when(own | F.col("source").isin(UNPARSED), None).otherwise(extract.salary(F.concat_ws(" ", "title", described)))
        rows = rows.withColumn("salary", found).withColumn(described, text.trimmed_description(F.col(described)))
    season = extract.season_with_default(extract.season_tokens(F.col("title")), as_of)
    return rows.withColumns({"season": season, "stripped": text.strip_tracking(F.col("link")), "normalized_key": text.normalized_key(F.col("company"), F.col("title"))})


NARROW = ["id", "stripped", "normalized_key", "archived", "link"]


def fates(store: DataFrame, passed: DataFrame) -> DataFrame:
    """What becomes of the rows of a batch that passed the filter: seq, outcome, target (the id of the row that they refresh
    or that absorbs them) and new_link (the link that an absorbed row brings its owner).

    store: id, stripped, normalized_key, archived, link; passed: seq, id, stripped, normalized_key. An id that the
    store has, or an earlier kept row of the batch, is a refresh; then links are tested before keys.
    """
    refreshed, new = dedup.known_ids(passed, store)
    linked = dedup.unseen_links(new, store)
    owners = store.where(~F.col("archived")).groupBy("normalized_key").agg(F.min_by(F.struct("id", "link"), "id").alias("o"))
    owners = owners.select("normalized_key", F.col("o.id").alias("owner_id"), F.coalesce("o.link", F.lit("")).alias("owner_link"))
    met = shared.stored(linked.select("seq", "id", "stripped", "normalized_key").join(owners, "normalized_key", "left"))
    settled = settle.settle(met).join(met.select("seq", "id", "stripped", "owner_id"), "seq")
    settled = settled.join(met.select(F.col("seq").alias("by"), F.col("id").alias("by_id")), "by", "left")
    again = F.col("outcome").isin("same_link", "same_key") & (F.col("by_id") == F.col("id"))
    target = F.when(again, F.col("id")).when(F.col("outcome") == "known_key", F.col("owner_id")).when(F.col("outcome") == "same_key", F.col("by_id"))
    none = F.lit(None).cast("string")
    return (
        settled.select("seq", F.when(again, "refresh").otherwise(F.col("outcome")).alias("outcome"), target.alias("target"), F.when(F.col("upgrade"), F.col("stripped")).alias("new_link"))
        .unionByName(refreshed.select("seq", F.lit("refresh").alias("outcome"), F.col("id").alias("target"), none.alias("new_link")))
        .unionByName(new.join(linked.select("seq"), "seq", "left_anti").select("seq", F.lit("known_link").alias("outcome"), none.alias("target"), none.alias("new_link")))
    )


def changed_rows(store: DataFrame, incoming: DataFrame, fate: DataFrame) -> DataFrame:
    """The rows of the store that a batch adds or changes, whole: kept rows, and rows that were refreshed or got a new link."""
    wide = incoming.join(fate, "seq")
    kept = wide.where("outcome = 'keep'").withColumn("link", F.when(F.col("stripped") != "", F.col("stripped")).otherwise(F.col("link")))
    touched = wide.where("target is not null").withColumn("id", F.col("target"))
    hit = touched.select("id").distinct()
    rows = store.join(hit, "id", "left_semi").unionByName(kept.select(*store.columns))
    links = fate.where("new_link is not null").select(F.col("target").alias("id"), "new_link")
    done = dedup.backfill(rows, touched.select(*incoming.columns)).join(links, "id", "left")
    return done.withColumns({c: F.coalesce("new_link", c) for c in ("link", "stripped")}).select(*store.columns)


def changes(store: DataFrame, incoming: DataFrame, as_of: datetime.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes: seq, outcome; the rows that the batch adds to the store or changes there; their ids). Both sides are enriched."""
    # what decides is narrow and worked out once; whole rows are only joined at the end
    known = shared.stored(store.select(*NARROW))
    passed = shared.stored(rules.hard_filtered(incoming, as_of).select("seq", "id", "stripped", "normalized_key", "passed", "exclusion_reason"))
    fate = shared.stored(fates(known, passed.where("passed").drop("passed", "exclusion_reason")))
    outcomes = passed.where("not passed").select("seq", F.col("exclusion_reason").alias("outcome")).unionByName(fate.select("seq", "outcome"))
    return outcomes, changed_rows(store, incoming, fate), fate.select(F.col("target").alias("id")).where("id is not null").distinct()


def ingest(store: DataFrame, incoming: DataFrame, as_of: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """(outcomes: seq, outcome; store after the batch). Both sides are enriched."""
    outcomes, changed, ids = changes(store, incoming, as_of)
    return outcomes, store.join(ids, "id", "left_anti").unionByName(changed)


def alerts(df: DataFrame, spec: rules.FilterSpec, most: int = 10) -> DataFrame:
    """The best new postings by score."""
    return df.where(rules.alert_filter(spec)).orderBy(F.desc(F.coalesce("score", F.lit(0))), "id").limit(most)


def top_new(df: DataFrame, as_of: datetime.datetime, most: int = 10) -> DataFrame:
    """Ten new in-scope postings by score, one of each key."""
    # the rules read title and location only, so what they reject is never scored
    rows = enriched(rules.hard_filtered(df, as_of).where("passed"), as_of)
    once = dedup.first_seen(rows.select("seq", "id", "title", "company", "location", "score", "score_label", "normalized_key"), ["normalized_key"])
    return once.orderBy(F.desc("score"), "id").limit(most).select("id", "title", "company", "location", "score", "score_label")
