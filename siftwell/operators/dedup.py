"""De-duplication of incoming postings against a store and within a batch, and the back-fill of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import canonical_company, normalized_key, strip_tracking
from siftwell.operators.settle import settle


def with_keys(df: DataFrame) -> DataFrame:
    """df with canonical company, stripped link and normalized_key."""
    rows = df.withColumn("company", canonical_company(F.col("company")))
    return rows.withColumns({"stripped": strip_tracking(F.col("link")), "normalized_key": normalized_key(F.col("company"), F.col("title"))})


def known_ids(incoming: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id the store has, archived or not; the rest)."""
    ids = store.select("id").distinct()
    return incoming.join(ids, "id", "left_semi"), incoming.join(ids, "id", "left_anti")


def unseen_links(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose stripped link no active row has; empty links are exempt. Both sides carry `stripped`."""
    links = store.where(~F.col("archived") & (F.col("stripped") != "")).select("stripped").distinct()
    return incoming.join(links, "stripped", "left_anti")


def key_owners(store: DataFrame) -> DataFrame:
    """normalized_key and owner_id: the active row with the smallest id for each key."""
    return store.where(~F.col("archived")).groupBy("normalized_key").agg(F.min("id").alias("owner_id"))


def known_keys(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose key an active row owns, with owner_id."""
    return incoming.join(key_owners(store), "normalized_key")


def batch_outcome(rows: DataFrame) -> DataFrame:
    """For new rows (seq, stripped, normalized_key): outcome keep, same_link or same_key, in arrival order (see settle)."""
    return settle(rows.select("seq", "stripped", "normalized_key")).select("seq", "outcome")


REPLACED = ("seen_at", "score", "score_label", "matched_keywords")
FILLED = ("salary_text", "salary_min", "salary_max", "salary_unit", "ats_source", "ats_job_id", "ats_target", "multi_location", "normalized_key")


def backfill(store: DataFrame, incoming: DataFrame, replaced=REPLACED, filled=FILLED) -> DataFrame:
    """store with each row (by id) refreshed by the incoming rows of the same id, in arrival order (seq).

    Replaced columns take the last value; filled ones the first that isn't null, only where the
    store has none; a description only where the stored one is empty. A row that comes back is
    active again unless checks of its link failed. Link, source and user state stay.
    """
    replaced = [c for c in replaced if c in incoming.columns and c in store.columns]
    filled = [c for c in filled if c in incoming.columns and c in store.columns and c not in replaced]
    text = [c for c in ("description",) if c in incoming.columns and c in store.columns]
    new = incoming.groupBy("id").agg(
        F.lit(True).alias("_again"),
        *[F.max_by(c, "seq").alias(f"_{c}") for c in replaced],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in filled],
        *[F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))).alias(f"_{c}") for c in text],
    )
    joined = store.join(new, "id", "left")
    again = F.coalesce("_again", F.lit(False))
    values = {c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)) for c in replaced}
    values |= {c: F.coalesce(c, f"_{c}") for c in filled} | {c: F.when(F.coalesce(c, F.lit("")) == "", F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in text}
    values["archived"] = F.when(again & (F.col("failed_check_count") == 0), False).otherwise(F.col("archived"))
    return joined.withColumns(values).select(*store.columns)


def first_seen(df: DataFrame, key: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in arrival order."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*df.columns)
    return df.groupBy(*key).agg(pick(row, "seq").alias("_row")).select("_row.*")


def survivors(df: DataFrame, key: Column | str = "normalized_key") -> DataFrame:
    """df with rank in its duplicate group: user state first, then score, then newest, then id."""
    state = F.col("applied") | F.col("hidden")
    order = Window.partitionBy(key).orderBy(state.desc(), F.coalesce("score", F.lit(0)).desc(), F.col("seen_at").desc(), "id")
    return df.withColumn("rank", F.row_number().over(order))


def merged_state(df: DataFrame, key: str = "normalized_key") -> DataFrame:
    """User state of each duplicate group: applied if any is, hidden if any is and none is applied.

    With columns application_url and application_status, those of the first row by id that is applied and has a url, else of the first that has one.
    """
    more = []
    if "application_url" in df.columns:
        first = F.min_by(F.struct("application_url", "application_status"), F.when(F.coalesce("application_url", F.lit("")) != "", F.struct(~F.col("applied"), "id")))
        more = [first["application_url"].alias("application_url"), first["application_status"].alias("application_status")]
    return df.groupBy(key).agg(*more, F.bool_or("applied").alias("applied"), (F.bool_or("hidden") & ~F.bool_or("applied")).alias("hidden"), F.min(F.when(F.col("applied"), F.col("seen_at"))).alias("applied_at"), F.count(F.lit(1)).alias("rows"))


def collapse_plan(df: DataFrame, allow_empty_title: bool = False) -> DataFrame:
    """id, normalized_key, action (keep or delete) for groups with more than one row."""
    rows = df if allow_empty_title else df.where(~F.col("normalized_key").endswith("::"))
    sizes = rows.groupBy("normalized_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("normalized_key")
    ranked = survivors(rows.join(sizes, "normalized_key", "left_semi"))
    return ranked.select("id", "normalized_key", F.when(F.col("rank") == 1, "keep").otherwise("delete").alias("action"))
