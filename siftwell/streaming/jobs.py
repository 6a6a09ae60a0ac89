"""Structured Streaming jobs over file sources: ingest into a versioned store, change feeds, new rows, sliding activity."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.state import VersionedTable, patched, upsert
from siftwell.plans import ingest
from siftwell.streaming.store import PartedTable


def file_stream(spark: SparkSession, folder: str, schema, name: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name or "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def into_store(stream: DataFrame, store: VersionedTable, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is merged into the store's current version and committed under its batch id, so that a replay changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not store.committed(batch_id):
            store.commit(merge(store.read(), batch), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_merge(now: DataFrame | None, batch: DataFrame) -> DataFrame:
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("_row")).select("_row.*")
    return newest if now is None else upsert(now, newest)


def patch_merge(base: DataFrame) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """For a feed of changes (id, field, value, ts) over a base table."""
    return lambda now, batch: patched(base if now is None else now, batch)


def new_rows(stream: DataFrame, at: str, delay: str = "7 days") -> DataFrame:
    """Rows whose id hasn't come within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["id"])


def sliding_activity(stream: DataFrame, at: str = "ts", by: str = "event_type", delay: str = "1 day") -> DataFrame:
    """Rows in 7-day windows sliding by a day, late ones up to `delay`."""
    windowed = stream.withWatermark(at, delay).groupBy(F.window(at, "7 days", "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col(by).alias("source"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def into_parts(stream: DataFrame, store: PartedTable, writer: str, checkpoint: str, change: Callable[[DataFrame | None, DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of a writer is committed once to a table that other writers change too.

    change(table, batch) gives the rows to put in. A writer keeps its name and its checkpoint together: its batch numbers count on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.commit(writer, batch_id, lambda now: change(now, batch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_of(now: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The newest row of each id by seq, where the table has none as new: the same in whatever order batches come."""
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("_row")).select("_row.*")
    if now is None:
        return newest
    return newest.join(now.select("id", F.col("seq").alias("_seq")), "id", "left").where("_seq is null or seq > _seq").select(*batch.columns)


def ingested(as_of: datetime.datetime, enrich: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """The whole write path for one micro-batch of raw postings: enriched, filtered, settled against the table and in the batch."""

    def change(now: DataFrame, batch: DataFrame) -> DataFrame:
        incoming = (enrich or (lambda rows: ingest.enriched(rows, as_of)))(batch)
        return ingest.changes(now, incoming, as_of)[1]

    return change


def health_changes(stream: DataFrame, now: Callable[[], int] | None = None) -> DataFrame:
    """source, transition (down, recovered) and last (success), from a stream of source, kind and at (seconds).

    kind `fetched` is a successful fetch, `delivered` tells that the down alert of a source went out, `cleared` that its
    recovery did. Only these two change whether a source counts as alerted: what wasn't delivered is given again with
    each batch that has the source, and by its timer. A source quiet for a day, for a week at most, is down; one alerted and
    fetched within the day has recovered. Timers run on processing time, a day after the last fetch and an hour after
    an alert that isn't delivered. now: the clock in seconds; without it, processing time.
    """
    day, hour = 86_400, 3_600

    def run(key, batches, state: GroupState):
        last, alerted, told = state.getOption or (-1, False, -1)
        for rows in batches:
            fetched = rows["at"][rows["kind"] == "fetched"]
            last = max([last, *fetched.tolist()])
            # of both answers the later one holds
            for at, kind in sorted(zip(rows["at"].tolist(), rows["kind"].tolist())):
                if kind != "fetched" and at >= told:
                    told, alerted = at, kind == "delivered"
        clock = now() if now else state.getCurrentProcessingTimeMs() // 1000
        age = clock - last
        change = None
        if last >= 0:
            change = "down" if day < age <= 7 * day and not alerted else "recovered" if age <= day and alerted else None
        state.update((int(last), bool(alerted), int(told)))
        if 0 <= last and age <= 7 * day:
            state.setTimeoutDuration(int(hour if change or alerted else max(1, day - age + 1)) * 1000)
        if change:
            yield pd.DataFrame({"source": [key[0]], "transition": [change], "last": [int(last)]})

    source = stream.schema["source"].dataType.simpleString()
    return stream.groupBy("source").applyInPandasWithState(run, f"source {source}, transition string, last long", "last long, alerted boolean, told long", "update", GroupStateTimeout.ProcessingTimeTimeout)
