"""What becomes of each row of a batch, in arrival order, where kept rows block their links and keys.

Row r, in order of seq, is dropped if its link is blocked (`same_link`); else, if its key has an owner,
absorbed by it (`same_key`, or `known_key` if the owner is a stored row); else kept (`keep`), and then
blocks its link and owns its key. An absorbed row with a direct link, whose owner's link is still a
wrapper, upgrades the owner's link to its own and so blocks that link from there on. An empty link or key
blocks nothing.

A row can be settled once no earlier open row of its link or key can still change its state. A few
such rounds, by aggregations and joins, settle most rows: stars around a popular link or key
in one or two. What is left waits in chains. It is divided into the connected components of its
links and keys, and a component is walked through once in arrival order by one task, which holds
its links and keys. Components over `component_rows` rows go on in rounds, which need no more memory
but one round a link of the longest chain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.shared import stored

WRAPPER = "simplify.jobs"
#: Rows of a component that one task walks through.
COMPONENT_ROWS = 1_000_000
ROUNDS = 4
OPEN = "seq long, link string, key string, direct boolean, wraps boolean, owned boolean, wrapped boolean, owner long"
DONE = "seq long, outcome string, by long, upgrade boolean"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v: long): root is the least node that can be reached."""

    def towards_least(edges: DataFrame, larger: bool) -> DataFrame:
        """Each node's larger neighbours, or its smaller ones and itself, are linked to its least neighbour or itself."""
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = (edges.unionByName(turned) if larger else edges.where("u > v").unionByName(turned.where("u > v"))).distinct()
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u")
        if larger:
            moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    edges, before = stored(edges.where("u <> v").select("u", "v").distinct()), None
    while True:
        edges = stored(towards_least(towards_least(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:  # every node hangs below its root
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _outcome() -> F.Column:
    return F.when(F.col("owned"), F.when(F.col("owner").isNull(), "known_key").otherwise("same_key")).otherwise("keep").alias("outcome")


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, still open): one round over all open rows."""
    # only these can block a link, own a key or change an owner's link
    able = ~F.col("owned") | (F.col("wrapped") & F.col("direct"))
    first = lambda c: open_.where(able & F.col(c).isNotNull()).groupBy(c).agg(F.min("seq").alias(f"first_{c}"))
    ranked = open_.join(first("link"), "link", "left").join(first("key"), "key", "left")
    ready = (F.col("first_link").isNull() | (F.col("seq") <= F.col("first_link"))) & (~able | F.col("first_key").isNull() | (F.col("seq") <= F.col("first_key")))
    ranked = stored(ranked.withColumn("ready", ready).drop("first_link", "first_key"))
    upgrade = F.col("owned") & F.col("wrapped") & F.col("direct")
    done = ranked.where("ready").withColumn("upgrade", upgrade)
    settled = done.select("seq", _outcome(), F.col("owner").alias("by"), "upgrade")
    acting = done.where(~F.col("owned") | F.col("upgrade"))
    links = acting.where("link is not null").select("link", F.col("seq").alias("link_by"))
    keys = acting.where("key is not null").select("key", F.col("owned").alias("changed"), F.col("seq").alias("key_by"), (F.col("wraps") & ~F.col("owned")).alias("now_wraps"))
    left = ranked.where("not ready").drop("ready").join(links, "link", "left")
    dropped = left.where("link_by is not null").select("seq", F.lit("same_link").alias("outcome"), F.col("link_by").alias("by"), F.lit(False).alias("upgrade"))
    left = left.where("link_by is null").join(keys, "key", "left")
    met = F.col("key_by").isNotNull()
    left = left.select("seq", "link", "key", "direct", "wraps", (F.col("owned") | met).alias("owned"), F.when(met, F.col("now_wraps")).otherwise(F.col("wrapped")).alias("wrapped"), F.when(met & ~F.col("changed"), F.col("key_by")).otherwise(F.col("owner")).alias("owner"))
    return stored(settled.unionByName(dropped)), stored(left)


def _walk(batches):
    """Settles whole components, rows in order of root and seq."""
    root, links, owners = None, {}, {}
    for batch in batches:
        out = []
        for own_root, seq, link, key, direct, wraps, owned, wrapped, owner in zip(*(c.to_pylist() for c in batch.columns)):
            if own_root != root:
                root, links, owners = own_root, {}, {}  # link: who blocks it; key: (owner, its link is a wrapper)
            upgrade = False
            if link is not None and link in links:
                outcome, by = "same_link", links[link]
            else:
                held = owners.get(key) if key is not None else None
                if held is None and owned:
                    held = owners[key] = (owner, wrapped)
                by = held[0] if held else None
                outcome = "keep" if held is None else "known_key" if by is None else "same_key"
                upgrade = held is not None and held[1] and direct
                if upgrade or held is None:
                    if key is not None:
                        owners[key] = (by, False) if upgrade else (seq, wraps)
                    if link is not None:
                        links[link] = seq
            out.append((seq, outcome, by, upgrade))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["seq", "outcome", "by", "upgrade"])


def settle(rows: DataFrame, wrapper: str = WRAPPER, component_rows: int = COMPONENT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """seq, outcome, by (the seq of the row of the batch that blocks it, if one does) and upgrade (whether it changes its owner's link).

    rows: seq (unique), stripped, normalized_key, and for keys with a stored owner owner_link, the owner's link.
    """
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    owner = F.col("owner_link") if "owner_link" in rows.columns else F.lit(None).cast("string")
    wraps = F.coalesce(F.contains("stripped", F.lit(wrapper)), F.lit(False))
    open_ = stored(rows.select(
        F.col("seq").cast("long").alias("seq"), filled("stripped").alias("link"), filled("normalized_key").alias("key"), (filled("stripped").isNotNull() & ~wraps).alias("direct"), wraps.alias("wraps"),
        owner.isNotNull().alias("owned"), F.coalesce(F.contains(owner, F.lit(wrapper)), F.lit(False)).alias("wrapped"), F.lit(None).cast("long").alias("owner"),
    ))
    parts, divided = [], False
    while not parts or not open_.isEmpty():  # the first open row is settled in each round, so this ends
        if len(parts) >= rounds and not divided:
            divided = True
            by = lambda c: open_.join(open_.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("seq").alias("v")), c).select(F.col("seq").alias("u"), "v")
            roots = stored(components(by("link").unionByName(by("key"))))
            large = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > component_rows).select("root")
            in_large = roots.join(large, "root", "left_semi").select(F.col("node").alias("seq"))
            small = roots.join(large, "root", "left_anti").select(F.col("node").alias("seq"), "root")
            walked = open_.join(small, "seq").select("root", *[f.split(" ")[0] for f in OPEN.split(", ")])
            parts.append(stored(walked.repartition("root").sortWithinPartitions("root", "seq").mapInArrow(_walk, DONE)))
            # rows that met no other are settled by a round
            alone = open_.join(roots.select(F.col("node").alias("seq")), "seq", "left_anti")
            open_ = stored(open_.join(in_large, "seq", "left_semi").unionByName(alone))
            continue
        settled, open_ = _round(open_)
        parts.append(settled)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
