"""Places of pattern matches in whole texts, by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and end (exclusive) in code points, and what matched.
PLACE = "array<struct<start:int,end:int,value:string>>"


#: Elements whose sums are taken one by one; longer arrays are summed block by block.
BLOCK = 64


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def running_sums(sizes: Column, levels: int = 2) -> Column:
    """For each element of an array of integers the sum of those before it.

    An array of over BLOCK elements takes the sums of its blocks, in turn by their running sums, and adds
    within a block: with two levels all but one in BLOCK ** 2 elements are added in proportion to the length.
    """
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    direct = F.transform(sizes, lambda x, i: total(F.slice(sizes, F.lit(1), i)))
    if not levels:
        return direct
    block = lambda i: F.floor(i / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(sizes) - 1)), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    inside = lambda before: F.transform(sizes, lambda x, i: F.get(before, block(i)) + total(F.slice(sizes, block(i) * BLOCK + 1, i - block(i) * BLOCK)))
    return F.when(F.size(sizes) <= BLOCK, direct).otherwise(let(blocks, lambda all_: let(running_sums(all_, levels - 1), inside)))


def places(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that never matches the empty string.

    What stands between the matches, by split, and the matches themselves give the places by
    adding up lengths, in time that grows with their number. guard: a cheap test without which no match is possible.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap"), F.length(value).alias("size")))

    def placed(pairs):
        start = lambda p, before: before + p["gap"]
        one = lambda p, before: F.struct(start(p, before).alias("start"), (start(p, before) + p["size"]).alias("end"), p["value"].alias("value"))
        sizes = F.transform(pairs, lambda p: p["gap"] + p["size"])
        return let(sizes, lambda n: F.zip_with(pairs, running_sums(n), one)).cast(PLACE)

    some = F.regexp_like(text, regex)
    # split gives one piece more than there are matches: the last one has no value
    matched = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.when(some if guard is None else guard & some, let(matched, placed)).otherwise(F.array().cast(PLACE))


def of_kind(kind: str, found: Column, order: int) -> Column:
    """The places with the name of their kind and its rank."""
    return F.transform(found, lambda s: F.struct(F.lit(order).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long")


def redacted(text: Column, spans: Column, marks: dict[str, str]) -> Column:
    """text with each span replaced by its kind's mark; of overlapping spans the one that begins first stands, and the rest of
    the others goes with it. spans: in order of start."""
    mark = lambda s: F.coalesce(*[F.when(s["kind"] == F.lit(k), F.lit(m)) for k, m in marks.items()], F.lit(""))
    ends = F.transform(spans, lambda s: s["end"])

    def piece(s, i, furthest):
        # furthest: where the spans before this one end
        gap = F.when(s["start"] > furthest, F.substring(text, furthest + 1, s["start"] - furthest)).otherwise(F.lit(""))
        return F.concat(gap, F.when(s["start"] >= furthest, mark(s)).otherwise(F.lit("")))

    def joined(reach):
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda s, i: piece(s, i, before(i)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.get(reach, F.size(reach) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(ends, lambda e: let(running_greatest(e), joined)))


def running_greatest(values: Column, levels: int = 2) -> Column:
    """For each element of an array of integers the greatest up to and with it."""
    direct = F.transform(values, lambda x, i: F.array_max(F.slice(values, F.lit(1), i + 1)))
    if not levels:
        return direct
    block = lambda i: F.floor(i / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(values) - 1)), lambda b: F.array_max(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    own = lambda i: F.array_max(F.slice(values, block(i) * BLOCK + 1, i - block(i) * BLOCK + 1))
    inside = lambda before: F.transform(values, lambda x, i: F.greatest(own(i), F.get(before, block(i) - 1)))
    return F.when(F.size(values) <= BLOCK, direct).otherwise(let(blocks, lambda all_: let(running_greatest(all_, levels - 1), inside)))
