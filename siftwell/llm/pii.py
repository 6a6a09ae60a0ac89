"""Personal data: four patterns, and the terms around them that give an entity away, by column functions alone.

The patterns' finds are the protected entities. The last `WINDOW` terms before and the first
`WINDOW` terms behind an entity, however far off, are counted over the whole corpus: how often a term stands by an entity, in how many
different contexts, and how often at all. With p(e) the share of an entity among all words and
p(e | t) the share of a term's places that stand by it, a term discloses the part
    1 + log p(e | t) / -log p(e)
of the entity's information (its pointwise mutual information with the term over the entity's
information content). From `generalise` on, with at least `least_contexts` different contexts, the term
is generalised where it stands by that entity, from `remove` on it is removed.

Edge cases: null and empty texts have no span; very long texts are read whole, in time that grows with
their length and the number of their spans; an entity that has no repeated context gets no terms; exact
copies of a passage are one context; of terms that tie at a threshold all are taken; rows that repeat a doc_id and
text get the same spans; an empty table gives no row. Extra columns are ignored by `find`, kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import same_text, stored
from siftwell.llm.spans import count_of, let, listed, of_kind, places, redacted, running_sums

# the start of a local part is where no character of it stands before, or where the last match ended
# possessive groups are matched in a loop, greedy ones by recursion, a level for each label of a domain
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# a match begins where a run of digits does
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# whole runs of digits with single blanks or hyphens, of 16 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity.
WINDOW = 4
GENERALISE, REMOVE, LEAST_CONTEXTS = 0.85, 0.95, 3
#: What takes the place of a span when a text is sanitised.
MARKS = {k: f"[{k.upper()}]" for k in KINDS} | {"generalised": "[TERM]", "removed": ""}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: (lambda v: v - F.when(v > 9, 9).otherwise(0))(F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by kind and then start."""
    some_digit_run = F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"))
    found = (
        places(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(places(text, IP, F.contains(text, F.lit("."))), lambda s: F.forall(F.split(s["value"], "\\."), lambda p: F.regexp_like(p, F.lit(OCTET)))),
        F.filter(places(text, CARD, some_digit_run), lambda s: _luhn(s["value"])),
        F.filter(places(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(8, 15)),
    )
    return F.concat(*[of_kind(k, f, n) for n, (k, f) in enumerate(zip(KINDS, found))])


def _near(text: Column, spans: Column) -> Column:
    """For each span the terms around it: array of (term, start, end), the last `WINDOW` before it and the first `WINDOW` behind it.

    Terms and the ends of spans are sorted by place once; the number of terms before an end tells which ones are next to it.
    """

    def around(terms):
        place = lambda at, term, side, k: F.struct(at.alias("at"), term.alias("term"), side.alias("side"), k.alias("k"))
        none, one = F.lit(0), F.lit(1)
        ends = (F.transform(spans, lambda s, k: place(s["start"], none, none, k)), F.transform(spans, lambda s, k: place(s["end"], none, one, k)))
        marks = F.sort_array(F.concat(F.transform(terms, lambda t: place(t["start"], one, none, none)), *ends))

        def counted(marks):
            n = let(F.transform(marks, lambda m: m["term"]), lambda t: F.zip_with(marks, running_sums(t), lambda m, n: F.struct(m["side"].alias("side"), m["k"].alias("k"), n.alias("n"), m["term"].alias("term"))))
            return F.sort_array(F.filter(n, lambda m: m["term"] == 0))

        def picked(order):
            before = lambda s, n: F.filter(F.slice(terms, F.greatest(n - WINDOW, F.lit(0)) + 1, F.least(n, F.lit(WINDOW + 1))), lambda t: t["end"] <= s["start"])
            last = lambda b: F.slice(b, F.greatest(F.size(b) - WINDOW, F.lit(0)) + 1, F.lit(WINDOW))
            behind = lambda n: F.slice(terms, n + 1, F.lit(WINDOW))
            both = lambda s, k: F.concat(let(before(s, F.get(order, k)["n"]), last), behind(F.get(order, F.size(spans) + k)["n"]))
            return F.transform(spans, both)

        return let(let(marks, counted), picked)

    found = F.transform(places(text, TERM), lambda p: F.struct(F.lower(p["value"]).alias("term"), p["start"].alias("start"), p["end"].alias("end")))
    return let(found, around)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, _same, _spans (rank, start, end, kind, value) and _near (the terms around each span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", same_text().alias("_same"), text.alias("_text"), base_spans(text).alias("_spans"))
    near = F.when(F.size("_spans") > 0, _near(F.col("_text"), F.col("_spans")))
    return rows.select("doc_id", "_same", "_spans", near.alias("_near"))


def word_counts(docs: DataFrame) -> DataFrame:
    """term, n: how often each term stands in all texts."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return docs.where("text is not null").select(words.alias("term")).where(F.length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosing_terms(places_: DataFrame, counts: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """entity, term, action of the terms that disclose an entity. places_: entity, term, context; counts: term, n."""
    by_context = places_.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    together = by_context.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together")).where(F.col("contexts") >= least_contexts)
    each = places_.groupBy("entity", "span").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known = together.join(counts, "term").join(each, "entity")
    share = F.log(F.least(F.lit(1.0), F.col("together") / F.greatest("n", "together"))) / F.greatest(F.log(F.lit(float(max(total, 2))) / F.col("n_entity")), F.lit(1e-9))
    rated = known.withColumn("disclosed", 1 + share)
    return rated.where(F.col("disclosed") >= generalise).select("entity", "term", F.when(F.col("disclosed") >= remove, "removed").otherwise("generalised").alias("action"), "disclosed", "contexts")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, _same, base (spans of the patterns), terms (spans of disclosing terms) for each document."""
    found = stored(entities(docs), "entities")
    each = found.where(F.size("_spans") > 0).select("doc_id", "_same", F.explode(F.arrays_zip("_spans", "_near")).alias("e"))
    each = each.select("doc_id", "_same", F.concat_ws(":", "e._spans.kind", F.lower("e._spans.value")).alias("entity"), F.xxhash64("doc_id", "_same", "e._spans.start").alias("span"), F.xxhash64(F.transform("e._near", lambda t: t["term"])).alias("context"), F.explode("e._near").alias("t"))
    near = each.select("doc_id", "_same", "entity", "span", "context", "t.term", "t.start", "t.end")
    counts = stored(word_counts(docs), "word-counts")
    disclosing = disclosing_terms(near, counts)
    hits = near.join(disclosing.select("entity", "term", "action"), ["entity", "term"]).groupBy("doc_id", "_same").agg(F.sort_array(F.collect_set(F.struct("start", "end", F.col("action").alias("kind")))).alias("terms"))
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("_same").alias("_found"), "terms")
    joined = found.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_same") == F.col("_found")), "left")
    return joined.select("doc_id", "_same", F.col("_spans").alias("base"), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the entities' and the disclosing terms' places in text replaced or removed."""
    found = find(docs).dropDuplicates(["doc_id", "_same"])
    places_ = F.sort_array(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.col("terms")))
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"), same_text().alias("_same"))
    spans = found.select(F.col("doc_id").alias("_doc"), F.col("_same").alias("_found"), places_.alias("_places"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_same") == F.col("_found")), "left")
    return joined.select(F.col("_row").withField("text", redacted(F.col("_row.text"), F.col("_places"), MARKS)).alias("_row")).select("_row.*")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    spans = F.concat_ws(",", F.when(F.size("base") > 0, listed(F.col("base"))), F.when(F.size("terms") > 0, listed(F.col("terms"))))
    return found.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("terms").cast("long").alias("n_terms"))
