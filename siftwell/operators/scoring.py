"""Dictionary scoring of postings: role, company and location points, label and matched keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import let, padded, stems, tokens

# Tiers in order, their points, keywords in order. The company tiers here are a default;
# a whole dictionary is read by `load_dictionary`.
ROLE = [
    ("T1", 40, ["software engineer", "software development", "swe intern", "full stack", "fullstack", "full-stack", "backend", "back end", "back-end", "frontend", "front end", "front-end", "ai engineer", "ai/ml", "ml engineer", "generative ai", "llm", "applied ai", "security engineer", "security intern", "cybersecurity", "platform engineer", "systems engineer"]),
    ("T2", 27, ["data engineer", "data science", "machine learning", "distributed systems", "infrastructure", "cloud engineer", "devops", "site reliability", "sre", "api engineer", "web developer", "web engineer", "embedded", "systems programming", "network security", "reverse engineer", "quantitative", "quant"]),
    ("T3", 13, ["product engineer", "developer", "programmer", "data analyst", "analytics engineer", "research engineer", "research scientist", "mobile engineer", "tooling", "build engineer", "computer vision", "nlp", "blockchain engineer", "engineer intern", "intern engineer", "ai intern", "ai solutions", "ai developer", "test engineer", "computer engineer", "applied scientist", "software testing"]),
]
COMPANY = [
    ("elite", 70, ["akuna capital", "amazon", "anthropic", "apple", "citadel", "databricks", "google", "hudson river trading", "jane street", "meta", "microsoft", "netflix", "nvidia", "openai", "palantir", "stripe", "two sigma"]),
    ("top", 45, ["adobe", "airbnb", "bloomberg", "capital one", "coinbase", "goldman sachs", "palo alto networks", "paypal", "samsung", "snowflake", "uber"]),
    ("solid", 20, ["boston dynamics", "box", "cisco", "dell", "lockheed martin", "quadric", "snyk", "texas instruments"]),
]
LOCATION = [("preferred", 6, ["new york", "nyc", "san francisco", "sf", "bay area", "seattle", "boston", "austin"])]
CEILING = 100
#: Least score of each label.
LABELS = [("A", 75), ("B", 60), ("C", 45), ("D", 25), ("F", 0)]


def load_dictionary(spark: SparkSession, path: str) -> dict[str, list]:
    """Role, company and location tiers from a JSON file of (component, tier, tier_ord, points, kw_ord, keyword) rows: a small dimension."""
    rows = spark.read.schema("component string, tier string, tier_ord int, points int, kw_ord int, keyword string").json(path)
    out: dict[str, list] = {"role": [], "company": [], "location": []}
    for r in rows.orderBy("component", "tier_ord", "kw_ord").toLocalIterator():
        tiers = out[r["component"]]
        if not tiers or tiers[-1][0] != r["tier"]:
            tiers.append((r["tier"], r["points"], []))
        tiers[-1][2].append(r["keyword"])
    return out


def _first_hit(text: Column, tiers: list, anchored: bool = False) -> Column:
    """struct(points, keyword) of the first keyword in order that the padded tokens contain."""
    hits = []
    for _, points, keywords in tiers:
        for kw in keywords:
            words = stems(kw)
            phrase = f" {' '.join(words)} "
            test = text.startswith(phrase) if anchored and len(words) == 1 else F.contains(text, F.lit(phrase))
            hits.append(F.when(test, F.struct(F.lit(points).alias("points"), F.lit(kw).alias("keyword"))))
    return F.coalesce(*hits)


def _best_tier(text: Column, tiers: list) -> Column:
    hits = [_first_hit(text, [t]) for t in sorted(tiers, key=lambda t: -t[1])]
    return F.coalesce(*hits)


def scored(df: DataFrame, role=ROLE, company=COMPANY, location=LOCATION, ceiling: int = CEILING) -> DataFrame:
    """df with role_points, company_points, location_points, score, score_label and matched_keywords."""
    # the tokens are worked out once for all keywords, also where Spark moves these columns into a filter
    hit = lambda c, first: let(padded(tokens(F.coalesce(F.col(c), F.lit("")))), first)
    rows = df.withColumns({"_role": hit("title", lambda t: _first_hit(t, role)), "_company": hit("company", lambda t: _first_hit(t, company, True)), "_location": hit("location", lambda t: _best_tier(t, location))})
    points = lambda c: F.coalesce(F.col(c)["points"], F.lit(0))
    rows = rows.withColumns({"role_points": points("_role"), "company_points": points("_company"), "location_points": points("_location")})
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.col("role_points") + F.col("company_points") + F.col("location_points"), F.lit(ceiling))))
    matched = F.array_distinct(F.array_compact(F.array(F.col("_role")["keyword"], F.col("_company")["keyword"], F.col("_location")["keyword"])))
    return rows.withColumns({"score_label": label(F.col("score")), "matched_keywords": matched}).drop("_role", "_company", "_location")


DICTIONARY = "component string, tier string, tier_ord int, points int, kw_ord int, keyword string"


def dictionary_rows(spark: SparkSession, role=ROLE, company=COMPANY, location=LOCATION) -> DataFrame:
    """The tiers as rows of a dictionary table."""
    rows = [(component, tier, n, points, k, kw) for component, tiers in (("role", role), ("company", company), ("location", location)) for n, (tier, points, kws) in enumerate(tiers) for k, kw in enumerate(kws)]
    return spark.createDataFrame(rows, DICTIONARY)


def scored_by(df: DataFrame, dictionary: DataFrame, key: str = "seq", ceiling: int = CEILING) -> DataFrame:
    """What `scored` gives, for a dictionary of any size: an index on the whole phrases of its keywords.

    dictionary: component (role, company, location), tier, tier_ord, points, kw_ord, keyword. The runs of tokens of a posting
    that are as long as some keyword of the component meet the keywords by equality, so that keywords with words in common
    aren't tried one by one; Spark broadcasts the index where its size allows. Only distinct texts are looked up. key: a column
    that identifies a row.
    """
    texts = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.coalesce(F.col(f), F.lit("")).alias("text")) for c, f in (("role", "title"), ("company", "company"), ("location", "location"))])).alias("t")).select(key, "t.*")
    # the best tier of a location, else the first keyword in order
    order = F.struct(F.when(F.col("component") == "location", -F.col("points")).otherwise(0).alias("tier_rank"), "tier_ord", "kw_ord", "points", "keyword")
    index = dictionary.withColumn("words", tokens(F.col("keyword"))).where(F.size("words") > 0)
    index = index.groupBy("component", F.size("words").alias("length"), F.array_join("words", " ").alias("phrase")).agg(F.min(order).alias("entry"))
    # a few rows, as long keywords are rare: m distinct lengths take m * m / 2 words of dictionary
    lengths = F.broadcast(index.select("component", "length").distinct())
    places = texts.select("component", "text").distinct().withColumn("all", tokens(F.col("text"))).join(lengths, "component").where(F.size("all") >= F.col("length"))
    # a company of one word must begin the name
    last = F.when((F.col("component") == "company") & (F.col("length") == 1), 0).otherwise(F.size("all") - F.col("length"))
    places = places.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    runs = places.select("component", "text", "length", F.array_join(F.slice("all", F.col("at") + 1, F.col("length")), " ").alias("phrase"))
    best = runs.join(index, ["component", "length", "phrase"]).groupBy("component", "text").agg(F.min("entry").alias("hit"))
    found = texts.join(best, ["component", "text"])
    of = lambda c: F.max(F.when(F.col("component") == c, F.struct("hit.points", "hit.keyword")))
    wide = found.groupBy(key).agg(*[of(c).alias(f"_{c}") for c in ("role", "company", "location")])
    rows = df.join(wide, key, "left")
    points = {f"{c}_points": F.coalesce(F.col(f"_{c}")["points"], F.lit(0)) for c in ("role", "company", "location")}
    rows = rows.withColumns(points).withColumn("score", F.greatest(F.lit(0), F.least(F.col("role_points") + F.col("company_points") + F.col("location_points"), F.lit(ceiling))))
    matched = F.array_distinct(F.array_compact(F.array(*[F.col(f"_{c}")["keyword"] for c in ("role", "company", "location")])))
    return rows.withColumns({"score_label": label(F.col("score")), "matched_keywords": matched}).drop("_role", "_company", "_location")


def label(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, F.lit(name)) for name, least in LABELS])


def tier_rank(company: Column, tiers=COMPANY) -> Column:
    """1 for the first tier, 2 for the second, and so on; null outside all."""
    ranks = lambda text: F.coalesce(*[F.when(_first_hit(text, [t], True).isNotNull(), F.lit(n + 1)) for n, t in enumerate(tiers)])
    return let(padded(tokens(F.coalesce(company, F.lit("")))), ranks)
