"""Predicates over postings: the ordered hard-filter chain, filter specs, list filters and data-quality tests."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siftwell.functions import extract
from siftwell.functions.text import let
from siftwell.operators.location import location_class
from siftwell.operators.scoring import tier_rank

INTERN = r"(?i)(?<![A-Za-z0-9_])(intern(ship)?|co-?op)(?![A-Za-z0-9_])"
# Fragments by which the rules decide.
RESEARCH = ["research intern", "graduate research", "research scientist", "lab research", "computational research", "undergraduate research", "scientific research", "science research", "research assistant"]
NON_SWE = [
    "hardware engineer", "mechanical engineer", "civil engineer", "electrical engineer", "manufacturing engineer", "aerospace engineer", "mechanical aerospace",
    "operations intern", "operation support", "operations support", "accounting intern", "finance intern", "financial intern", "marketing intern", "marketing analytics",
    "social media intern", "social media internship", "sales intern", "sales development", "business development intern", "hr intern", "human resources intern", "recruiter",
    "instructional design", "supply chain intern", "logistics intern", "communications intern", "policy intern", "legal intern", "product marketing", "marketing &",
    "media process", "product line intern", "sales/gtm", "gtm", "investment research", "mission operations", "global operations",
]
DEGREE = [
    "🎓", "phd", "ph.d", "doctoral", "masters required", "ms required", "graduate students only", "graduate degree required", "mba", "mba intern", "mba student",
    "master of business", "graduate intern", "grad intern", "masters student", "ms student", "masters intern", "ms intern",
]
CS_STEMS = [
    "software", "engineer", "develop", "data", "backend", "frontend", "full stack", "full-stack", "fullstack", "system", "infrastructure", "platform", "security", "devops",
    "cloud", "quant", "technolog", "web", "applicat", "mobile", "automat", "cyber", "network", "database", "analytic", "program", "comput", "science",
]
CS_ACRONYMS = r"(?<![a-z0-9_])(sde|swe|ml|ai|cs)(?![a-z0-9_])"
CLOSED = ["🔒", "position filled", "no longer accepting", "closed"]
AGGREGATORS = ["linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "simplify.jobs", "google.com"]
ROLES = {
    "swe": ["software engineer", "swe intern", "full stack", "fullstack", "full-stack", "backend", "back end", "back-end", "frontend", "front end", "front-end", "platform engineer", "systems engineer", "product engineer", "developer", "programmer", "web developer", "web engineer", "api engineer", "engineer intern", "intern engineer", "software development", "software testing", "test engineer", "computer engineer"],
    "ai-ml": ["ai engineer", "ai/ml", "ml engineer", "generative ai", "llm", "applied ai", "machine learning", "ai intern", "ai solutions", "ai developer", "applied scientist", "research scientist", "nlp", "computer vision"],
    "data": ["data engineer", "data science", "data analyst", "analytics engineer"],
    "infra": ["infrastructure", "cloud engineer", "devops", "site reliability", "sre", "distributed systems", "build engineer", "tooling", "embedded", "systems programming"],
    "security": ["security engineer", "security intern", "cybersecurity", "network security", "reverse engineer"],
    "mobile": ["mobile engineer"],
    "quant": ["quantitative", "quant"],
    "research": ["research engineer", "research scientist", "applied scientist"],
    "blockchain": ["blockchain engineer"],
}


def any_of(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments])


def exclusion_reason(as_of: datetime.datetime, season: Column | None = None) -> Column:
    """The first rule that rejects a posting (title, location; season tokens by title unless given), or null."""
    title = F.lower(F.coalesce("title", F.lit("")))
    both = F.concat(title, F.lit(" "), F.lower(F.coalesce("location", F.lit(""))))
    tokens = extract.season_with_default(extract.season_tokens(F.col("title")), as_of)
    tokens = tokens if season is None else F.coalesce(season, tokens)

    # the lower-cased texts are worked out once for all fragments
    def by_texts(t):
        return (
            F.when(any_of(t["title"], RESEARCH) | any_of(t["title"], NON_SWE), "non_swe")
            .when(any_of(t["both"], DEGREE), "phd_required")
            .when(~any_of(t["title"], CS_STEMS) & ~t["title"].rlike(CS_ACRONYMS), "non_swe")
            .when(any_of(t["both"], CLOSED), "closed")
        )

    by_title = F.coalesce(let(F.struct(title.alias("title"), both.alias("both")), by_texts), F.when(extract.expired(tokens, as_of), "expired_season"))
    return F.when(location_class(F.col("location")) == "non_us", "non_us").when(~F.coalesce("title", F.lit("")).rlike(INTERN), "not_intern").otherwise(by_title)


def hard_filtered(df: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """df with exclusion_reason and passed."""
    return df.withColumn("exclusion_reason", exclusion_reason(as_of)).withColumn("passed", F.col("exclusion_reason").isNull())


def list_predicate(archived: bool = False, hidden: bool = False, sources: list[str] | None = None, source: str | None = None, label: str | None = None, least_score: int | None = None, query: str | None = None) -> Column:
    """The list view's predicates; a list of sources beats a single one; the query is taken literally."""
    tests = []
    if not archived:
        tests.append(~F.col("archived"))
    if not hidden:
        tests.append(~F.col("hidden"))
    if sources:
        tests.append(F.lower("source").isin([s.lower() for s in sources]))
    elif source:
        tests.append(F.lower("source") == source.lower())
    if label:
        tests.append(F.lower("score_label") == label.lower())
    if least_score is not None:
        tests.append(F.coalesce("score", F.lit(0)) >= least_score)
    if query:
        tests.append(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(query.lower())) for c in ("title", "company", "location")]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class FilterSpec:
    """The shared filter; an absent or empty field is no gate."""

    tier: str | None = None
    seasons: tuple[str, ...] = ()
    applied: bool | None = None
    exclude_hidden: bool = False
    include_sources: tuple[str, ...] = ()
    exclude_sources: tuple[str, ...] = ()
    least_score: int = 0
    posted_after: datetime.datetime | None = None
    include_keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()

    def predicate(self) -> Column:
        tests = []
        if self.tier in ("elite", "top-or-better", "solid-or-better"):
            tests.append(F.coalesce(tier_rank(F.col("company")) <= ["elite", "top-or-better", "solid-or-better"].index(self.tier) + 1, F.lit(False)))
        if self.seasons:
            tests.append(F.arrays_overlap(extract.season_tokens(F.col("title")), F.array(*map(F.lit, self.seasons))))
        if self.applied is not None:
            tests.append(F.col("applied") == self.applied)
        if self.exclude_hidden:
            tests.append(~F.col("hidden"))
        if self.include_sources:
            tests.append(F.col("source").isin(*self.include_sources))
        if self.exclude_sources:
            tests.append(F.col("source").isNull() | (F.col("source") == "") | ~F.col("source").isin(*self.exclude_sources))
        if self.least_score > 0:
            tests.append(F.coalesce("score", F.lit(0)) >= self.least_score)
        if self.posted_after is not None:
            tests.append(F.coalesce("posted_at", F.lit(datetime.datetime(1970, 1, 1))) >= F.lit(self.posted_after))
        tags = F.transform(F.coalesce("matched_keywords", F.array().cast("array<string>")), lambda k: F.lower(k))
        if self.include_keywords:
            tests.append(F.arrays_overlap(tags, F.array(*[F.lit(k.lower()) for k in self.include_keywords])))
        if self.exclude_keywords:
            tests.append(~F.arrays_overlap(tags, F.array(*[F.lit(k.lower()) for k in self.exclude_keywords])))
        if self.roles:
            tests.append(in_role(F.col("matched_keywords"), *self.roles))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_role(tags: Column, *roles: str) -> Column:
    """Some tag equals, contains or is part of a keyword of one of the roles."""
    keywords = list(dict.fromkeys(k for r in roles for k in ROLES[r]))
    named = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) | F.contains(F.lit(k), t) for k in keywords])
    return F.coalesce(F.exists(F.transform(tags, lambda t: F.lower(t)), named), F.lit(False))


def free_text(query: str | None, chips: tuple[str, ...] = ()) -> Column:
    """The text or any of the location chips; without both, all pass."""
    tests = [F.contains(F.lower(F.concat_ws(" ", "company", "title", "location")), F.lit(query.lower()))] if query else []
    tests += [F.contains(F.lower("location"), F.lit(c.lower())) for c in chips]
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def alert_filter(spec: FilterSpec, us_only: bool = True) -> Column:
    gate = spec.predicate()
    return (location_class(F.col("location")) != "non_us") & gate if us_only else gate


def aggregator_link(url: Column, domains: list[str] = AGGREGATORS) -> Column:
    """The host is one of the domains or below one; what isn't a url counts as one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains]), F.lit(True))


def aggregator_links(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """df with `aggregator`, the verdict of `aggregator_link`, for a table of domains (domain) of any size.

    Each distinct host is expanded to its suffixes at dots, which meet the domains in a semi join; nothing is tested one by one.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    rows = df.withColumn("_host", host)
    hosts = rows.where("_host is not null").select("_host").distinct()
    labels = hosts.withColumn("_labels", F.split("_host", r"\."))
    suffixes = labels.select("_host", F.explode(F.expr("transform(sequence(1, size(_labels)), k -> array_join(slice(_labels, k, size(_labels)), '.'))")).alias("domain"))
    listed = suffixes.join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select("_host").distinct().withColumn("_listed", F.lit(True))
    return rows.join(listed, "_host", "left").withColumn("aggregator", F.col("_host").isNull() | F.coalesce("_listed", F.lit(False))).select(*df.columns, "aggregator")


REASONS = ["non_us", "not_intern", "non_swe", "phd_required", "closed", "expired_season"]


def write_passing(df: DataFrame, as_of: datetime.datetime, path: str) -> dict[str, int]:
    """Writes the rows that pass the hard filter, and gives how many each reason rejects: counted in the same pass."""
    seen = Observation()
    rows = hard_filtered(df, as_of)
    counts = [F.count_if(F.col("exclusion_reason") == r).alias(r) for r in REASONS] + [F.count_if("passed").alias("passed")]
    rows.observe(seen, *counts).where("passed").drop("passed", "exclusion_reason").write.parquet(path)
    return dict(seen.get)


def redirect_link(url: Column, domains: list[str] = AGGREGATORS) -> Column:
    """The scrape's looser test: a domain anywhere, a redirect parameter, or a click counter."""
    low = F.lower(url)
    return any_of(low, domains) | low.rlike(r"[?&](redirect|redirect_url|url|dest|target)=") | F.contains(low, F.lit("click?"))


def placeholder_reason() -> Column:
    """Why a row is test data, or null."""
    return F.when(F.upper("source") == "TEST", "test_source").when(F.col("company").rlike("^XSTest"), "test_company").when(F.lower("company").isin("nan", "none", ""), "no_company")


def junk_name(name: Column) -> Column:
    """Not a company's name: too short or long, decorated, marked up, a forum's artefact, hardly a letter."""
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", ""))
    return ~F.length(name).between(2, 60) | name.rlike(r"^[\W_]+$|[<>{}|]|https?:|^(re|fwd|show hn|ask hn):|(?i)^(edit|update|note|remote)\b") | (letters < 2)


def corrupted(row: dict[str, str] | None = None) -> Column:
    """Rows whose card was cut in the wrong place: pay, footers or posting words in the wrong column."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    return (
        c("title").rlike(r"\$\d|/hr\b|\bUnpaid\b") | c("title").rlike("(?i)(promoted|viewed|saved)$") | (c("title") == c("company")) | (c("company") == "")
        | c("company").rlike(r"(?i)\b(internship|full-time|part-time)\b") | c("location").rlike(r"(?i)\b\d+(d|wk|mo) ago\b") | c("location").rlike("[∙·]") | (c("title") == "")
    )


def stale(as_of: datetime.datetime, days: int = 30) -> Column:
    return F.col("posted_at") < F.lit(as_of) - F.expr(f"interval {days} days")


def in_window(as_of: datetime.datetime, days: int | None) -> Column:
    return F.lit(True) if days is None else F.col("posted_at") >= F.lit(as_of) - F.expr(f"interval {days} days")


CHANGEABLE = {"applied": "bool", "hidden": "bool", "archived": "bool", "applied_at": "time", "application_url": "url", "application_status": "short"}


def change_error() -> Column:
    """For change rows (id, field, value): null, or the name of what is wrong."""
    kind = F.coalesce(*[F.when(F.col("field") == f, F.lit(k)) for f, k in CHANGEABLE.items()])
    v = F.col("value")
    return (
        F.when(kind.isNull(), "unknown_field")
        .when((kind == "bool") & ~F.coalesce(v.isin("true", "false"), F.lit(False)), "not_boolean")
        .when((kind == "time") & v.isNotNull() & F.try_to_timestamp(v).isNull(), "not_a_time")
        .when((kind == "url") & v.isNotNull() & (~v.rlike("^https?://[^/]+") | (F.length(v) > 2048)), "not_a_url")
        .when((kind == "short") & (F.length(v) > 200), "too_long")
    )


def link_verdict(status: Column) -> Column:
    """ok, permanent, transient or error."""
    return F.when(status == -1, "error").when(status.isin(401, 404, 410, 451), "permanent").when(status >= 400, "transient").otherwise("ok")
