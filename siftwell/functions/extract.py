"""Facts out of text: salary, season tokens, job-board addresses."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

# Season words and pay patterns.
SEASONS = "summer|fall|autumn|winter|spring"
SEASON_YEAR = rf"\b({SEASONS})\b[ ,/\-_–—'’]{{0,3}}(20\d{{2}}|'?\d{{2}})\b|\b(20\d{{2}})\b[ ,/\-_–—'’]{{0,3}}({SEASONS})\b"
SEASON_RUN = rf"((?:\b(?:{SEASONS})\b[ ,/&]{{0,3}}(?:and )?){{2,4}})(20\d{{2}}|'?\d{{2}})\b"
ORDER = {"winter": 0, "spring": 1, "summer": 2, "fall": 3}

AMOUNT, TO, RANGE_SEP = r"\$\s*([\d,]+(?:\.\d+)?)", r"\s*(?:-|to|–|—)\s*\$?\s*([\d,]+(?:\.\d+)?)", r"\s*\/?\s*"
HOURLY, MONTHLY, YEARLY = r"(?:hr|hour|hourly|\/h\b|per\s+hour)", r"(?:mo|month|monthly|per\s+month)", r"(?:yr|year|yearly|annual|annually|per\s+year)"
#: (pattern, has a second amount, unit, factor), the most specific first.
PAY_PATTERNS = [
    (AMOUNT + TO + RANGE_SEP + HOURLY, True, "hourly", 1),
    (AMOUNT + RANGE_SEP + HOURLY, False, "hourly", 1),
    (AMOUNT + TO + RANGE_SEP + MONTHLY, True, "monthly", 1),
    (AMOUNT + RANGE_SEP + MONTHLY, False, "monthly", 1),
    (AMOUNT + r"\s*[kK]" + TO + r"\s*[kK]", True, "yearly", 1000),
    (AMOUNT + TO + r"\s*[kK]\b", True, "yearly", 1000),
    (AMOUNT + r"\s*[kK]\b", False, "yearly", 1000),
    (AMOUNT + TO + RANGE_SEP + YEARLY, True, "yearly", 1),
    (AMOUNT + RANGE_SEP + YEARLY, False, "yearly", 1),
]
PLAUSIBLE = {"hourly": (5, 500), "monthly": (500, 50_000), "yearly": (20_000, 1_000_000)}
UNPAID = r"(?i)\b(unpaid|no\s+compensation|volunteer|pro\s+bono)\b"


def salary(text: Column) -> Column:
    """struct(text, min, max, unit) of the first plausible pattern, or null."""
    number = lambda s: F.regexp_replace(s, ",", "").try_cast("double")

    def first(flat):
        found = []
        for pattern, two, unit, factor in PAY_PATTERNS:
            regex = f"(?i){pattern}"
            least, most = PLAUSIBLE[unit]

            def amounts(m, regex=regex, two=two):
                low = number(F.regexp_extract(m, regex, 1))
                high = number(F.regexp_extract(m, regex, 2)) if two else F.lit(None).cast("double")
                return F.struct(m.alias("m"), low.alias("low"), high.alias("high"))

            def one(p, unit=unit, factor=factor):
                high = F.coalesce(p["high"], p["low"])
                return F.struct(F.trim(p["m"]).alias("text"), (F.least(p["low"], high) * factor).alias("min"), (F.greatest(p["low"], high) * factor).alias("max"), F.lit(unit).alias("unit"))

            # numbers are only read where the pattern matched: a cast that fails costs more than the pattern
            read = let(F.regexp_extract(flat, regex, 0), one_argument(lambda m, amounts=amounts: F.when(m != "", amounts(m))))
            found.append(let(let(read, one_argument(one)), plausible(least, most)))
        return F.coalesce(*found)

    # every pattern begins with the sign, so what comes before the first one is never read
    # a single blank is left as it is
    flat = F.regexp_replace(F.substring(text, F.instr(text, "$"), F.length(text)), r"[\s\u00A0&&[^ ]][\s\u00A0]*| [\s\u00A0]+", " ")
    low = F.lower(text)
    unpaid = (F.contains(low, F.lit("unpaid")) | F.contains(low, F.lit("compensation")) | F.contains(low, F.lit("volunteer")) | F.contains(low, F.lit("bono"))) & text.rlike(UNPAID)
    return F.when(F.contains(text, F.lit("$")) & ~unpaid, let(flat, first))


def one_argument(f):
    """f as a function of one argument, as column lambdas are told apart by their arguments."""
    return lambda value: f(value)


def plausible(least: float, most: float):
    return lambda s: F.when((s["min"] >= least) & (s["max"] <= most), s)


def _year(raw: Column) -> Column:
    digits = F.replace(raw, F.lit("'"), F.lit(""))
    return F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits)


def _season(raw: Column) -> Column:
    return F.when(raw == "autumn", "fall").otherwise(raw)


def season_tokens(title: Column) -> Column:
    """Sorted distinct tokens such as summer-2026; year-2026 where only a year is named; empty for none."""
    t = F.lower(F.coalesce(title, F.lit("")))
    pairs = F.transform(F.regexp_extract_all(t, F.lit(SEASON_YEAR), F.lit(0)), lambda m: F.concat(_season(F.regexp_extract(m, f"({SEASONS})", 1)), F.lit("-"), _year(F.regexp_extract(m, r"(20\d{2}|\d{2})", 1))))
    runs = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(SEASON_RUN), F.lit(0)), lambda m: F.transform(F.regexp_extract_all(m, F.lit(f"({SEASONS})"), F.lit(1)), lambda s: F.concat(_season(s), F.lit("-"), _year(F.regexp_extract(m, r"(20\d{2}|'?\d{2})$", 1))))))
    both = F.array_sort(F.array_distinct(F.concat(pairs, runs)))
    year = F.regexp_extract(t, r"\b(202\d)\b", 1)
    bare = F.when(year != "", F.array(F.concat(F.lit("year-"), year))).otherwise(F.array().cast("array<string>"))
    return let(both, lambda b: F.when(F.size(b) > 0, b).otherwise(bare))


def default_season(as_of: datetime.datetime) -> str:
    return f"summer-{as_of.year + (as_of.month >= 7)}"


def season_with_default(found: Column, as_of: datetime.datetime) -> Column:
    """Tokens with the default cycle where there are none, and bare years as summers."""
    promoted = lambda tokens: F.array_distinct(F.transform(tokens, lambda t: F.when(t.startswith("year-"), F.concat(F.lit("summer-"), F.substring(t, 6, 4))).otherwise(t)))
    return let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(default_season(as_of)))).otherwise(F.array_sort(promoted(f))))


def season_index(token: Column) -> Column:
    """year * 4 + season, or null."""
    first = F.substring_index(token, "-", 1)
    order = F.coalesce(*[F.when(first == s, F.lit(n)) for s, n in ORDER.items()])
    return F.substring_index(token, "-", -1).try_cast("int") * 4 + order


def current_index(as_of: datetime.datetime) -> int:
    return as_of.year * 4 + (0 if as_of.month <= 2 else 1 if as_of.month <= 5 else 2 if as_of.month <= 8 else 3)


def expired(tokens: Column, as_of: datetime.datetime) -> Column:
    """All known tokens lie before the current season; false without any."""
    return F.coalesce(F.array_max(F.transform(tokens, season_index)) < current_index(as_of), F.lit(False))


def season_sort_key(token: Column) -> Column:
    first = F.substring_index(token, "-", 1)
    order = F.coalesce(*[F.when(first == s, F.lit(n)) for s, n in (ORDER | {"year": 4}).items()], F.lit(9))
    return F.concat(F.substring_index(token, "-", -1), F.lit("-"), order.cast("string"))


#: (kind, host pattern, place of the slug: "host" or the number of the path segment).
BOARDS = [
    ("greenhouse", r"(^|\.)greenhouse\.io$", 1),
    ("lever", r"(^|\.)lever\.co$", 1),
    ("ashby", r"(^|\.)ashbyhq\.com$", 1),
    ("workday", r"\.myworkdayjobs\.com$", "host"),
    ("icims", r"\.icims\.com$", "host"),
    ("smartrecruiters", r"(^|\.)smartrecruiters\.com$", 1),
    ("rippling", r"^ats\.rippling\.com$", 1),
    ("workable", r"^apply\.workable\.com$", 1),
]
LOCALE = r"^[a-z]{2}(-[A-Z]{2})?$"


def board_address(url: Column) -> Column:
    """struct(ats, slug, board, instance, job_id) of a job-board url; null for any other."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(LOCALE))
    kind = F.coalesce(*[F.when(host.rlike(pattern), F.lit(k)) for k, pattern, _ in BOARDS])
    by_host = kind.isin("workday", "icims")
    slug = F.when(by_host, F.regexp_replace(F.substring_index(host, ".", 1), "^careers-", "")).otherwise(F.get(parts, F.lit(0)))
    board = F.when(kind == "workday", F.get(parts, F.lit(0)))
    instance = F.when(kind == "workday", F.regexp_extract(host, r"\.(wd\d+)\.", 1))
    job = F.when(kind == "workday", F.when(F.size(parts) > 1, F.element_at(parts, -1))).when(kind == "greenhouse", F.nullif(F.regexp_extract(path, r"/jobs/(\d+)", 1), F.lit(""))).when(kind == "workable", F.nullif(F.regexp_extract(path, r"/j/([A-Za-z0-9]+)", 1), F.lit(""))).when(kind == "rippling", F.nullif(F.regexp_extract(path, r"/jobs/([A-Za-z0-9-]+)", 1), F.lit(""))).when(kind == "icims", F.nullif(F.regexp_extract(path, r"/jobs/(\d+)", 1), F.lit(""))).when(F.size(parts) > 1, F.get(parts, F.lit(1)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("ats"), slug.alias("slug"), board.alias("board"), instance.alias("instance"), job.alias("job_id")))


def linkedin_id(url: Column) -> Column:
    query = F.regexp_extract(url, r"[?&]currentJobId=(\d+)", 1)
    tail = F.regexp_extract(url, r"/jobs/view/(?:[^/?#]*-)?(\d+)/?(?:[?#]|$)", 1)
    return F.nullif(F.when(query != "", query).otherwise(tail), F.lit(""))


def stable_linkedin_link(url: Column) -> Column:
    """A posting's own page as a search for its id, which stays valid when the posting closes; other links as they are."""
    number = F.regexp_extract(url, r"(?i)^https?://(?:[a-z]+\.)?linkedin\.com/jobs/view/(\d+)(?:[/?#].*)?$", 1)
    return F.when(number != "", F.concat(F.lit("https://www.linkedin.com/jobs/search/?currentJobId="), number)).otherwise(url)


REFERENCES = [
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([A-Za-z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([A-Za-z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([A-Za-z0-9_-]+)"),
]


def mined_references(text: Column) -> Column:
    """array of (ats, slug) that a free text names."""
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("ats"), F.lower(s).alias("slug"))
    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), named(k)) for k, p in REFERENCES]
    return F.array_distinct(F.filter(F.concat(*each), lambda r: ~r["slug"].isin("embed", "job", "jobs", "api", "careers")))
