"""SQL building blocks that say again, for DuckDB, what the column functions compute."""

from __future__ import annotations

from siftwell.functions import extract, text
from siftwell.operators import location, rules, scoring
from siftwell.sources.fixtures import postings_cte

AS_OF = "timestamp '2026-06-05 00:00:00'"
CURRENT, DEFAULT_SEASON = 2026 * 4 + 2, "summer-2026"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def canon(c: str) -> str:
    n = f"trim(regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"
    n = f"trim(regexp_replace({n}, '(?:\\s*\\([^)]*\\)\\s*)+$', ''))"
    n = f"trim(regexp_replace({n}, '(?i)(?:,?\\s+(?:{text.LEGAL})\\.?)+$', ''))"
    return f"(case lower({n}) " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in text.ALIASES.items()) + f" else {n} end)"


def key(company: str, title: str) -> str:
    t = f"regexp_replace(regexp_replace(lower({title}), '\\(.*?\\)', ' ', 'g'), '\\[.*?\\]', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, {quoted(text.TAIL + '.*$')}, ''), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')"
    return f"(trim(lower({company})) || '::' || array_to_string(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '' and w not in {in_list(text.FILLERS)}), ' '))"


def stripped(u: str) -> str:
    front = f"split_part({u}, '#', 1)"
    fragment = f"case when strpos({u}, '#') > 0 then regexp_replace(substring({u}, strpos({u}, '#')), '(?i)#*(utm-|ref=|trk=).*', '') else '' end"
    query = f"case when strpos({front}, '?') > 0 then substring({front}, strpos({front}, '?') + 1) else '' end"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: lower(split_part(p, '=', 1)) not in {in_list(text.TRACKING)}), '&')"
    return f"(split_part({front}, '?', 1) || case when {kept} <> '' then '?' || {kept} else '' end || case when ({fragment}) not in ('', '#') then ({fragment}) else '' end)"


def tokens(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: case when length(w) > 5 and ends_with(w, 'ing') then left(w, length(w) - 3) when length(w) > 5 and ends_with(w, 's') then left(w, length(w) - 1) else w end)"


def padded(c: str) -> str:
    return f"(' ' || array_to_string({tokens(c)}, ' ') || ' ')"


def first_hit(t: str, tiers, value: str, anchored: bool = False) -> str:
    """CASE over the keywords in order; value: points or keyword."""
    arms = []
    for _, points, keywords in tiers:
        for kw in keywords:
            words = text.stems(kw)
            phrase = quoted(f" {' '.join(words)} ")
            test = f"starts_with({t}, {phrase})" if anchored and len(words) == 1 else f"contains({t}, {phrase})"
            arms.append(f"when {test} then {points if value == 'points' else quoted(kw)}")
    return "(case " + " ".join(arms) + (" else 0" if value == "points" else "") + " end)"


def label(s: str) -> str:
    return "(case " + " ".join(f"when {s} >= {least} then '{name}'" for name, least in scoring.LABELS) + " end)"


def seasons(t: str) -> str:
    t = f"lower({t})"
    name = lambda m: f"case regexp_extract({m}, '({extract.SEASONS})', 1) when 'autumn' then 'fall' else regexp_extract({m}, '({extract.SEASONS})', 1) end"
    year = lambda d: f"case when length(replace({d}, '''', '')) = 2 then '20' else '' end || replace({d}, '''', '')"
    in_pair = "regexp_extract(m, '(20\\d{2}|\\d{2})', 1)"
    in_run = "regexp_extract(m, '(20\\d{2}|''?\\d{2})$', 1)"
    pairs = f"list_transform(regexp_extract_all({t}, {quoted(extract.SEASON_YEAR)}), lambda m: {name('m')} || '-' || {year(in_pair)})"
    runs = f"flatten(list_transform(regexp_extract_all({t}, {quoted(extract.SEASON_RUN)}), lambda m: list_transform(regexp_extract_all(m, '{extract.SEASONS}'), lambda s: case s when 'autumn' then 'fall' else s end || '-' || {year(in_run)})))"
    both = f"list_sort(list_distinct(list_concat({pairs}, {runs})))"
    bare = f"regexp_extract({t}, '\\b(202\\d)\\b', 1)"
    return f"(case when len({both}) > 0 then {both} when {bare} <> '' then ['year-' || {bare}] else [] end)"


def with_default(s: str) -> str:
    return f"(case when len({s}) = 0 then ['{DEFAULT_SEASON}'] else list_sort(list_distinct(list_transform({s}, lambda t: case when starts_with(t, 'year-') then 'summer-' || substring(t, 6, 4) else t end))) end)"


def expired(s: str) -> str:
    index = "try_cast(split_part(t, '-', 2) as int) * 4 + case split_part(t, '-', 1) when 'winter' then 0 when 'spring' then 1 when 'summer' then 2 when 'fall' then 3 end"
    return f"coalesce(list_max(list_transform({s}, lambda t: {index})) < {CURRENT}, false)"


def place_class(c: str) -> str:
    codes = [x for two, three, _ in location.COUNTRIES for x in (two, three)]
    names = [n for _, _, all_ in location.COUNTRIES for n in all_.split("|")]
    t = f"trim(lower({c}))"
    parts = f"list_filter(list_transform(regexp_split_to_array({t}, '[,\\-|·/]'), lambda p: trim(p)), lambda p: p <> '')"
    words = f"list_filter(regexp_split_to_array(array_to_string({parts}, ' '), '\\s+'), lambda w: w <> '')"
    some = lambda a, v: f"list_has_any({a}, {array(v)})"
    inside = lambda v: f"regexp_matches({t}, {quoted('|'.join(x.replace('.', chr(92) + '.') for x in v))})"
    us = location.US_NAMES + location.STATE_NAMES
    return f"""(case when {t} = '' then 'unknown'
        when {some(parts, us)} or {some(words, us)} or regexp_matches({t}, '(^|[^a-z0-9_])united states([^a-z0-9_]|$)') then 'us'
        when len({parts}) >= 3 and list_contains({array(codes)}, {parts}[-1]) then 'non_us'
        when len({parts}) >= 2 and list_contains({array(codes)}, {parts}[1]) and ({some(parts + '[2:]', location.FOREIGN_CITIES)} or (len({parts}) >= 3 and length({parts}[1]) <= 3 and length({parts}[2]) <= 3)) then 'non_us'
        when {some(parts, location.STATE_CODES)} then 'us'
        when {some(parts, codes + names)} then 'non_us'
        when {some(parts, location.US_CITIES)} or {some(words, location.US_CITIES)} or {inside([x for x in location.US_CITIES if len(x) >= 5])} then 'us'
        when {inside([x for x in names if len(x) >= 5])} or {inside(location.FOREIGN_CITIES)} then 'non_us'
        else 'unknown' end)"""


def any_of(c: str, fragments) -> str:
    return "(" + " or ".join(f"contains({c}, {quoted(f)})" for f in fragments) + ")"


def intern(c: str) -> str:
    return f"regexp_matches(lower({c}), '(^|[^a-z0-9_])(intern(ship)?|co-?op)([^a-z0-9_]|$)')"


def reason(title: str, place: str, klass: str, season: str) -> str:
    t, both = f"lower({title})", f"(lower({title}) || ' ' || lower({place}))"
    return f"""(case when {klass} = 'non_us' then 'non_us' when not {intern(title)} then 'not_intern'
        when {any_of(t, rules.RESEARCH)} or {any_of(t, rules.NON_SWE)} then 'non_swe' when {any_of(both, rules.DEGREE)} then 'phd_required'
        when not {any_of(t, rules.CS_STEMS)} and not regexp_matches({t}, '(^|[^a-z0-9_])(sde|swe|ml|ai|cs)([^a-z0-9_]|$)') then 'non_swe'
        when {any_of(both, rules.CLOSED)} then 'closed' when {expired(season)} then 'expired_season' end)"""


def salary(c: str) -> tuple[str, str, str, str]:
    """text, min, max, unit."""
    flat = f"regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g')"
    arms = {k: [] for k in ("text", "min", "max", "unit")}
    for pattern, two, unit, factor in extract.PAY_PATTERNS:
        g = lambda n: f"try_cast(replace(regexp_extract({flat}, {quoted('(?i)' + pattern)}, {n}), ',', '') as double)"  # noqa: E731, B023
        low, high = g(1), f"coalesce({g(2)}, {g(1)})" if two else g(1)
        a, b = f"least({low}, {high}) * {factor}", f"greatest({low}, {high}) * {factor}"
        least, most = extract.PLAUSIBLE[unit]
        ok = f"{a} >= {least} and {b} <= {most}"
        for k, v in (("text", f"trim(regexp_extract({flat}, {quoted('(?i)' + pattern)}, 0))"), ("min", a), ("max", b), ("unit", quoted(unit))):
            arms[k].append(f"when {ok} then {v}")
    veto = f"regexp_matches({c}, {quoted(extract.UNPAID)})"
    return tuple(f"(case when {veto} then null {' '.join(arms[k])} end)" for k in ("text", "min", "max", "unit"))


def raw() -> str:
    """`with` and the CTEs up to p, the derived postings."""
    return f"with {postings_cte()}, p as (select * from postings)"


def enriched() -> str:
    """`with` and the CTEs up to e: p with canonical company, key, scores, seasons, location class and exclusion reason."""
    matched = "list_distinct(list_filter([role_kw, company_kw, location_kw], lambda x: x is not null))"
    return f"""{raw()},
        c as (select p.* exclude (company), company as raw_company, {canon('company')} as company from p),
        t as (select *, {padded('title')} as tt, {padded('company')} as ct, {padded('location')} as lt, {stripped('link')} as stripped, {key('company', 'title')} as normalized_key,
                     {seasons('title')} as tokens, {place_class('location')} as location_class from c),
        h as (select *, {with_default('tokens')} as season, {first_hit('tt', scoring.ROLE, 'points')} as role_points, {first_hit('tt', scoring.ROLE, 'keyword')} as role_kw,
                     {first_hit('ct', scoring.COMPANY, 'points', True)} as company_points, {first_hit('ct', scoring.COMPANY, 'keyword', True)} as company_kw,
                     {first_hit('lt', scoring.LOCATION, 'points')} as location_points, {first_hit('lt', scoring.LOCATION, 'keyword')} as location_kw from t),
        s as (select *, least(role_points + company_points + location_points, 100) as score, {matched} as matched from h),
        e as (select *, {label('score')} as score_label, {reason('title', 'location', 'location_class', 'season')} as exclusion_reason from s)"""
