"""Registered queries over the supplied tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import oracles as O
from siftwell.functions import extract, text
from siftwell.operators import dedup, facets, rules, scoring, shared, state
from siftwell.operators.location import with_location_class
from siftwell.plans import ingest
from siftwell.sources import payloads
from siftwell.sources.fixtures import postings, postings_of, table
from siftwell.streaming import jobs
from siftwell.streaming.store import PartedTable

AS_OF = datetime.datetime(2026, 6, 5, tzinfo=datetime.timezone.utc)
#: The events' clock.
EVENTS_AS_OF = datetime.datetime(2024, 1, 30, tzinfo=datetime.timezone.utc)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.enriched(postings(spark, sf), AS_OF)


def when(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _decoded(c: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


def _at(t: str, pattern: str) -> str:
    """Place of the first match, 0 without one."""
    return f"case when regexp_matches({t}, {O.quoted(pattern)}) then length(regexp_extract({t}, {O.quoted('(?s)^(.*?)(?:' + pattern + ')')}, 1)) + 1 else 0 end"


def _trimmed(source: str, columns: str) -> str:
    """CTEs that trim description t of a table and give `columns` and after."""
    opener = r"(?i)\b(who we are|about (us|the company|the team)|our (mission|story|company)|company overview|founded in|we are a)\b"
    heading = r"(?i:the role|about the role|job summary|job description|position summary|position overview|team overview|responsibilities|what you.ll do|your role)"
    tail = r"(?i:equal opportunity|eeo statement|reasonable accommodation|benefits include)|WHAT WE OFFER|COMPENSATION|BENEFITS"
    return f"""t1 as (select {columns}, t, {_at('t', heading)} as h, regexp_matches(left(t, 250), {O.quoted(opener)}) as o from {source}),
        t2 as (select {columns}, case when o and h between 201 and 1801 then substring(t, h) else t end as t from t1),
        t3 as (select {columns}, t, {_at('t', tail)} as e from t2),
        t4 as (select {columns}, case when e > 300 then rtrim(left(t, e - 1)) else trim(t) end as t from t3),
        t5 as (select {columns}, t, length(regexp_extract(right(left(t, 2000), 200), '(?s)^(.*[.!?])(\\s|$)', 1)) as n from t4),
        trimmed as (select {columns}, case when length(t) <= 2000 then t when n > 0 then left(t, 1800 + n) else left(t, 2000) end as after from t5)"""


def _plain(c: str) -> str:
    """Text without markdown."""
    c = _decoded(c)
    for pattern, to in ((r"\\([\\`*_{}\[\]()#+\-.!|>~&])", "\\1"), (r"!?\[([^\]]*)\]\([^)]*\)", "\\1"), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"\*\*|__|`", ""), (r"[ \t]+", " ")):
        c = f"regexp_replace({c}, {O.quoted(pattern)}, {O.quoted(to)}, 'g')"
    return f"trim(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.top_new(postings(spark, sf).where("not stored and not archived"), AS_OF)


R, E = O.raw(), O.enriched()


@query(f"""{E}, n as (select *, row_number() over (partition by normalized_key order by seq) as rn from e where not stored and not archived and exclusion_reason is null)
    select id, title, company, location, score, score_label from n where rn = 1 order by score desc, id limit 10""")
def top_new_postings(spark, sf):
    return flagship(spark, sf)


# --- scans, list reads, projections -----------------------------------------------------------


@query(f"{R} select id, seq, cast(seen_at as varchar) as seen_at from p")
def s1_read_newest_first(spark, sf):
    return postings(spark, sf).orderBy(F.desc("seen_at"), "id").select("id", "seq", when("seen_at"))


@query(f"{E} select id, seq, score from e where not archived and not hidden and lower(source) in ('greenhouse', 'lever') and score >= 40 and (contains(lower(title), 'engineer') or contains(lower(company), 'engineer') or contains(lower(location), 'engineer'))")
def f1_list_predicates(spark, sf):
    return enriched(spark, sf).where(rules.list_predicate(sources=["Greenhouse", "LEVER"], least_score=40, query="Engineer")).select("id", "seq", "score")


@query(f"{E} select id, title, company, location, link, source, score, score_label, applied, hidden, archived from e")
def p2_list_fields(spark, sf):
    return facets.list_fields(enriched(spark, sf)).drop("posted_at", "seen_at", "matched_keywords")


@query(f"{E} select seq, company, stripped, normalized_key, score, score_label, array_to_string(season, ',') as season from e")
def p3_enrichment(spark, sf):
    return enriched(spark, sf).select("seq", "company", "stripped", "normalized_key", "score", "score_label", F.array_join("season", ",").alias("season"))


@query(f"{R} select seq, trim(regexp_replace(company, '[\\x{{1F300}}-\\x{{1F64F}}]\\s*', '', 'g')) as company, cast(case when seq % 2 = 0 then posted_at else seen_at end as varchar) as posted_at from p")
def p1_built_rows(spark, sf):
    seeds = postings(spark, sf).withColumns({"upstream_posted_at": F.when(F.col("seq") % 2 == 0, F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("5 days ago"), "description": F.lit(" "), "description_html": F.lit(None).cast("string")})
    return payloads.built_rows(seeds).select("seq", "company", when("posted_at"))


@query(f"{E} select seq, location_class from e")
def f4_location_class(spark, sf):
    return with_location_class(postings(spark, sf)).select("seq", "location_class")


@query(f"{E} select seq, exclusion_reason, exclusion_reason is null as passed from e")
def f2_hard_filter(spark, sf):
    return rules.hard_filtered(postings(spark, sf), AS_OF).select("seq", "exclusion_reason", "passed")


@query(f"{E} select exclusion_reason, count(*) as n from e where exclusion_reason is not null group by 1")
def f3_a2_excluded_by_reason(spark, sf):
    return facets.by_reason(rules.hard_filtered(postings(spark, sf), AS_OF))


@query(f"""{E} select seq from e where company_points >= 45 and list_has_any(tokens, ['summer-2026', 'fall-2026']) and not applied and not hidden and source <> 'Indeed' and score >= 50
    and posted_at >= timestamp '2024-01-01 00:00:00' and not list_contains(matched, 'devops')""")
def f5_filter_spec(spark, sf):
    spec = rules.FilterSpec(tier="top-or-better", seasons=("summer-2026", "fall-2026"), applied=False, exclude_hidden=True, exclude_sources=("Indeed",), least_score=50, posted_after=datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), exclude_keywords=("DevOps",))
    return enriched(spark, sf).where(spec.predicate()).select("seq")


@query(f"{R} select seq from p where contains(lower(company || ' ' || title || ' ' || location), 'stripe') or contains(lower(location), 'seattle') or contains(lower(location), 'remote')")
def f6_free_text(spark, sf):
    return postings(spark, sf).where(rules.free_text("Stripe", ("Seattle", "Remote"))).select("seq")


@query(f"{E} select seq from e where location_class <> 'non_us' and score >= 60")
def f7_alert_filter(spark, sf):
    return enriched(spark, sf).where(rules.alert_filter(rules.FilterSpec(least_score=60))).select("seq")


@query(f"{R} select seq from p where {O.intern('title')}")
def f8_intern_titles(spark, sf):
    return postings(spark, sf).where(F.col("title").rlike(rules.INTERN)).select("seq")


@query("select page_id, regexp_matches(lower(regexp_extract(url, '://([^/?#]+)', 1)), '(^|\\.)(example\\.org|example\\.net)$') as aggregator from pages")
def f9_aggregator_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.aggregator_link(F.col("url"), ["example.org", "example.net"]).alias("aggregator"))


@query("select page_id, regexp_matches(lower(url), 'example\\.org|[?&](redirect|redirect_url|url|dest|target)=|click\\?') as redirect from pages")
def f9b_redirect_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.redirect_link(F.col("url"), ["example.org"]).alias("redirect"))


@query(f"{E} select seq, case company_points when 70 then 1 when 45 then 2 when 20 then 3 else 0 end as tier from e")
def f10_tier_rank(spark, sf):
    return enriched(spark, sf).select("seq", F.coalesce(scoring.tier_rank(F.col("company")), F.lit(0)).alias("tier"))


def _role_sql(role: str) -> str:
    test = " or ".join(f"contains(lower(k), {O.quoted(w)}) or contains({O.quoted(w)}, lower(k))" for w in rules.ROLES[role])
    return f"len(list_filter(matched, lambda k: {test})) > 0"


@query(f"{E} select seq from e where {_role_sql('ai-ml')} or {_role_sql('security')}")
def f11_roles(spark, sf):
    return enriched(spark, sf).where(rules.FilterSpec(roles=("ai-ml", "security")).predicate()).select("seq")


@query(f"{E} select seq, {O.expired('season')} as expired from e")
def f12_expired_season(spark, sf):
    return enriched(spark, sf).select("seq", extract.expired(F.col("season"), AS_OF).alias("expired"))


@query(f"{R} select days, count(*) as n from p, (values (1), (3), (7), (30), (90)) as w(days) where posted_at >= {O.AS_OF} - days * interval 1 day group by 1")
def f13_date_windows(spark, sf):
    rows = postings(spark, sf)
    return rows.agg(*[F.count_if(rules.in_window(AS_OF, d)).alias(str(d)) for d in (1, 3, 7, 30, 90)]).select(F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.col(str(d)).alias("n")) for d in (1, 3, 7, 30, 90)])).alias("r")).select("r.*")


@query(f"{R} select seq from p where regexp_matches(pay, '\\$\\d|/hr\\b|\\bUnpaid\\b') or pay = company")
def f14_corrupted_rows(spark, sf):
    return postings(spark, sf).withColumn("title", F.col("pay")).where(rules.corrupted()).select("seq")


@query(f"{R} select seq, case when seq % 50 = 0 then 'test_source' when seq % 49 = 0 then 'no_company' end as drop_reason from p")
def f15_placeholder_rows(spark, sf):
    rows = postings(spark, sf).withColumns({"source": F.when(F.col("seq") % 50 == 0, "TEST").otherwise(F.col("source")), "company": F.when(F.col("seq") % 49 == 0, "NaN").otherwise(F.col("company"))})
    return rows.select("seq", rules.placeholder_reason().alias("drop_reason"))


@query("select c_custkey, (length(n) not between 2 and 60 or regexp_matches(n, '^[\\W_]+$|[<>{}|]|https?:') or length(regexp_replace(n, '[^A-Za-z]', '', 'g')) < 2) as junk from (select c_custkey, case when c_custkey % 7 = 0 then '<b>' || c_name when c_custkey % 5 = 0 then '1234' else c_name end as n from customer)")
def f16_junk_names(spark, sf):
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("<b>"), "c_name")).when(F.col("c_custkey") % 5 == 0, "1234").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", rules.junk_name(name).alias("junk"))


@query(f"{R} select seq, posted_at < {O.AS_OF} - interval 30 day as stale from p")
def f17_stale(spark, sf):
    return postings(spark, sf).select("seq", rules.stale(AS_OF).alias("stale"))


@query("""select event_id, case event_type when 'purchase' then case when value < 50 then 'not_boolean' end when 'error' then null when 'view' then case when event_id % 2 = 0 then 'not_a_url' end
    when 'click' then case when event_id % 3 = 0 then 'not_a_time' end else 'unknown_field' end as error_field from events""")
def f18_change_errors(spark, sf):
    t, i = F.col("event_type"), F.col("event_id")
    rows = table(spark, sf, "events").withColumns({
        "field": F.when(t == "purchase", "applied").when(t == "error", "hidden").when(t == "view", "application_url").when(t == "click", "applied_at").otherwise("colour"),
        "value": F.when(t == "purchase", F.when(F.col("value") < 50, "maybe").otherwise("true")).when(t == "error", "false").when(t == "view", F.when(i % 2 == 0, "ftp:x").otherwise("https://a.example/x")).when(t == "click", F.when(i % 3 == 0, "soon").otherwise("2024-01-02T03:04:05Z")),
    })
    return rows.select("event_id", rules.change_error().alias("error_field"))


STATUS = "case cast(floor(abs(value)) as bigint) % 6 when 0 then 200 when 1 then 404 when 2 then 410 when 3 then 503 when 4 then -1 else 302 end"


@query(f"select event_id, case when s = -1 then 'error' when s in (401, 404, 410, 451) then 'permanent' when s >= 400 then 'transient' else 'ok' end as verdict from (select event_id, {STATUS} as s from events)")
def f19_link_verdicts(spark, sf):
    return table(spark, sf, "events").select("event_id", rules.link_verdict(F.expr(STATUS)).alias("verdict"))


# --- joins and de-duplication ---------------------------------------------------------------


def split(spark, sf, whole: bool = False):
    """(stored, incoming) postings with keys; incoming rows come later than the stored ones."""
    rows = enriched(spark, sf) if whole else dedup.with_keys(postings(spark, sf))
    return rows.where("stored"), rows.where("not stored")


K = f"{E}, st as (select * from e where stored), inc as (select * from e where not stored)"


@query(f"{K} select seq, exists(select 1 from st where st.id = inc.id) as known from inc")
def j1_known_ids(spark, sf):
    st, inc = split(spark, sf)
    known, new = dedup.known_ids(inc, st)
    return known.select("seq", F.lit(True).alias("known")).unionByName(new.select("seq", F.lit(False).alias("known")))


@query(f"{K} select seq from inc where not exists(select 1 from st where st.stripped = inc.stripped and not st.archived)")
def j2_unseen_links(spark, sf):
    st, inc = split(spark, sf)
    return dedup.unseen_links(inc, st).select("seq")


@query(f"{K} select seq, (select min(id) from st where st.normalized_key = inc.normalized_key and not st.archived) as owner_id from inc where normalized_key in (select normalized_key from st where not archived)")
def j3_known_keys(spark, sf):
    st, inc = split(spark, sf)
    return dedup.known_keys(inc, st).select("seq", "owner_id")


def _greedy(free: str) -> str:
    """CTEs that settle the rows (seq, link, key, owner_link) of a table in arrival order, one after the other: settled(seq, outcome, upgrade).

    Only rows that share a link or a key with another one are walked through. The state are the blocked links, the keys that
    the batch owns, those of them whose owner has a wrapper for a link, and the keys whose owner got a direct one.
    """
    blocked, held = "list_contains(links, link)", "list_contains(keys, key)"
    keep = f"not {blocked} and not owned and not {held}"
    upgrade = f"not {blocked} and direct and not list_contains(freed, key) and (wrapped or list_contains(wrapping, key))"
    return f"""f as (select seq, case when link = '' then 'seq:' || seq else link end as link, key, owner_link is not null as owned, coalesce(contains(owner_link, 'simplify.jobs'), false) as wrapped,
                  link <> '' and not contains(link, 'simplify.jobs') as direct, contains(link, 'simplify.jobs') as wraps from {free}),
        m as (select *, count(*) over (partition by link) > 1 or count(*) over (partition by key) > 1 as met from f),
        o as (select *, row_number() over (order by seq) as n from m where met),
        g as (select cast(0 as bigint) as n, cast(null as bigint) as seq, cast(null as varchar) as outcome, false as upgrade, cast([] as varchar[]) as links, cast([] as varchar[]) as keys, cast([] as varchar[]) as wrapping, cast([] as varchar[]) as freed
              union all
              select o.n, o.seq, case when {blocked} then 'same_link' when owned then 'known_key' when {held} then 'same_key' else 'keep' end, {upgrade},
                     case when ({keep}) or ({upgrade}) then list_append(links, link) else links end,
                     case when {keep} then list_append(keys, key) else keys end,
                     case when {keep} and wraps then list_append(wrapping, key) else wrapping end,
                     case when {upgrade} then list_append(freed, key) else freed end
              from g join o on o.n = g.n + 1),
        settled as (select seq, outcome, upgrade from g where n > 0 union all select seq, case when owned then 'known_key' else 'keep' end, wrapped and direct from m where not met)"""


K_ALL = "with recursive " + K.removeprefix("with ")


@query(f"{K_ALL}, free as (select seq, stripped as link, normalized_key as key, cast(null as varchar) as owner_link from inc), {_greedy('free')} select seq, outcome from settled")
def j4_batch_outcome(spark, sf):
    """Greedy over two keys in arrival order; tested against a sequential version."""
    _, inc = split(spark, sf)
    return dedup.batch_outcome(inc)


SETTLED = f"""{K_ALL}, owner as (select normalized_key, min(id) as owner_id, arg_min(link, id) as owner_link from st where not archived group by 1), w as (
        select seq, inc.id, stripped, inc.normalized_key, owner_id, owner_link,
               case when exclusion_reason is not null then exclusion_reason when exists(select 1 from st where st.id = inc.id) then 'refresh'
                    when stripped <> '' and exists(select 1 from st where st.stripped = inc.stripped and not st.archived) then 'known_link' end as outcome from inc left join owner on owner.normalized_key = inc.normalized_key),
    free as (select seq, stripped as link, normalized_key as key, owner_link from w where outcome is null), {_greedy('free')}"""


@query(f"{SETTLED} select seq, outcome from w where outcome is not null union all select seq, outcome from settled")
def j1_j4_ingest_outcomes(spark, sf):
    st, inc = split(spark, sf, whole=True)
    return ingest.ingest(st, inc, AS_OF)[0]


@query(f"""{R}, scan as (select distinct source, location as target, id as job_id from p where seq % 5 <> 0 and location <> '' and location not like 'Remote%'),
    t as (select distinct source, target from scan)
    select distinct seq from p join t on p.source = t.source and p.location = t.target where not archived and not exists(select 1 from scan where scan.source = p.source and scan.target = p.location and scan.job_id = p.id)""")
def j5_disappeared(spark, sf):
    rows = postings(spark, sf).withColumns({"target": F.col("location"), "job_id": F.col("id")})
    scan = rows.where("seq % 5 <> 0 and location <> '' and location not like 'Remote%'").select("source", "target", "job_id")
    return state.disappeared(rows, scan).select("seq")


@query(f"{E} select seq, role_points, company_points, location_points, score, score_label, array_to_string(list_sort(matched), ',') as keywords from e")
def j7_scores(spark, sf):
    return enriched(spark, sf).select("seq", "role_points", "company_points", "location_points", "score", "score_label", F.array_join(F.array_sort("matched_keywords"), ",").alias("keywords"))


@query(f"""{R}, h as (select 'p' || cast(event_id as varchar) as id, max(ts) as checked from events group by 1)
    select seq from p left join h using (id) where not archived and source = 'Linkedin' and (checked is null or checked < timestamp '2024-01-23 00:00:00')""")
def j8_due_for_check(spark, sf):
    history = events(spark, sf).select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("checked_at"))
    return state.due_for_check(postings(spark, sf), history, "Linkedin", EVENTS_AS_OF).select("seq")


HEALTH = "h as (select event_type as source, count(*) as total, count(*) filter (ts >= timestamp '2024-01-29 00:00:00') as last_24h, count(*) filter (ts >= timestamp '2024-01-23 00:00:00') as last_7d, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen from events group by 1)"


@query(f"with {HEALTH}, c as (select source, count(*) as raw, count(*) filter (not stored) as net_new from ({R} select * from p) group by 1) select coalesce(h.source, c.source) as source, coalesce(total, 0) as total, coalesce(last_24h, 0) as last_24h, coalesce(last_7d, 0) as last_7d, coalesce(raw, 0) as raw, coalesce(net_new, 0) as net_new from h full join c on h.source = c.source")
def j9_health_with_cycle(spark, sf):
    log = events(spark, sf).select(F.col("event_type").alias("source"), F.col("ts").alias("seen_at"))
    cycle = facets.source_counts(postings(spark, sf).withColumn("is_new", ~F.col("stored")))
    return facets.health_with_cycle(facets.source_health(log, EVENTS_AS_OF), cycle)


@query("""with k as (select distinct 'slug' || cast(s_suppkey as varchar) as slug, 'lever' as ats from supplier where s_suppkey % 2 = 0), f as (select distinct 'slug' || cast(p_partkey % 150 as varchar) as slug, 'lever' as ats from part)
    select coalesce(k.slug, f.slug) as slug, coalesce(k.ats, f.ats) as ats, case when k.slug is null then 'added' else 'kept' end as status from k full join f on k.slug = f.slug where coalesce(k.slug, f.slug) not in ('slug2', 'slug3')""")
def j11_discovered_targets(spark, sf):
    known = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.lit("lever").alias("ats"), F.concat(F.lit("slug"), F.col("s_suppkey").cast("string")).alias("slug"), F.lit(None).cast("string").alias("board"))
    found = table(spark, sf, "part").select(F.lit("lever").alias("ats"), F.concat(F.lit("slug"), (F.col("p_partkey") % 150).cast("string")).alias("slug"), F.lit(None).cast("string").alias("board"))
    denied = table(spark, sf, "region").where("r_regionkey in (2, 3)").select(F.concat(F.lit("slug"), F.col("r_regionkey").cast("string")).alias("slug"))
    return state.discovered_targets(known, found, denied).select("slug", "ats", "status")


@query("select distinct 'lever' as ats, 's' || cast(p_partkey % 900 as varchar) as slug from part where 's' || cast(p_partkey % 900 as varchar) not in (select 's' || cast(s_suppkey as varchar) from supplier)")
def j12_new_candidates(spark, sf):
    mined = table(spark, sf, "part").select(F.lit("lever").alias("ats"), F.concat(F.lit("s"), (F.col("p_partkey") % 900).cast("string")).alias("slug"))
    return state.new_candidates(mined, table(spark, sf, "supplier").select(F.lit("lever").alias("ats"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug")))


CHECKS = f"k as (select 'p' || cast(event_id as varchar) as id, {STATUS} as status, ts from events)"


@query(f"{R}, {CHECKS} select seq from p left join k using (id) where coalesce(status, 0) not in (404, 410)")
def j13_live_links(spark, sf):
    return state.live_links(postings(spark, sf), checks(spark, sf)).select("seq")


def checks(spark, sf):
    return events(spark, sf).select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"), F.expr(STATUS).alias("status"), F.col("ts").alias("checked_at"))


@query(f"{R}, {CHECKS}, v as (select p.*, case when status is null then null when link like '%simplify.jobs%' then 'aggregator' when status = -1 then 'error' when status in (404, 410) then 'permanent' when status >= 400 then 'transient' else 'ok' end as verdict from p left join k using (id)) select seq, verdict, case when verdict in ('aggregator', 'permanent') then true when verdict = 'ok' and failed_check_count > 0 then false else archived end as archived, case when verdict in ('aggregator', 'permanent') then 2 when verdict = 'ok' then 0 else failed_check_count end as failed_check_count from v")
def m5_checked_links(spark, sf):
    return state.checked_links(postings(spark, sf), checks(spark, sf)).select("seq", "verdict", "archived", "failed_check_count")


@query(f"""{K}, n as (select id, max(seq) as seq from inc group by id), g as (select n.id, inc.score, inc.seen_at from n join inc on inc.id = n.id and inc.seq = n.seq)
    select st.seq, coalesce(cast(g.seen_at as varchar), cast(st.seen_at as varchar)) as seen_at, case when g.id is null then st.score else g.score end as score, case when g.id is not null and st.failed_check_count = 0 then false else st.archived end as archived from st left join g on g.id = st.id""")
def m1_backfill(spark, sf):
    st, inc = split(spark, sf, whole=True)
    return dedup.backfill(st, inc).select("seq", when("seen_at"), "score", "archived")


@query(f"""{SETTLED}, own as (select normalized_key, id from settled join w using (seq) where settled.outcome = 'keep')
    select coalesce(owner_id, own.id) as owner_id, stripped as link from settled join w using (seq) left join own using (normalized_key) where upgrade""")
def m2_link_upgrades(spark, sf):
    """The new links of owners, stored ones and those of the batch, where a link that was brought blocks later rows."""
    st, inc = split(spark, sf, whole=True)
    passed = rules.hard_filtered(inc, AS_OF).where("passed").select("seq", "id", "stripped", "normalized_key")
    fate = ingest.fates(st.select(*ingest.NARROW), passed)
    return fate.where("new_link is not null").select(F.col("target").alias("owner_id"), F.col("new_link").alias("link"))


@query(f"""{R}, ch as (select 'p' || cast(user_id * 3 as varchar) as id, event_type, ts, event_id from events where event_type in ('purchase', 'error')), l as (select id, max(case when event_type = 'purchase' then 1 end) as bought, max(case when event_type = 'error' then 1 end) as failed from ch group by id)
    select seq, case when bought = 1 then true else applied end as applied, case when failed = 1 then true else hidden end as hidden from p left join l using (id)""")
def m3_patched(spark, sf):
    feed = events(spark, sf).where("event_type in ('purchase', 'error')").select(F.concat(F.lit("p"), (F.col("user_id") * 3).cast("string")).alias("id"), F.when(F.col("event_type") == "purchase", "applied").otherwise("hidden").alias("field"), F.lit("true").alias("value"), "ts")
    return state.patched(postings(spark, sf), feed).select("seq", "applied", "hidden")


@query(f"{E} select seq, archived or seen_at < {O.AS_OF} - interval 30 day as by_age, archived or {O.expired('season')} as by_season from e")
def m4_archived(spark, sf):
    rows = postings(spark, sf)
    by_season = state.archived_by_season(rows, AS_OF).select("seq", F.col("archived").alias("by_season"))
    return state.archived_by_age(rows, AS_OF).select("seq", F.col("archived").alias("by_age")).join(by_season, "seq")


@query(f"{E} select old, score_label as new, count(*) as n, old is distinct from score_label as changed from (select *, case when seq % 4 = 0 then null else {O.label('role_points')} end as old from e) group by 1, 2")
def m6_a22_rescored(spark, sf):
    rows = enriched(spark, sf).withColumn("id", F.col("seq"))
    before = rows.select("id", F.when(F.col("seq") % 4 != 0, scoring.label(F.col("role_points"))).alias("score_label"))
    return facets.change_report(before, rows, "score_label")


@query(f"""{E}, u as (select id, max(seq) as seq from e group by id), r as (select *, row_number() over (partition by normalized_key order by (applied or hidden) desc, score desc, seen_at desc, id, seq) as rn, count(*) over (partition by normalized_key) as n from e where normalized_key not like '%::' and id in (select id from u where u.seq = e.seq))
    select id, normalized_key, case when rn = 1 then 'keep' else 'delete' end as action from r where n > 1""")
def m7_w2_collapse_plan(spark, sf):
    # one row of each id, the last, as the store has it
    return dedup.collapse_plan(dedup.first_seen(enriched(spark, sf), ["id"], last=True))


@query("select page_id as id, url as before, after from (select page_id, url, " + O.stripped("url") + " as after from pages) where url <> after")
def m8_x5_link_plan(spark, sf):
    return state.link_plan(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("link")))


@query("with s as (select doc_id as id, text as before, " + _plain("coalesce(text, '')") + " as t, source from documents), " + _trimmed("s", "id, before, source") + """,
    a as (select *, case when upper(source) = 'TEST' then 'delete' when before is null then null when length(after) < 50 then 'clear' when after <> before then 'update' end as action from trimmed)
    select id, action, case when action = 'update' then after end as after from a where action is not null""")
def m9_description_plan(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"), "source", F.lit("x").alias("company"))
    return state.description_plan(rows)


@query(f"{R} select seq from p where not regexp_matches(pay, '\\$\\d|/hr\\b|\\bUnpaid\\b')")
def m11_without_corrupted(spark, sf):
    return state.without_rows(postings(spark, sf).withColumn("title", F.col("pay")), F.col("title").rlike(r"\$\d|/hr\b|\bUnpaid\b")).select("seq")


@query("select 'archived' as name, cast(0 as bigint) as \"left\", true as settled")
def m12_fixpoint(spark, sf):
    done = state.archived_by_age(postings(spark, sf), AS_OF)
    return state.fixpoint(done, "archived", ~F.col("archived") & rules.stale(AS_OF) & (F.col("seen_at") < F.lit(AS_OF) - F.expr("interval 30 days")))


# --- aggregations -------------------------------------------------------------------------


@query(f"{E}, l as (select *, case when seq % 5 = 0 then 'unscored' else score_label end as lab from e) select 'total' as kind, '' as name, count(*) as n, cast(max(seen_at) as varchar) as newest from l union all select 'source', source, count(*), cast(max(seen_at) as varchar) from l group by source union all select 'label', lab, count(*), cast(max(seen_at) as varchar) from l group by lab")
def a1_stats(spark, sf):
    return facets.stats(enriched(spark, sf).withColumn("score_label", F.when(F.col("seq") % 5 != 0, F.col("score_label")))).withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query(f"{R} select source, count(*) as raw, count(*) filter (not stored) as net_new from p group by 1")
def a3_source_counts(spark, sf):
    return facets.source_counts(postings(spark, sf).withColumn("is_new", ~F.col("stored")))


@query(f"with {HEALTH} select *, last_24h = 0 and last_7d > 0 as quiet from h")
def a4_source_health(spark, sf):
    log = events(spark, sf).select(F.col("event_type").alias("source"), F.col("ts").alias("seen_at"))
    return facets.source_health(log, EVENTS_AS_OF).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query(f"{E} select token, count(*) as n from (select unnest(tokens) as token from e where not archived) group by 1")
def a5_season_facet(spark, sf):
    return facets.season_facet(postings(spark, sf).where("not archived"))


@query(f"{R} select count(*) as all_rows, count(*) filter (applied) as applied_rows, count(*) filter (not applied) as open_rows from p")
def a6_tab_counts(spark, sf):
    return facets.tab_counts(postings(spark, sf))


@query(f"{E} select distinct lower(k) as keyword from (select unnest(matched) as k from e)")
def a7_keywords(spark, sf):
    return facets.keyword_set(enriched(spark, sf))


@query(f"{E} " + " union all ".join(f"select '{r}' as role, count(*) as n from e where {_role_sql(r)} having count(*) > 0" for r in rules.ROLES))
def a8_role_counts(spark, sf):
    return facets.role_counts(enriched(spark, sf))


@query(f"{R} select count(*) filter (hidden) as hidden_rows from p")
def a9_hidden(spark, sf):
    return facets.hidden_count(postings(spark, sf))


@query(f"""{E}, g as (select lower(trim(raw_company)) as group_key, trim(raw_company) as nm, count(*) as n, sum(score) as pts, count(*) filter (applied) as ap, max(posted_at) as nw from e group by 1, 2),
    r as (select *, row_number() over (partition by group_key order by n desc, length(regexp_replace(nm, '[^A-Z]', '', 'g')), nm) as rn from g)
    select group_key, max(case when rn = 1 then nm end) as company, cast(sum(n) as bigint) as postings, cast(round(sum(pts) / sum(n)) as int) as mean_score, cast(sum(ap) as bigint) as applied_rows, cast(max(nw) as varchar) as newest from r group by 1""")
def a10_company_groups(spark, sf):
    rows = enriched(spark, sf)
    named = postings(spark, sf).select("seq", F.col("company").alias("shown"))
    rows = rows.join(named, "seq").withColumn("company", F.col("shown"))
    return facets.company_groups(rows).withColumn("newest", F.col("newest").cast("string"))


@query("select ats, count(*) as n from (select coalesce(case s_suppkey % 4 when 0 then 'lever' when 1 then 'ashby' when 2 then 'workday' end, 'other') as ats from supplier) group by 1")
def a11_targets_by_kind(spark, sf):
    kind = F.when(F.col("s_suppkey") % 4 == 0, "lever").when(F.col("s_suppkey") % 4 == 1, "ashby").when(F.col("s_suppkey") % 4 == 2, "workday")
    return table(spark, sf, "supplier").groupBy(F.coalesce(kind, F.lit("other")).alias("ats")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{E} select case when score = 0 then '0' when score < 25 then '1-24' when score < 45 then '25-44' when score < 60 then '45-59' when score < 75 then '60-74' else '75+' end as band, count(*) as n from e group by 1")
def a12_score_histogram(spark, sf):
    return facets.score_histogram(enriched(spark, sf))


@query("select case when n <= 250 then '250' when n <= 500 then '500' when n <= 1000 then '1000' when n <= 2000 then '2000' when n <= 4000 then '4000' else 'over 4000' end as bucket, count(*) as n, cast(sum(n) as bigint) as chars from (select length(coalesce(text, '')) as n from documents) group by 1")
def a13_length_histogram(spark, sf):
    return facets.length_histogram(table(spark, sf, "documents"))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ts from events group by 1")
def a14_latest_by_key(spark, sf):
    return facets.latest_by_key(events(spark, sf).select("user_id", "event_id", "ts"), "user_id", "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"{E}, z as (select *, row_number() over (order by score desc, id, seq) as rank from e where not archived and exclusion_reason is null) select (select count(*) from z) || ' new postings: ' || string_agg(title || ' @ ' || company, '; ' order by rank) || ' +' || ((select count(*) from z) - 5) || ' more' as line from z where rank <= 5")
def a15_digest_line(spark, sf):
    rows = rules.hard_filtered(enriched(spark, sf), AS_OF).where("not archived and passed").select("id", "seq", "title", "company", "score")
    return facets.digest_line(rows.select("title", "company", F.struct(-F.col("score"), "id", "seq").alias("place")))


@query("select source, count(*) as total, count(*) filter (text like '%$%') as filled, round(count(*) filter (text like '%$%') / count(*), 4) as share, count(*) filter (text like '%$%') * 2 < count(*) as drift from documents group by 1")
def a16_coverage(spark, sf):
    rows = table(spark, sf, "documents").withColumn("pay", F.when(F.contains("text", F.lit("$")), F.lit("$")))
    return facets.coverage(rows, "pay")


@query(f"select verdict, count(*) as n from (select case when s = -1 then 'error' when s in (401, 404, 410, 451) then 'permanent' when s >= 400 then 'transient' else 'ok' end as verdict from (select {STATUS} as s from events)) group by 1")
def a17_check_summary(spark, sf):
    return checks(spark, sf).groupBy(rules.link_verdict(F.col("status")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{E} select token, count(*) as n from (select unnest(season) as token from e where {O.expired('season')}) group by 1")
def a18_expired_by_season(spark, sf):
    return facets.expired_by_season(enriched(spark, sf).where(extract.expired(F.col("season"), AS_OF)))


@query(f"{E} select normalized_key, bool_or(applied) as applied, bool_or(hidden) and not bool_or(applied) as hidden, cast(min(case when applied then seen_at end) as varchar) as applied_at, count(*) as rows from e group by 1")
def a19_merged_state(spark, sf):
    return dedup.merged_state(enriched(spark, sf)).withColumn("applied_at", F.col("applied_at").cast("string"))


@query("with f as (select p_brand as strategy, 'lever' as ats, 's' || cast(p_size as varchar) as slug from part), k as (select distinct 's' || cast(s_suppkey as varchar) as slug from supplier) select strategy, count(*) as raw, count(distinct slug) as unique_found, count(distinct case when slug not in (select slug from k) then slug end) as new_found from f group by 1")
def a20_strategy_yield(spark, sf):
    found = table(spark, sf, "part").select(F.col("p_brand").alias("strategy"), F.lit("lever").alias("ats"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("slug"))
    return facets.strategy_yield(found, table(spark, sf, "supplier").select(F.lit("lever").alias("ats"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug")))


@query(f"{R} select case when year(posted_at) < 2022 then '<2015' else cast(year(posted_at) - 7 as varchar) end as bucket, count(*) as n from p group by 1")
def a21_year_buckets(spark, sf):
    return facets.year_buckets(postings(spark, sf).withColumn("at", F.col("posted_at") - F.expr("interval 7 years")), "at")


# --- windows, order, set operations -----------------------------------------------------------


@query(f"{E} select seq from (select seq, row_number() over (partition by normalized_key order by seq) as rn from e) where rn = 1")
def w1_first_seen(spark, sf):
    return dedup.first_seen(dedup.with_keys(postings(spark, sf)).select("seq", "normalized_key"), ["normalized_key"]).select("seq")


@query(f"""with r as (select user_id as run, event_id as seq, {STATUS} as status from events), i as (select *, sum(case when status <> -1 then 1 else 0 end) over (partition by run order by seq) as island from r),
    s as (select *, sum(case when status = -1 then 1 else 0 end) over (partition by run, island order by seq) as streak from i), b as (select run, min(seq) as bail from s where streak >= 2 group by run)
    select s.run, s.seq, cast(s.streak as bigint) as streak, coalesce(s.seq > b.bail, false) as unchecked from s left join b using (run)""")
def w3_error_streaks(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))
    return facets.error_streaks(rows, 2).select("run", "seq", "streak", "unchecked")


@query(f"{R} select seq, cast(ceil(row_number() over (partition by source order by seen_at desc, seq) / 50) as int) as page from p")
def w4_page_numbers(spark, sf):
    return facets.page_numbers(postings(spark, sf), "source", [F.desc("seen_at"), "seq"], 50).select("seq", "page")


@query("""with d as (select event_type as target, date_trunc('day', ts) as day, list(distinct cast(user_id as varchar)) as ids from events group by 1, 2), l as (select *, coalesce(lag(ids) over (partition by target order by day), []) as b from d)
    select target, cast(day as varchar) as ts, len(list_intersect(ids, b)) as kept, len(list_filter(b, lambda x: not list_contains(ids, x))) as gone, len(list_filter(ids, lambda x: not list_contains(b, x))) as added from l""")
def w5_snapshot_changes(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("target"), F.date_trunc("day", "ts").alias("ts"), F.col("user_id").cast("string").alias("job_id"))
    return facets.snapshot_changes(rows).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"{E} select seq, score from e where not archived")
def o1_by_score(spark, sf):
    return enriched(spark, sf).where("not archived").select("seq", "score").orderBy(F.desc("score"), "seq")


@query(f"{R} select seq, cast(posted_at as varchar) as posted_at from p where not archived")
def o1_newest(spark, sf):
    return postings(spark, sf).where("not archived").orderBy(F.desc("posted_at"), "seq").select("seq", when("posted_at"))


@query(f"{R} select seq from (select seq from p order by posted_at desc, seq limit 50 offset 100)")
def o2_o3_page(spark, sf):
    return facets.paged(postings(spark, sf).select("seq", "posted_at"), [F.desc("posted_at"), "seq"], 50, 3).select("seq")


@query(f"{E} select seq, score from (select seq, score from e where location_class <> 'non_us' and not stored order by score desc, id, seq limit 10)")
def o4_alert_top(spark, sf):
    rows = enriched(spark, sf).where("not stored").where(rules.alert_filter(rules.FilterSpec()))
    return rows.orderBy(F.desc("score"), "id", "seq").limit(10).select("seq", "score")


@query(f"{E} select distinct token, split_part(token, '-', 2) || '-' || case split_part(token, '-', 1) when 'winter' then '0' when 'spring' then '1' when 'summer' then '2' when 'fall' then '3' else '4' end as sort_key from (select unnest(tokens) as token from e)")
def o5_season_order(spark, sf):
    return postings(spark, sf).select(F.explode(extract.season_tokens(F.col("title"))).alias("token")).distinct().select("token", extract.season_sort_key(F.col("token")).alias("sort_key"))


@query(f"{E} select seq, score_label from (select seq, score_label, row_number() over (partition by score_label order by md5(id || '7'), id, seq) as rn from e) where rn <= 20")
def o6_sample_by_label(spark, sf):
    return facets.sample_by(enriched(spark, sf), "score_label", 20).select("seq", "score_label")


@query(f"{R} select id, count(*) as n from (select id from p where stored union all select id from p where not stored) group by 1")
def u1_bag_union(spark, sf):
    rows = postings(spark, sf)
    both = rows.where("stored").unionByName(rows.where("not stored").drop("pay"), allowMissingColumns=True)
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select 'Lever' as ats, 's' || cast(s_suppkey as varchar) as slug, 0 as prio from supplier), b as (select distinct 'lever' as ats, 'S' || cast(p_partkey % 150 as varchar) as slug, 1 as prio from part), u as (select * from a union all select * from b)
    select ats, slug from (select *, row_number() over (partition by lower(ats), lower(slug) order by prio, ats, slug) as rn from u) where rn = 1""")
def u2_priority_union(spark, sf):
    first = table(spark, sf, "supplier").select(F.lit("Lever").alias("ats"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    second = table(spark, sf, "part").select(F.lit("lever").alias("ats"), F.concat(F.lit("S"), (F.col("p_partkey") % 150).cast("string")).alias("slug"))
    return state.priority_union([first, second], ["ats", "slug"])


@query("select distinct n_name as name from nation union select r_name from region")
def u3_distinct_union(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).distinct()


# --- scalar logic ------------------------------------------------------------------------


@query(f"{R} select seq, array_to_string({O.tokens('title')}, ' ') as tokens from p")
def x1_tokens(spark, sf):
    return postings(spark, sf).select("seq", F.array_join(text.tokens(F.col("title")), " ").alias("tokens"))


@query(f"{R} select seq, {O.key('company', 'title')} as normalized_key from p")
def x2_normalized_key(spark, sf):
    return postings(spark, sf).select("seq", text.normalized_key(F.col("company"), F.col("title")).alias("normalized_key"))


@query(f"{R} select seq, {O.canon('company')} as company from p")
def x3_canonical_company(spark, sf):
    return postings(spark, sf).select("seq", text.canonical_company(F.col("company")).alias("company"))


@query(f"{R} select seq, trim(regexp_replace(company, '[\\x{{1F300}}-\\x{{1F64F}}]\\s*', '', 'g')) as company from p")
def x4_without_emoji(spark, sf):
    return postings(spark, sf).select("seq", text.without_emoji(F.col("company")).alias("company"))


PAY = O.salary("pay")


@query(f"{R} select seq, {PAY[0]} as pay_text, {PAY[1]} as pay_min, {PAY[2]} as pay_max, {PAY[3]} as pay_unit from p")
def x7_salary(spark, sf):
    # as a generated row the salary is worked out once, not for each of its fields
    return postings(spark, sf).select("seq", F.inline(F.array(extract.salary(F.col("pay")))).alias("pay_text", "pay_min", "pay_max", "pay_unit"))


@query(f"{E} select seq, array_to_string(tokens, ',') as tokens, array_to_string(season, ',') as season from e")
def x8_x9_seasons(spark, sf):
    found = postings(spark, sf).select("seq", extract.season_tokens(F.col("title")).alias("tokens"))
    return found.select("seq", F.array_join("tokens", ",").alias("tokens"), F.array_join(extract.season_with_default(F.col("tokens"), AS_OF), ",").alias("season"))


@query(f"{R} select seq, md5(company || title || {O.stripped('link')}) as row_id from p")
def x10_posting_id(spark, sf):
    return postings(spark, sf).select("seq", text.posting_id(F.col("company"), F.col("title"), F.col("link")).alias("row_id"))


@query(f"""{R} select seq, case seq % 3 when 0 then 'greenhouse' when 1 then 'lever' else 'workday' end as ats, case seq % 3 when 2 then 'tenant' else 'team' || cast(seq % 97 as varchar) end as slug, case seq % 3 when 2 then 'External' end as board, case seq % 3 when 2 then 'wd5' end as instance, cast(seq as varchar) as job_id from p""")
def x11_board_addresses(spark, sf):
    n, team = F.col("seq").cast("string"), F.concat(F.lit("team"), (F.col("seq") % 97).cast("string"))
    url = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), team, F.lit("/jobs/"), n)).when(F.col("seq") % 3 == 1, F.concat(F.lit("https://jobs.lever.co/"), team, F.lit("/"), n)).otherwise(F.concat(F.lit("https://tenant.wd5.myworkdayjobs.com/en-US/External/job/"), n))
    return postings(spark, sf).select("seq", extract.board_address(url).alias("a")).select("seq", "a.*")


@query(f"{R} select seq, cast(seq as varchar) as linkedin_id from p")
def x12_linkedin_ids(spark, sf):
    n = F.col("seq").cast("string")
    url = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/engineer-at-x-"), n)).otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/search?currentJobId="), n))
    return postings(spark, sf).select("seq", extract.linkedin_id(url).alias("linkedin_id"))


@query("with s as (select doc_id, coalesce(text, '') as t from documents), " + _trimmed("s", "doc_id") + " select doc_id, after as description from trimmed")
def x13_trimmed_descriptions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.trimmed_description(F.col("text")).alias("description"))


@query("with s as (select s_suppkey, regexp_split_to_array(lower(s_name), '[^a-z0-9]+') as w from supplier) select s_suppkey, unnest(list_distinct(list_filter([array_to_string(w, '-'), array_to_string(w, ''), w[1]], lambda x: length(x) between 3 and 60))) as slug from s")
def x15_slugs(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(text.slugs(F.col("s_name"))).alias("slug"))


@query(f"{R} select seq, 'lever' as ats, 'team' || cast(seq % 97 as varchar) as slug from p")
def x16_mined_references(spark, sf):
    body = F.concat(F.lit("We hire: https://jobs.lever.co/Team"), (F.col("seq") % 97).cast("string"), F.lit(", see there."))
    return postings(spark, sf).select("seq", F.explode(extract.mined_references(body)).alias("r")).select("seq", "r.*")


# --- payloads ----------------------------------------------------------------------------


def landed(spark, sf, source: str, body, *more):
    """Postings of a source as one payload for each hundred of its rows: the body is made by Spark from them."""
    rows = postings(spark, sf).where(F.col("source") == source).withColumns({"target_slug": F.expr("'team' || cast(seq div 800 as string)"), "fetched_at": F.lit(AS_OF)})
    return rows.groupBy("source", "target_slug", "fetched_at").agg(body.alias("body"))


def listed(**fields):
    return F.sort_array(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])))


@query(f"{R} select id as job_id, title, location, link from p where source = 'Greenhouse' and {O.intern('title')}".replace("id as job_id", "cast(seq as varchar) as job_id"))
def s3_greenhouse(spark, sf):
    jobs_ = listed(id=F.col("seq"), title=F.col("title"), updated_at=F.lit("2026-01-01"), absolute_url=F.col("link"), location=F.struct(F.col("location").alias("name")), content=F.col("pay"))
    return payloads.greenhouse(landed(spark, sf, "Greenhouse", F.to_json(F.struct(jobs_.alias("jobs"))))).select("job_id", "title", "location", "link")


@query(f"{R} select id as job_id, title, case when location = '' then 'Remote' else location end as location from p where source = 'Lever' and (true)".replace("id as job_id", "cast(seq as varchar) as job_id").replace("(true)", f"({O.intern('title')} or seq % 2 = 0)"))
def s4_lever(spark, sf):
    jobs_ = listed(id=F.col("seq").cast("string"), text=F.col("title"), hostedUrl=F.col("link"), createdAt=F.unix_millis("posted_at"), workplaceType=F.lit("remote"), descriptionPlain=F.col("pay"), categories=F.struct(F.col("location").alias("location"), F.when(F.col("seq") % 2 == 0, "Internship").otherwise("Full-time").alias("commitment")))
    return payloads.lever(landed(spark, sf, "Lever", F.to_json(jobs_))).select("job_id", "title", "location")


@query(f"{R} select cast(seq as varchar) as job_id, title, case when seq % 4 = 2 then 'Remote' else location end as location from p where source = 'Ashby' and {O.intern('title')}")
def s5_ashby(spark, sf):
    jobs_ = listed(id=F.col("seq").cast("string"), title=F.col("title"), locationName=F.col("location"), employmentType=F.lit("FullTime"), publishedDate=F.lit("2026-01-01"), isRemote=F.col("seq") % 4 == 2)
    page = F.concat(F.lit("<html><script>window.__appData = "), F.to_json(F.struct(F.struct(jobs_.alias("jobPostings")).alias("jobBoard"))), F.lit(";</script></html>"))
    return payloads.ashby(landed(spark, sf, "Ashby", page)).select("job_id", "title", "location")


@query(f"{R} select cast(seq as varchar) as job_id, title, case when location = '' then 'United States' else location end as location from p where source = 'Workday' and {O.intern('title')}")
def s6_workday(spark, sf):
    jobs_ = listed(title=F.col("title"), externalPath=F.concat(F.lit("/job/"), F.col("seq").cast("string")), locationsText=F.col("location"), postedOn=F.lit("Posted Today"))
    return payloads.workday(landed(spark, sf, "Workday", F.to_json(F.struct(jobs_.alias("jobPostings"))))).select("job_id", "title", "location")


@query("select page_id, cast(i as int) - 1 as place, regexp_extract(item, 'href=\"([^\"]*)\"', 1) as href from (select page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) as item, generate_subscripts(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), 1) as i from pages) where regexp_extract(item, 'href=\"([^\"]*)\"', 1) <> ''")
def s8_list_items(spark, sf):
    return payloads.list_items(table(spark, sf, "pages")).select("page_id", "place", "href")


@query(f"{R} select cast(seq as varchar) as job_id, title, case when location = '' then 'United States' else location || ', us' end as location from p where source = 'Indeed' and {O.intern('title')}".replace("location || ', us'", "location"))
def s9_smartrecruiters(spark, sf):
    jobs_ = listed(id=F.col("seq").cast("string"), name=F.col("title"), releasedDate=F.lit("2026-01-01"), location=F.struct(F.col("location").alias("city"), F.lit("").alias("region"), F.lit(None).cast("string").alias("country")))
    return payloads.smartrecruiters(landed(spark, sf, "Indeed", F.to_json(F.struct(jobs_.alias("content"))))).select("job_id", "title", "location")


@query(f"{R} select cast(seq as varchar) as job_id, title, location, case when location = '' then null else 2 end as places from p where source = 'SimplifyJobs' and {O.intern('title')}".replace("title, location, case", "title, case when location = '' then 'Remote' else location end as location, case"))
def s10_rippling(spark, sf):
    rows = postings(spark, sf).where("source = 'SimplifyJobs'").withColumns({"target_slug": F.expr("'team' || cast(seq div 800 as string)"), "fetched_at": F.lit(AS_OF), "label": F.explode(F.array("location", F.lit("Remote Hub"), "location"))})
    rows = rows.withColumn("label", F.when(F.col("location") == "", F.lit("Remote")).otherwise(F.col("label")))
    jobs_ = F.collect_list(F.struct(F.col("seq").cast("string").alias("uuid"), F.col("title").alias("name"), F.col("link").alias("url"), F.struct("label").alias("workLocation")))
    found = payloads.rippling(rows.groupBy("source", "target_slug", "fetched_at").agg(F.to_json(jobs_).alias("body")))
    first = F.when(F.array_contains("multi_location", F.lit("Remote Hub")), F.get(F.filter("multi_location", lambda p: p != "Remote Hub"), F.lit(0))).otherwise(F.col("location"))
    return found.select("job_id", "title", first.alias("location"), F.size("multi_location").alias("places")).withColumn("places", F.when(F.col("places") > 0, F.col("places")))


@query(f"{R} select cast(seq as varchar) as job_id, title, case when location <> '' then location else 'Remote' end as location from p where source = 'Handshake' and {O.intern('title')}")
def s11_workable(spark, sf):
    jobs_ = listed(shortcode=F.col("seq").cast("string"), title=F.col("title"), published=F.lit("2026-01-01"), remote=F.lit(True), location=F.struct(F.col("location").alias("city"), F.lit("").alias("region"), F.lit("").alias("country")))
    return payloads.workable(landed(spark, sf, "Handshake", F.to_json(F.struct(jobs_.alias("results"))))).select("job_id", "title", "location")


@query(f"{R}, q as (select min(seq) as seq, arg_min(title, seq) as title from p where source in ('Linkedin', 'Indeed') and {O.intern('title')} group by company, title, {O.stripped('link')}) select seq, title from q")
def s13_scraped(spark, sf):
    rows = postings(spark, sf).where("source in ('Linkedin', 'Indeed')").select("seq", F.col("source").alias("site"), "title", "company", "location", F.col("link").alias("job_url"), F.lit("NaN").alias("date_posted"), F.col("pay").alias("description"))
    return payloads.scraped(rows).select("seq", "title")


@query(f"{R} select seq, case when seq % 3 = 0 then 'https://boards.greenhouse.io/x/jobs/' || cast(seq as varchar) else link end as link from p where source = 'SimplifyJobs'")
def s14_table_rows(spark, sf):
    rows = postings(spark, sf).where("source = 'SimplifyJobs'")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    links = F.concat(F.lit('<a href="'), F.col("link"), F.lit('">A</a>'), F.when(F.col("seq") % 3 == 0, F.concat(F.lit('<a href="https://boards.greenhouse.io/x/jobs/'), F.col("seq").cast("string"), F.lit('">B</a>'))).otherwise(""))
    tr = F.concat(F.lit("<tr>"), cell(F.col("seq").cast("string")), cell(F.col("title")), cell(F.col("location")), cell(links), cell(F.lit("1d")), F.lit("</tr>"))
    page = rows.groupBy("source", F.expr("cast(seq div 800 as string)").alias("target_slug")).agg(F.concat(F.lit("<table><tr><th>Company</th></tr>"), F.array_join(F.collect_list(tr), ""), F.lit("</table>")).alias("body")).withColumn("fetched_at", F.lit(AS_OF))
    return payloads.table_rows(page).select(F.col("company").cast("long").alias("seq"), "link")


# --- state and streams -------------------------------------------------------------------


def scratch(spark) -> str:
    return f"{shared.shared_folder(spark)}/{uuid.uuid4().hex}"


@query(f"{R}, u as (select *, row_number() over (partition by id order by stored, seq desc) as rn from p) select id, seq from u where rn = 1")
def s19_upsert(spark, sf):
    rows = postings(spark, sf).select("id", "seq", "stored", "title")
    new = rows.where("not stored").groupBy("id").agg(F.max_by(F.struct("seq", "stored", "title"), "seq").alias("r")).select("id", "r.*")
    return state.upsert(rows.where("stored"), new).select("id", "seq")


@query("select user_id as key, coalesce(max(case when event_type = 'purchase' then value end), -1.0) as value from events group by 1")
def s20_merged_defaults(spark, sf):
    rows = table(spark, sf, "events")
    defaults = rows.select(F.col("user_id").alias("key")).distinct().withColumn("value", F.lit(-1.0))
    return state.merged_defaults(rows.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("value")), defaults)


@query("select 'p' || cast(user_id as varchar) as id, max(event_id) as seq from events group by 1")
def t1_t2_stream_into_store(spark, sf):
    """The events as a file stream, merged into a versioned table batch by batch."""
    folder = scratch(spark)
    schema = table(spark, sf, "events").schema
    stream = jobs.file_stream(spark, sf, schema, "events.parquet").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"))
    store = state.VersionedTable(spark, f"{folder}/store")
    jobs.into_store(stream, store, f"{folder}/checkpoint", jobs.upsert_merge).awaitTermination()
    return store.read().select("id", "seq")


SLOW = "source in ('Indeed', 'Linkedin', 'Handshake')"


@query(f"""{SETTLED.replace("inc as (select * from e where not stored)", f"inc as (select * replace (seq + case when {SLOW} then 1000000000000 else 0 end as seq, false as archived) from e where not stored)")},
    own as (select normalized_key, id from settled join w using (seq) where settled.outcome = 'keep'),
    up as (select coalesce(owner_id, own.id) as id, stripped as new_link from settled join w using (seq) left join own using (normalized_key) where upgrade),
    rows_ as (select id, link from st union all select id, case when stripped <> '' then stripped else link end from settled join inc using (seq) where settled.outcome = 'keep')
    select id, coalesce(new_link, link) as link from rows_ left join up using (id)""")
def t1_two_cadences(spark, sf):
    """The write path by two streams of orders into one parted table: fast sources, then slow ones, then the fast stream again from its beginning, which changes nothing."""
    folder, schema = scratch(spark), table(spark, sf, "orders").schema
    store = PartedTable(spark, f"{folder}/store", parts=16)
    store.commit("seed", 0, lambda now: enriched(spark, sf).where("stored"))

    def run(checkpoint, writer, which):
        enrich = lambda orders: ingest.enriched(postings_of(orders).where("not stored").where(which).withColumn("archived", F.lit(False)), AS_OF)
        stream = jobs.file_stream(spark, sf, schema, "orders.parquet")
        jobs.into_parts(stream, store, writer, f"{folder}/{checkpoint}", jobs.ingested(AS_OF, enrich)).awaitTermination()

    run("fast", "fast", f"not ({SLOW})")
    run("slow", "slow", SLOW)
    run("fast-again", "fast", f"not ({SLOW})")
    return store.read().select("id", "link")


@query("""with f as (select user_id as source, max(ts) as last from events group by 1), a as (select user_id as source from events group by 1 having user_id % 2 = 0),
    g as (select f.*, date_diff('second', last, timestamp '2024-01-30 00:00:00') as age, a.source is not null as alerted from f left join a using (source))
    select source, case when age > 86400 and age <= 604800 and not alerted then 'down' when age <= 86400 and alerted then 'recovered' end as transition from g where (age > 86400 and age <= 604800 and not alerted) or (age <= 86400 and alerted)""")
def t3_quiet_sources(spark, sf):
    log = events(spark, sf).select(F.col("user_id").alias("source"), F.col("ts").alias("fetched_at"))
    alerts = log.where("source % 2 = 0").groupBy("source").agg(F.max("fetched_at").alias("alerted_at"))
    return state.quiet_transitions(log, alerts, EVENTS_AS_OF).select("source", "transition")


@query("""with f as (select user_id as source, max(ts) as last from events group by 1), a as (select user_id as source from events group by 1 having user_id % 2 = 0),
    g as (select f.*, date_diff('second', last, timestamp '2024-01-30 00:00:00') as age, a.source is not null as alerted from f left join a using (source))
    select source, case when age > 86400 and age <= 604800 and not alerted then 'down' when age <= 86400 and alerted then 'recovered' end as transition from g where (age > 86400 and age <= 604800 and not alerted) or (age <= 86400 and alerted)""")
def t3_stream_of_health(spark, sf):
    """The same as a stream of fetches and of delivered alerts, with state by source, in one micro-batch (timers on processing time never run out of batches)."""
    folder, as_of = scratch(spark), int(EVENTS_AS_OF.timestamp())
    rows = jobs.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").cast("long").alias("at"))
    kinds = F.when(F.col("source") % 2 == 0, F.array(F.lit("fetched"), F.lit("delivered"))).otherwise(F.array(F.lit("fetched")))
    changes = jobs.health_changes(rows.withColumn("kind", F.explode(kinds)), now=lambda: as_of)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
    changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/changes").groupBy("source").agg(F.max_by("transition", "batch").alias("transition"))
    return last.select("source", "transition")


@query("""with d as (select event_type as source, ts from events), w as (select source, cast(date_trunc('day', ts) as timestamp) - k * interval 1 day as b from d, (select unnest(range(7)) as k))
    select source, cast(b as varchar) as "start", cast(b + interval 7 day as varchar) as "end", count(*) as n from w group by source, b""")
def t6_activity_windows(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("source"), F.col("ts").alias("seen_at"))
    return facets.activity_windows(rows).withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "end": F.date_format("end", "yyyy-MM-dd HH:mm:ss")})


@query(f"{R}, ch as (select 'p' || cast(user_id * 3 as varchar) as id, max(case when event_type = 'purchase' then 1 end) as bought from events where event_type = 'purchase' group by 1) select seq, case when bought = 1 then true else applied end as applied from p left join ch using (id)")
def t5_stream_of_changes(spark, sf):
    folder = scratch(spark)
    stream = jobs.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet").where("event_type = 'purchase'")
    feed = stream.select(F.concat(F.lit("p"), (F.col("user_id") * 3).cast("string")).alias("id"), F.lit("applied").alias("field"), F.lit("true").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    store = state.VersionedTable(spark, f"{folder}/store")
    jobs.into_store(feed, store, f"{folder}/checkpoint", jobs.patch_merge(postings(spark, sf))).awaitTermination()
    return store.read().select("seq", "applied")


# --- more payloads and joins ------------------------------------------------------------------


@query(f"{R} select cast(seq as varchar) as job_id, title, company from p where source = 'Linkedin' and seq % 16 = 5")
def s12_yc(spark, sf):
    jobs_ = listed(id=F.col("seq"), title=F.col("title"), jobType=F.when(F.col("seq") % 16 == 5, "Intern").otherwise("Fulltime"), location=F.col("location"), salaryRange=F.col("pay"), companyName=F.col("company"), oneLiner=F.lit("a & b"), url=F.col("link"))
    escaped = F.replace(F.replace(F.to_json(F.struct(F.struct(jobs_.alias("jobs")).alias("props"))), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return payloads.yc(landed(spark, sf, "Linkedin", F.concat(F.lit('<div data-page="'), escaped, F.lit('"></div>')))).select("job_id", "title", "company")


@query(f"{R} select seq, title as role, '$25/hr' as pay, location as card_location from p where source = 'Handshake'")
def s15_cards(spark, sf):
    rows = postings(spark, sf).where("source = 'Handshake'")
    made = rows.select("seq", "company", F.concat("company", F.lit(" "), "title", F.lit(" $25/hr · Internship · x")).alias("label"), F.concat(F.lit("Promoted∙"), "location", F.lit("∙3wk ago")).alias("footer"))
    return payloads.cards(made).select("seq", "role", "pay", "card_location")


@query(f"{R} select seq, case when seq % 4 = 3 then 'Detail ' || cast(seq as varchar) else company end as company from p where source = 'Handshake'")
def s15a_card_companies(spark, sf):
    rows = postings(spark, sf).where("source = 'Handshake'").withColumn("job_id", F.col("seq").cast("string"))
    cards_ = rows.withColumn("company", F.when(F.col("seq") % 4 != 3, F.col("company")))
    details = rows.select("job_id", F.concat(F.lit("Detail "), "job_id").alias("company"))
    return payloads.with_company(cards_, details).select("seq", "company")


@query(f"{R} select seq, case seq % 3 when 0 then 'plain' when 1 then pay || chr(10) || chr(10) || 'Needs' || chr(10) || title end as description from p")
def s16_descriptions(spark, sf):
    third = F.col("seq") % 3
    rows = postings(spark, sf).select("seq", F.when(third == 0, " plain ").alias("plain"), F.when(third < 2, F.concat(F.lit("<p>"), "pay", F.lit("</p>"))).alias("html"), F.when(third < 2, F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<li>"), "title", F.lit("</li>")).alias("content")))).alias("lists"))
    return payloads.assembled_description(rows).select("seq", "description")


@query(f"{R}, f as (select link, 'https://direct.example/' || cast(min(seq) as varchar) as resolved from p where stored group by 1) select seq, coalesce(f.resolved, p.link) as link from p left join f on f.link = p.link")
def s17_resolved_links(spark, sf):
    rows = postings(spark, sf).withColumn("description", F.lit(None).cast("string"))
    fetched = rows.where("stored").groupBy("link").agg(F.concat(F.lit("https://direct.example/"), F.min("seq").cast("string")).alias("resolved")).withColumn("description", F.lit("text"))
    return payloads.with_fetched(rows, fetched).select("seq", "link")


@query(f"{E} select seq, role_points, company_points, location_points, score from e where id in (select 'p' || cast(c_custkey as varchar) from customer)")
def j15_score_lookup(spark, sf):
    ids = table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"))
    return enriched(spark, sf).join(ids, "id", "left_semi").select("seq", "role_points", "company_points", "location_points", "score")


@query(f"""{R} select seq, case when seq % 16 = 3 then 'drop' else 'update' end as action, 'https://t' || cast(seq % 5 as varchar) || '.wd5.myworkdayjobs.com/' || case when seq % 7 <= 3 then 'S' || cast(seq % 7 as varchar) else 'G' || cast(seq % 5 as varchar) end || '/job/' || cast(seq as varchar) as link
    from p where source = 'Workday' and seq % 3 = 0""")
def j10_m10_repair_plan(spark, sf):
    text_of = lambda n: (F.col("seq") % n).cast("string")
    rows = postings(spark, sf).where("source = 'Workday'").withColumn("host", F.concat(F.lit("t"), text_of(5), F.lit(".wd5.myworkdayjobs.com")))
    bad = rows.select(F.col("seq").alias("id"), "title", "company", "host", F.concat(F.lit("s"), text_of(7)).alias("slug"), F.concat(F.lit("https://"), "host", F.lit("/wrong/job/"), F.col("seq").cast("string")).alias("link"))
    good = rows.select("host", F.concat(F.lit("G"), text_of(5)).alias("board"))
    targets = rows.where("seq % 7 <= 3").select(F.concat(F.lit("s"), text_of(7)).alias("slug"), F.lit("no such company").alias("name"), F.concat(F.lit("S"), text_of(7)).alias("board")).distinct()
    board = F.when(F.col("seq") % 7 <= 3, F.concat(F.lit("S"), text_of(7))).otherwise(F.concat(F.lit("G"), text_of(5)))
    checks_ = rows.select(F.concat(F.lit("https://"), "host", F.lit("/"), board, F.lit("/job/"), F.col("seq").cast("string")).alias("link"), F.when(F.col("seq") % 3 == 0, 200).otherwise(404).alias("status"))
    new_link = F.concat(F.lit("https://"), "host", F.lit("/"), board, F.lit("/job/"), F.col("seq").cast("string"))
    there = rows.where("seq % 16 = 3").select(text.posting_id(F.col("company"), F.col("title"), new_link).alias("id"))
    return state.repair_plan(bad, good, targets, postings(spark, sf).select("id").unionByName(there), checks_).select(F.col("id").alias("seq"), "action", "link")


@query(f"{R} select source, param, n from (select source, 'jobFamilyGroup' as param, count(*) filter ({O.intern('title')}) as n from p where seq % 2 = 0 group by 1 union all select source, 'workerSubType', count(*) filter ({O.intern('title')}) from p where seq % 2 = 1 group by 1) where n > 0")
def s7_intern_facets(spark, sf):
    """A facets response for each hundred rows of a source, made from their titles; the number of ids kept for each parameter."""
    param = F.when(F.col("seq") % 2 == 0, "jobFamilyGroup").otherwise("workerSubType")
    values = postings(spark, sf).groupBy("source", F.expr("seq div 800").alias("page"), param.alias("facetParameter")).agg(F.collect_list(F.struct(F.col("title").alias("descriptor"), F.col("seq").cast("string").alias("id"))).alias("values"))
    body = values.groupBy("source", "page").agg(F.to_json(F.struct(F.collect_list(F.struct("facetParameter", "values")).alias("facets"))).alias("body"))
    found = payloads.intern_facets(body.withColumnRenamed("source", "target_slug"))
    each = found.select(F.col("target_slug").alias("source"), F.explode("facets").alias("param", "ids"))
    return each.groupBy("source", "param").agg(F.sum(F.size("ids").cast("long")).alias("n"))


@query(f"{E} select id, title, company, score from e where not stored and location_class <> 'non_us' and score >= 75 and not exists(select 1 from (select 'p' || cast(event_id as varchar) as id, {STATUS} as status from events) k where k.id = e.id and status in (404, 410)) order by score desc, id, seq limit 10")
def s22_alert_outbox(spark, sf):
    """The rows that an alert would carry: the alert filter, then live links, then the best ten."""
    rows = enriched(spark, sf).where("not stored").where(rules.alert_filter(rules.FilterSpec(least_score=75)))
    return state.live_links(rows, checks(spark, sf)).orderBy(F.desc("score"), "id", "seq").limit(10).select("id", "title", "company", "score")


@query(f"{R} select count(*) as n from p where id in (select 'p' || cast(c_custkey as varchar) from customer)")
def s23_backup(spark, sf):
    """The rows that a plan touches, written before it is applied and read again."""
    folder = scratch(spark)
    plan = table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"))
    state.backup(postings(spark, sf), plan, folder)
    return spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, " + _plain("coalesce(text, '')") + " as cleaned from documents")
def x14_cleaned_descriptions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_markdown(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query("select page_id, trim(" + _decoded("regexp_replace(regexp_replace(" + _decoded("html") + ", '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')") + ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as plain from pages")
def x6_stripped_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


# --- targets, full write path, re-appearance ----------------------------------------------------


@query(f"""{R}, u as (select *, 'team' || cast(seq % 97 as varchar) as team from p),
    t as (select distinct case s_suppkey % 3 when 0 then 'greenhouse' when 1 then 'lever' else 'ashby' end as ats, 'team' || cast(s_suppkey % 90 as varchar) as slug from supplier)
    select seq, t.ats, t.slug as target_slug, cast(seq as varchar) as job_id
    from u left join t on t.slug = u.team and t.ats = case seq % 3 when 0 then 'greenhouse' when 1 then 'lever' else 'ashby' end where seq % 5 <> 0""")
def j6_attached_targets(spark, sf):
    """Links to three boards, every fifth without a job, against targets that are listed in two spellings."""
    n, team = F.col("seq").cast("string"), F.concat(F.lit("team"), (F.col("seq") % 97).cast("string"))
    job = lambda front, between: F.concat(F.lit(front), team, F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit(between), n)))
    link = F.when(F.col("seq") % 3 == 0, job("https://boards.greenhouse.io/", "/jobs/")).when(F.col("seq") % 3 == 1, job("https://jobs.lever.co/", "/")).otherwise(job("https://jobs.ashbyhq.com/", "/"))
    made = table(spark, sf, "supplier").withColumn("ats", F.when(F.col("s_suppkey") % 3 == 0, "greenhouse").when(F.col("s_suppkey") % 3 == 1, "lever").otherwise("ashby"))
    slug = F.concat(F.lit("team"), (F.col("s_suppkey") % 90).cast("string"))
    targets = made.select("ats", slug.alias("slug"), F.col("s_suppkey").alias("ord")).unionByName(made.select("ats", F.upper(slug).alias("slug"), (F.col("s_suppkey") + 1_000_000_000).alias("ord")))
    return state.attached_targets(postings(spark, sf).select("seq", link.alias("link")), targets).drop("link")


@query(f"{R} select seq, title, cast(seq as varchar) as job_id, 'https://careers-x.icims.com/jobs/' || cast(seq as varchar) || '/job' as link from p where {O.intern('title')}")
def s8_icims(spark, sf):
    """Career pages of list items, as many a page as one order hundred has, flattened to postings."""
    n = F.col("seq").cast("string")
    escaped = F.replace(F.col("title"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit('<li class="row"><a href="https://careers-x.icims.com/jobs/'), n, F.lit('/job"><h3>'), escaped, F.lit("</h3></a><p>x</p></li>"))
    pages = postings(spark, sf).groupBy(F.floor(F.col("seq") / 100).cast("string").alias("target_slug")).agg(F.concat(F.lit("<ul><li>no link</li>"), F.array_join(F.collect_list(item), ""), F.lit("</ul>")).alias("body"))
    found = payloads.icims(pages.withColumns({"source": F.lit("icims"), "fetched_at": F.lit(AS_OF)}))
    return found.select(F.col("job_id").cast("long").alias("seq"), "title", "job_id", "link")


LANDED_PAY = "case when seq % 7 = 0 then '$50/hr' end"
UNPARSED = O.in_list(ingest.UNPARSED)
READ_PAY = O.salary("read")
WORDY = "'Who we are: ' || repeat('we like our work ', 20) || 'Job description: ' || pay || repeat(' we build things.', 20) || ' Equal opportunity for all.'"
WORDY_AFTER = "'Job description: ' || pay || repeat(' we build things.', 20)"


@query(f"""{R}, d as (select *, {LANDED_PAY} as own, title || ' ' || {WORDY} as read from p)
    select seq, case when own is not null or source in {UNPARSED} then null else {READ_PAY[0]} end as read_text, case when own is not null or source in {UNPARSED} then null else {READ_PAY[1]} end as read_min,
           own as salary_text, {WORDY_AFTER} as description from d""")
def p3_x7a_described(spark, sf):
    """The enrichment with descriptions: a landed salary wins, one source is never read, the rest by title and description."""
    rows = postings(spark, sf).withColumns({"description": F.expr(WORDY), "salary_text": F.when(F.col("seq") % 7 == 0, "$50/hr")})
    done = ingest.enriched(rows, AS_OF, described="description")
    return done.select("seq", "salary_text", "description", F.inline(F.array("salary")).alias("read_text", "read_min", "_most", "_unit")).drop("_most", "_unit")


@query(f"""{R}, a as (select *, archived or seen_at < {O.AS_OF} - interval 30 day as aged from p), c as (select distinct id from p where seq % 4 = 0)
    select seq, aged, case when c.id is not null and failed_check_count = 0 then false else aged end as archived from a left join c using (id)""")
def t4_age_out_and_return(spark, sf):
    """Rows not seen for 30 days are archived; those that a late batch brings again are active, unless checks of their link failed."""
    rows = postings(spark, sf).select("id", "seq", "title", "seen_at", "archived", "failed_check_count")
    aged = state.archived_by_age(rows, AS_OF)
    late = rows.where("seq % 4 = 0").withColumn("seen_at", F.lit(AS_OF))
    back = dedup.backfill(aged, late).select("seq", "archived")
    return aged.select("seq", F.col("archived").alias("aged")).join(back, "seq")


@query(f"{R} select seq, archived or id in (select 'p' || cast(c_custkey as varchar) from customer) as archived from p")
def m4_archived_by_ids(spark, sf):
    ids = table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"))
    return state.archived_by_ids(postings(spark, sf), ids).select("seq", "archived")


@query(f"{E}, u as (select distinct token from (select unnest(tokens) as token from e)) select token, case when starts_with(token, 'year-') then split_part(token, '-', 2) else upper(token[1]) || substring(split_part(token, '-', 1), 2) || ' ' || split_part(token, '-', 2) end as label from u")
def x10_season_labels(spark, sf):
    tokens = postings(spark, sf).select(F.explode(extract.season_tokens(F.col("title"))).alias("token")).distinct()
    return tokens.select("token", text.season_label(F.col("token")).alias("label"))


@query("""with d as (select event_type as source, ts from events), w as (select source, cast(date_trunc('day', ts) as timestamp) - k * interval 1 day as b from d, (select unnest(range(7)) as k))
    select source, cast(b as varchar) as "start", cast(b + interval 7 day as varchar) as "end", count(*) as n from w group by source, b""")
def t6_stream_of_activity(spark, sf):
    """The sliding windows as a stream: all of the event file in one batch, the whole state written at its end."""
    folder = scratch(spark)
    stream = jobs.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.sliding_activity(stream)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")
    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/windows").groupBy("source", "start", "end").agg(F.max_by("n", "batch").alias("n"))
    return last.select("source", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


# --- facets in one pass, large dictionaries and domain lists, outbox ------------------------------


WANTED = {"score": "score >= 25", "season": "list_has_any(tokens, ['summer-2026', 'fall-2026'])", "applied": "not applied", "hidden": "not hidden", "source": "source in ('Greenhouse', 'Lever', 'Indeed')"}


def _all_but(own: str | None) -> str:
    return " and ".join(test for name, test in WANTED.items() if name != own)


@query(f"""{E} select 'season' as facet, value, count(*) as n from (select unnest(tokens) as value from e where {_all_but('season')}) group by 2
    union all select 'tab', value, count(*) from (select unnest(['all', case when applied then 'applied' else 'open' end]) as value from e where {_all_but('applied')}) group by 2
    union all select 'source', source, count(*) from e where {_all_but('source')} group by 2
    union all select 'hidden', 'hidden', count(*) from e where hidden and {_all_but('hidden')} group by 2
    union all select 'label', score_label, count(*) from e where {_all_but(None)} group by 2""")
def a5_a6_leave_one_out(spark, sf):
    """Season, tab, source and hidden counts, each under all filters but its own, and labels under all: one pass."""
    tokens = extract.season_tokens(F.col("title"))
    filters = {"score": F.col("score") >= 25, "season": F.arrays_overlap(tokens, F.array(F.lit("summer-2026"), F.lit("fall-2026"))), "applied": ~F.col("applied"), "hidden": ~F.col("hidden"), "source": F.col("source").isin("Greenhouse", "Lever", "Indeed")}
    return facets.leave_one_out(enriched(spark, sf), filters, {
        "season": ("season", tokens), "tab": ("applied", F.array(F.lit("all"), F.when(F.col("applied"), "applied").otherwise("open"))), "source": ("source", F.array("source")),
        "hidden": ("hidden", F.when(F.col("hidden"), F.array(F.lit("hidden")))), "label": (None, F.array("score_label")),
    })


@query(f"{R} select source, count(*) as n from p group by 1")
def a9_dynamic_sources(spark, sf):
    return facets.dynamic_sources(postings(spark, sf))


@query(f"""{E}, cs as (select seq, role_points, location_points, case when seq % 2 = 1 then company_points when o_custkey % 3 <> 0 then 5 else 0 end as company_points from e join orders on o_orderkey = seq)
    select *, least(role_points + company_points + location_points, 100) as score from cs""")
def s18_dictionary_index(spark, sf):
    """Scores by a dictionary table written as JSON and read again, with two thirds of all customers as a tier of their own; every other posting is a customer's."""
    folder = scratch(spark)
    names = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.lit("company").alias("component"), F.lit("listed").alias("tier"), F.lit(9).alias("tier_ord"), F.lit(5).alias("points"), F.col("c_custkey").cast("int").alias("kw_ord"), F.lower(F.concat(F.lit("customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("keyword"))
    scoring.dictionary_rows(spark).unionByName(names).write.json(f"{folder}/dictionary")
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("seq"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("owner"))
    rows = postings(spark, sf).join(owners, "seq").withColumn("company", F.when(F.col("seq") % 2 == 0, F.col("owner")).otherwise(text.canonical_company(F.col("company"))))
    dictionary = spark.read.schema(scoring.DICTIONARY).json(f"{folder}/dictionary")
    return scoring.scored_by(rows, dictionary).select("seq", "role_points", "company_points", "location_points", "score")


@query(f"{E} select seq, role_points, company_points, location_points, score, score_label, array_to_string(list_sort(matched), ',') as keywords from e")
def j7b_loaded_dictionary(spark, sf):
    """The scores by tiers that were read from a dictionary file."""
    folder = scratch(spark)
    scoring.dictionary_rows(spark).write.json(f"{folder}/dictionary")
    tiers = scoring.load_dictionary(spark, f"{folder}/dictionary")
    rows = postings(spark, sf).withColumn("company", text.canonical_company(F.col("company")))
    return scoring.scored(rows, **tiers).select("seq", "role_points", "company_points", "location_points", "score", "score_label", F.array_join(F.array_sort("matched_keywords"), ",").alias("keywords"))


@query("""with h as (select page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) as host from pages), d as (select distinct case when page_id % 2 = 0 then host else regexp_replace(host, '^[^.]+[.]', '') end as domain from h where page_id % 5 = 0),
    l as (select host from (select distinct host from h) join d on host = domain or ends_with(host, '.' || domain)) select page_id, host = '' or host in (select host from l) as aggregator from h""")
def f9a_domain_table(spark, sf):
    """Hosts of every fifth page as a table of domains, every other one without its first label."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    domains = pages.where("page_id % 5 = 0").select(F.when(F.col("page_id") % 2 == 0, host).otherwise(F.regexp_replace(host, "^[^.]+[.]", "")).alias("domain"))
    return rules.aggregator_links(pages, domains).select("page_id", "aggregator")


@query(f"""{E} select 'written' as reason, count(*) as n from e where exclusion_reason is null union all select 'passed', count(*) from e where exclusion_reason is null
    union all select r, count(exclusion_reason) from (select unnest({rules.REASONS}) as r) left join e on exclusion_reason = r group by r""")
def f3_counts_while_writing(spark, sf):
    """The rows that pass are written, and the reasons of the others counted in that pass."""
    folder = scratch(spark)
    counts = rules.write_passing(postings(spark, sf), AS_OF, folder)
    told = spark.createDataFrame(list(counts.items()), "reason string, n long")
    return told.unionByName(spark.read.parquet(folder).agg(F.lit("written").alias("reason"), F.count(F.lit(1)).alias("n")))


ALERTS = f"""{E}, z as (select id, title, company, score, seq from e where not stored and location_class <> 'non_us' and score >= 75 and not exists(select 1 from (select 'p' || cast(event_id as varchar) as id, {STATUS} as status from events) k where k.id = e.id and status in (404, 410))),
    a as (select *, row_number() over (order by score desc, id, seq) as rank from z where seq % 2 = 1), b as (select *, row_number() over (order by score desc, id, seq) as rank from z)"""


def _digest(rows: str) -> str:
    return f"(select count(*) || ' new postings: ' || (select string_agg(title || ' @ ' || company, '; ' order by rank) from {rows} where rank <= 5) || case when count(*) > 5 then ' +' || (count(*) - 5) || ' more' else '' end from {rows} where rank <= 10)"


@query(f"""{ALERTS} select 'first' as run, id, title, score, {_digest('a')} as digest from a where rank <= 10
    union all select 'second', id, title, score, {_digest('b')} from b where rank <= 10 and id not in (select id from a where rank <= 10)""")
def s22_outbox_of_two_runs(spark, sf):
    """Two alert runs into an outbox, and the first again: what one run has delivered no other repeats, and a replay adds nothing."""
    folder = f"{scratch(spark)}/outbox"
    rows = enriched(spark, sf).where("not stored").where(rules.alert_filter(rules.FilterSpec(least_score=75)))
    live = shared.stored(state.live_links(rows, checks(spark, sf)).select("id", "title", "company", "score", "seq"))
    for run, some in (("first", live.where("seq % 2 = 1")), ("second", live), ("first", live)):
        best = some.orderBy(F.desc("score"), "id", "seq").limit(10)
        line = facets.digest_line(best.select("title", "company", F.struct(-F.col("score"), "id", "seq").alias("place")))
        state.outbox_append(spark, folder, run, best, line)
    return spark.read.parquet(folder).select("run", "id", "title", "score", "digest")


# --- measures and rows of the smaller reports -----------------------------------------------------


@query(f"{E} select score_label as label, count(*) as n, round(avg(score), 4) as mean, max(score) as most from e group by 1 union all select 'all', count(*), round(avg(score), 4), max(score) from e")
def a12_score_summary(spark, sf):
    return facets.score_summary(enriched(spark, sf))


BUCKET = "case when n <= 250 then '250' when n <= 500 then '500' when n <= 1000 then '1000' when n <= 2000 then '2000' when n <= 4000 then '4000' else 'over 4000' end"
#: Every other document with an opener, a heading and a tail about it, so that all parts of the trim have work.
FRAMED = "case when doc_id % 2 = 0 then 'Who we are: ' || repeat('we like our work ', 20) || 'Job description: ' || text || ' Equal opportunity for all.' else text end"
TRIMMED = f"with s as (select doc_id as id, {FRAMED} as before, {FRAMED} as t from documents where coalesce(text, '') <> ''), " + _trimmed("s", "id, before")


def framed(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr(FRAMED).alias("text"))


@query(f"{TRIMMED}, l as (select 'before' as stage, length(before) as n from trimmed union all select 'after', length(after) from trimmed) select stage, {BUCKET} as bucket, count(*) as n, cast(sum(n) as bigint) as chars from l group by 1, 2")
def a13_trim_report(spark, sf):
    return facets.trim_report(framed(spark, sf))


@query(f"{TRIMMED} select id, length(before) as before, length(after) as after from trimmed order by length(before) - length(after) desc, id limit 5")
def o6_most_trimmed(spark, sf):
    return facets.most_trimmed(framed(spark, sf))


@query(f"{TRIMMED} select id, after from trimmed")
def x13_trimmed_frames(spark, sf):
    """Trimming of texts that have an opener, a heading and a tail."""
    return framed(spark, sf).where("coalesce(text, '') <> ''").select("id", text.trimmed_description(F.col("text")).alias("after"))


@query(f"""{R}, {CHECKS}, d as (select id from p where not archived and source = 'Linkedin'), v as (select d.id, case when status is null then null when status = -1 then 'error' when status in (401, 404, 410, 451) then 'permanent' when status >= 400 then 'transient' else 'ok' end as v from d left join k using (id))
    select count(*) as eligible, count(v) as checked, count(*) filter (v = 'permanent') as closed, count(*) filter (v = 'ok') as open, count(*) filter (v in ('error', 'transient')) as failed from v""")
def a17_check_counts(spark, sf):
    due = postings(spark, sf).where("not archived and source = 'Linkedin'")
    return facets.check_counts(due, checks(spark, sf).select("id", rules.link_verdict(F.col("status")).alias("verdict")))


APPLICATION = "case when seq % 4 <> 0 then 'https://apply.example/' || cast(seq as varchar(20)) end"


@query(f"""{E}, a as (select *, {APPLICATION} as url, case when seq % 3 = 0 then 'sent' else 'draft' end as status from e), r as (select *, row_number() over (partition by normalized_key order by url is null, not applied, id, seq) as rn from a)
    select normalized_key, case when url is not null then url end as application_url, case when url is not null then status end as application_status from r where rn = 1""")
def a19_merged_application(spark, sf):
    rows = dedup.first_seen(dedup.with_keys(postings(spark, sf)).withColumn("id", F.format_string("%s-%012d", "id", "seq")), ["id"])
    rows = rows.withColumns({"application_url": F.expr(APPLICATION), "application_status": F.when(F.col("seq") % 3 == 0, "sent").otherwise("draft")})
    return dedup.merged_state(rows).select("normalized_key", "application_url", "application_status")


FOUND = "with f as (select p_brand as strategy, 'lever' as ats, 's' || cast(p_partkey % 900 as varchar) as slug from part), k as (select distinct 's' || cast(s_suppkey as varchar) as slug from supplier)"


def found_slugs(spark, sf):
    found = table(spark, sf, "part").select(F.col("p_brand").alias("strategy"), F.lit("lever").alias("ats"), F.concat(F.lit("s"), (F.col("p_partkey") % 900).cast("string")).alias("slug"))
    return found, table(spark, sf, "supplier").select(F.lit("lever").alias("ats"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))


@query(f"{FOUND}, c as (select p_brand as strategy, count(distinct p_size) as calls from part group by 1) select strategy, count(*) as raw, count(distinct slug) as unique_found, count(distinct case when slug not in (select slug from k) then slug end) as new_found, calls, round(count(distinct case when slug not in (select slug from k) then slug end) / calls, 2) as per_call from f join c using (strategy) group by strategy, calls")
def a20_yield_per_call(spark, sf):
    calls = table(spark, sf, "part").groupBy(F.col("p_brand").alias("strategy")).agg(F.count_distinct("p_size").alias("calls"))
    return facets.yield_per_call(*found_slugs(spark, sf), calls)


@query(f"{FOUND} select ats, slug, count(distinct strategy) as strategies from f where slug not in (select slug from k) group by 1, 2")
def a20_union_of_new(spark, sf):
    return facets.union_of_new(*found_slugs(spark, sf))


@query(f"{R} select seq, case when seq % 4 < 2 then 'https://www.linkedin.com/jobs/search/?currentJobId=' || cast(seq as varchar) when seq % 4 = 2 then 'https://linkedin.com/jobs/view/a-' || cast(seq as varchar) else link end as stable from p")
def x12_stable_links(spark, sf):
    n = F.col("seq").cast("string")
    url = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("https://uk.LinkedIn.com/jobs/view/"), n, F.lit("/?trk=x"))).when(F.col("seq") % 4 == 1, F.concat(F.lit("http://linkedin.com/jobs/view/"), n)).when(F.col("seq") % 4 == 2, F.concat(F.lit("https://linkedin.com/jobs/view/a-"), n)).otherwise(F.col("link"))
    return postings(spark, sf).select("seq", extract.stable_linkedin_link(url).alias("stable"))


@query(f"""{R} select seq, case seq % 5 when 0 then 'ashby' when 1 then 'icims' when 2 then 'smartrecruiters' when 3 then 'rippling' else 'workable' end as ats, 'team' || cast(seq % 97 as varchar) as slug,
    case when seq % 5 in (3, 4) then 'AB' || cast(seq as varchar) else cast(seq as varchar) end as job_id from p""")
def x11_more_boards(spark, sf):
    n, team = F.col("seq").cast("string"), F.concat(F.lit("team"), (F.col("seq") % 97).cast("string"))
    shapes = [("https://jobs.ashbyhq.com/{t}/{n}?utm=1"), ("https://careers-{t}.icims.com/jobs/{n}/a-title/job"), ("https://jobs.smartrecruiters.com/{t}/{n}"), ("https://ats.rippling.com/en-US/{t}/jobs/AB{n}"), ("https://apply.workable.com/{t}/j/AB{n}/apply")]
    url = F.replace(F.replace(F.element_at(F.array(*map(F.lit, shapes)), (F.col("seq") % 5).cast("int") + 1), F.lit("{t}"), team), F.lit("{n}"), n)
    return postings(spark, sf).select("seq", extract.board_address(url).alias("a")).select("seq", "a.ats", "a.slug", "a.job_id")


@query("select distinct p_brand as slug, upper(regexp_extract(lower(p_brand), '^.')) || substring(replace(lower(p_brand), '#', ' '), 2) as name from part")
def x10_slug_names(spark, sf):
    """Names of slugs with hyphens and underscores, made from the brands of parts."""
    slug = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_-"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("slug"), text.slug_name(slug).alias("name")).distinct()


@query(f"{E} select seq, 'link' as rule from (select seq, row_number() over (partition by stripped order by seq) as rn from e) where rn = 1 union all select seq, 'id' from (select seq, row_number() over (partition by id order by seq desc) as rn from e) where rn = 1")
def w1_first_by_link_and_last_by_id(spark, sf):
    rows = dedup.with_keys(postings(spark, sf)).select("seq", "id", "stripped")
    return dedup.first_seen(rows, ["stripped"]).select("seq", F.lit("link").alias("rule")).unionByName(dedup.first_seen(rows, ["id"], last=True).select("seq", F.lit("id").alias("rule")))


@query(f"{R} select seq, case when location = '' then 'Austin, TX' else location end as location, case when location = '' then null else location || '|Austin, TX' end as places from p where source = 'SimplifyJobs'")
def s14a_multi_locations(spark, sf):
    """Table rows whose location cell has a second line, pages of a hundred rows."""
    rows = postings(spark, sf).where("source = 'SimplifyJobs'")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), cell(F.col("seq").cast("string")), cell(F.col("title")), cell(F.concat("location", F.lit("</br>Austin, TX"))), cell(F.concat(F.lit('<a href="'), "link", F.lit('">A</a>'))), cell(F.lit("1d")), F.lit("</tr>"))
    page = rows.groupBy("source", F.expr("cast(seq div 800 as string)").alias("target_slug")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(tr), ""), F.lit("</table>")).alias("body")).withColumn("fetched_at", F.lit(AS_OF))
    return payloads.table_rows(page).select(F.col("company").cast("long").alias("seq"), "location", F.array_join("multi_location", "|").alias("places"))


@query(f"{R} select seq from p where source = 'Handshake' and seq % 4 = 3 and seq % 5 <> 0")
def s15a_without_company(spark, sf):
    rows = postings(spark, sf).where("source = 'Handshake'").withColumn("job_id", F.col("seq").cast("string"))
    cards_ = rows.withColumn("company", F.when(F.col("seq") % 4 != 3, F.col("company")))
    details = rows.where("seq % 5 = 0").select("job_id", F.concat(F.lit("Detail "), "job_id").alias("company"))
    return payloads.without_company(cards_, details).select("seq")
