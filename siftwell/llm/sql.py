"""DuckDB SQL for the numbered queries, written from the contracts and the methods' descriptions."""

from __future__ import annotations

from siftwell.llm import markov, quality, secrets, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _places(name: str, pattern: str, among: str = "d") -> str:
    """CTEs that end in `name`: r, start, z (end), v for each match in the texts t of a table."""
    p = _quoted(pattern)
    return f"""{name}_raw as (select r, unnest(regexp_extract_all(t, {p})) as v, unnest(regexp_split_to_array(t, {p})) as g, generate_subscripts(regexp_split_to_array(t, {p}), 1) as i from {among} where regexp_matches(t, {p})),
        {name}_at as (select r, v, length(g) + coalesce(sum(length(g) + length(v)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as start from {name}_raw),
        {name} as (select r, cast(start as bigint) as start, cast(start + length(v) as bigint) as z, v from {name}_at where v is not null)"""


DOCS = "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents)"
SAID = "kind || ':' || start || ':' || z"
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
OCTET = "^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
PII = f"""{DOCS},
    {_places("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")},
    {_places("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")},
    {_places("card", r"[0-9]([\x20-]?[0-9])+")},
    {_places("phone", r"\+[0-9][\x20().0-9-]+[0-9]")},
    cards as (select *, reverse({DIGITS}) as digits from card where length({DIGITS}) between 16 and 19),
    base as (
        select r, 0 as k, 'email' as kind, start, z, v from email
        union all select r, 1, 'ip', start, z, v from ip where len(list_filter(string_split(v, '.'), lambda p: not regexp_matches(p, '{OCTET}'))) = 0
        union all select r, 2, 'card', start, z, v from cards
            where list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(digits[i] as int) when digits[i] >= '5' then 2 * cast(digits[i] as int) - 9 else 2 * cast(digits[i] as int) end)) % 10 = 0
        union all select r, 3, 'phone', start, z, v from phone where length({DIGITS}) between 8 and 15),
    s as (select *, row_number() over () as span, kind || ':' || lower(v) as entity from base),
    held as (select r, t from d where r in (select r from s)),
    {_places("run", r"[\p{L}\p{N}]+", "held")},
    term as (select r, start, z, lower(v) as term, row_number() over (partition by r order by start) as n from run where regexp_matches(v, '^\\p{{L}}{{3,}}$')),
    counted as (select *, (select count(*) from term where term.r = s.r and term.z <= s.start) as before, (select count(*) from term where term.r = s.r and term.start < s.z) as begun from s),
    near as (select c.span, c.entity, c.r, x.term, x.start, x.z, x.n from counted c join term x on x.r = c.r and (x.n between c.before - 3 and c.before or x.n between c.begun + 1 and c.begun + 4)),
    context as (select span, string_agg(term, ' ' order by n) as context from near group by span),
    together as (select entity, term, count(*) as together, count(distinct context) as contexts from near join context using (span) group by entity, term),
    each_ as (select entity, count(distinct span) as n_entity from near group by entity),
    word as (select term, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as term from documents where text is not null) where length(term) >= 3 group by term),
    rated as (select entity, term, 1 + ln(least(1.0, together / greatest(n, together))) / greatest(ln(greatest((select sum(n) from word), 2) / n_entity), 1e-9) as disclosed
              from together join word using (term) join each_ using (entity) where contexts >= 3),
    hit as (select distinct r, start, z, case when disclosed >= 0.95 then 'removed' else 'generalised' end as kind from near join rated using (entity, term) where disclosed >= 0.85),
    b as (select r, string_agg({SAID}, ',' order by k, start) as said, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone from base group by r),
    h as (select r, string_agg({SAID}, ',' order by start, z, kind) as said, count(*) as n from hit group by r)
    select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
           sha256(coalesce(b.said, '')) as base_sha256, concat_ws(',', b.said, h.said) as spans, coalesce(h.n, 0) as n_terms
    from d left join b using (r) left join h using (r)"""

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STATES = markov.STATES
SECRETS = f"""{DOCS},
    {_places("assign", ASSIGN)},
    {_places("access", "AKIA[A-Z0-9]+")},
    {_places("hexa", "[0-9a-f]+")},
    {_places("run", "[A-Za-z0-9+/_=-]+")},
    base as (
        select r, 0 as k, 'assign' as kind, start, z, regexp_extract(v, {_quoted(ASSIGN)}, 2) as v from assign where length(regexp_extract(v, {_quoted(ASSIGN)}, 2)) >= 6
        union all select r, 1, 'access', start, z, v from access where length(v) >= 20
        union all select r, 2, 'hex', start, z, v from hexa where length(v) >= 24),
    random as (select distinct v from base where length(v) >= 16 and regexp_matches(v, '[0-9]') order by md5(v), v limit {secrets.MOST_SAMPLES}),
    last as (select max(h) as h from (select distinct md5(text) as h from documents where text is not null order by h limit {secrets.MOST_DOCS})),
    sampled as (select distinct text || chr(1) as t from documents where md5(text) <= (select h from last)),
    worded as (select list_filter(list_transform(regexp_split_to_array(t, '[\\x20\\n]'), lambda w: regexp_extract(w, '(?s)^([A-Za-z][a-z]{{5,39}})([.,].*)?$', 1)), lambda w: w <> '') as ws from sampled),
    named as (select unnest(list_concat(ws, list_transform(range(1, len(ws) + 1), lambda i: ws[i] || '_' || case when i < len(ws) then ws[i + 1] || '_' else '' end || ((i - 1) % 100)))) as v from worded),
    ordinary as (select distinct v from named order by md5(v), v limit {secrets.MOST_SAMPLES}),
    sample as (select v, true as rnd from random union all select v, false from ordinary),
    pair as (select rnd, strpos('{markov.ALPHABET}', v[i]) as a, strpos('{markov.ALPHABET}', v[i + 1]) as b from (select rnd, v, unnest(range(1, length(v))) as i from sample where length(v) > 1)),
    seen as (select rnd, a, b, count(*) as n from pair group by rnd, a, b),
    state as (select unnest(range({STATES})) as x),
    grid as (select rnd, p.x as a, q.x as b from (select unnest([true, false]) as rnd), state p, state q),
    n as (select rnd, a, b, coalesce(n, 0) as n from grid left join seen using (rnd, a, b)),
    m as (select *, sum(n) over (partition by rnd) as whole, sum(n) over (partition by rnd, b) as alone, sum(n) over (partition by rnd, a) as total from n),
    l as (select rnd, a, b, ln((n + 5.0 * ((alone + 0.5) / (whole + 0.5 * {STATES}))) / (total + 5.0)) as l from m),
    weight as (select a, b, round(max(l) filter (rnd) - max(l) filter (not rnd), 4) as w from l group by a, b),
    candidate as (select row_number() over () as c, r, start, z, v from run where length(v) >= 20 and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]')
                  and not exists (select 1 from base where base.r = run.r and base.start < run.z and run.start < base.z)),
    letters as (select c, strpos('{markov.ALPHABET}', v[i]) as a, strpos('{markov.ALPHABET}', v[i + 1]) as b from (select c, v, unnest(range(1, length(v))) as i from candidate)),
    ratio as (select c, avg(w) as mean from letters join weight using (a, b) group by c),
    every as (select r, k, kind, start, z from base union all select r, 3, 'markov', start, z from candidate join ratio using (c) where mean > {secrets.MARGIN}),
    o as (select r, string_agg({SAID}, ',' order by start, k) as said, string_agg({SAID}, ',' order by start, k) filter (k < 3) as base_said,
                 count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, count(*) filter (k = 3) as n_markov from every group by r)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_said, '')) as base_sha256,
           coalesce(said, '') as spans, coalesce(n_markov, 0) as n_markov
    from d left join o using (r)"""

BENCHMARK_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
DECONTAMINATION = f"""
    with d as (select row_number() over () as r, doc_id, {BENCHMARK_WORDS} as ws from documents),
    b as (select cast(item_id as varchar) as item_id, {BENCHMARK_WORDS} as ws from benchmark),
    win as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') as w from (select item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as i from b where len(ws) > 0)),
    size as (select distinct n from win),
    spot as (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, size where len(ws) >= n),
    hit as (select r, i, win.n, item_id from spot join win on win.n = spot.n and win.w = array_to_string(ws[i : i + spot.n - 1], ' ')),
    covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
    item as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r)
    select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from d left join covered using (r) left join item using (r)"""


def _url_sql() -> str:
    """Host, path and rules; n-gram buckets; the rounds of gradient descent one CTE after the other."""
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: "case " + " ".join(f"when {fits(h, p)} then '{value(v, h, p)}'" for v, h, p in longest) + " end"
    rest = "case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end"

    def grams(text: str, salt: int) -> list[str]:
        codes = f"list_transform(string_split('^' || {text} || '$', ''), lambda c: unicode(c))"
        out = []
        for n in urls.SIZES:
            number = f"{salt}::bigint"
            for k in range(n):
                number = f"({number}) * 131 + {codes}[i + {k}]"
            out.append(f"list_transform(range(1, greatest(length({text}) + 2 - {n}, 0) + 2), lambda i: ({number}) % {urls.PRIME} % {urls.BUCKETS})")
        return out

    def buckets(rows: str, key: str) -> str:
        lists = ", ".join(grams("host", 1) + grams("path", 2))
        return f"select distinct {key}, unnest(flatten([{lists}])) as k from {rows}"

    steps = []
    for n in range(urls.ROUNDS):
        steps.append(f"""
        e{n} as materialized (select url, y - 1 / (1 + exp(-((select b from b{n}) + sum(round(w, 6))))) as e from feature join w{n} using (k) join label using (url) group by url, y),
        g{n} as materialized (select k, sum(e) as g from feature join e{n} using (url) group by k),
        w{n + 1} as materialized (select k, w * (1 - {urls.RATE} * {urls.DECAY}) + {urls.RATE} * coalesce(g, 0) / (select n from counts) as w from w{n} left join g{n} using (k)),
        b{n + 1} as materialized (select b + {urls.RATE} * (select sum(e) from e{n}) / (select n from counts) as b from b{n})""")
    return f"""
        with rested as (select page_id, url, {rest} as rest from pages),
        part as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rested),
        ruled as materialized (select *, {pick(lambda v, h, p: h + p)} as rule, {pick(lambda v, h, p: v)} as rule_verdict from part),
        label as materialized (select distinct url, host, path, cast(rule_verdict = 'block' as int)::double as y from ruled where rule is not null and url is not null order by md5(url), url limit {urls.MOST_LABELS}),
        counts as materialized (select count(*) as n, sum(y) as positive from label),
        feature as materialized ({buckets("label", "url")}),
        w0 as materialized (select unnest(range({urls.BUCKETS})) as k, 0.0::double as w),
        b0 as materialized (select ln(positive / (n - positive)) as b from counts),{",".join(steps)},
        seen as materialized ({buckets("(select distinct host, path from ruled where rule is null)", "host, path")}),
        scored as (select host, path, (select b from b{urls.ROUNDS}) + sum(round(w, 6)) as score from seen join w{urls.ROUNDS} using (k) group by host, path)
        select page_id, host, path, rule, coalesce(rule_verdict, case when score > 0 then 'block' else 'allow' end) as verdict from ruled left join scored using (host, path)"""


STOP = ", ".join(f"'{w}'" for w in sorted({form for line in quality.STOP_WORDS for w in line.split() for form in (w, w.capitalize())}))
ORACLE_SQL = {
    "op2_pii": PII,
    "op5_decontamination": DECONTAMINATION,
    "op6_secrets": SECRETS,
    "op8_urls": _url_sql(),
    "op3_quality": f"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
             w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
                          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
             x as (select r, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8),
             y as (select r, i, count(*) over (partition by r, array_to_string(ws[i : i + 7], ' ')) as n from x),
             z as (select r, count(distinct i + k) as n from y, (select unnest(range(8)) as k) where n > 1 group by r),
             m as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
                          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
                          coalesce(z.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^!]', '', 'g')) as n_shouts,
                          len(list_filter(ws, lambda v: v in ({STOP}))) as n_stop_words
                   from w left join z using (r)),
             b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop_words, n_lines, n_shouts,
               not (base_failed or n_symbols / greatest(n_words, 1) > 0.25 or n_shouts / greatest(n_words, 1) > 0.5
                    or word_chars / greatest(n_words, 1) < 2.0 or word_chars / greatest(n_words, 1) > 40.0
                    or n_dup_lines / greatest(n_lines, 1) > 0.5
                    or case when n_words >= 50 then n_stop_words / n_words else 1 end < 0.01) as kept
        from b""",
    "op9_substrings": """
        with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
             w as (select r, unnest(range(octet_length(b) - 399)) as s, b from d where octet_length(b) >= 400),
             h as (select r, s, sha256(b[s + 1 : s + 400]) as x from w),
             g as (select r, s from h where x in (select x from h group by x having count(*) > 1)),
             i as (select r, s, case when s <= lag(s) over (partition by r order by s) + 400 then 0 else 1 end as new from g),
             n as (select r, s, sum(new) over (partition by r order by s rows unbounded preceding) as k from i),
             gone as (select r, min(s) as a, max(s) + 400 as z from n group by r, k),
             cuts as (select r, coalesce(lag(z) over (partition by r order by a), 0) as a, a as z from gone
                      union all select r, max(z), (select octet_length(b) from d where d.r = gone.r) from gone group by r),
             kept as (select r, string_agg(hex(b[a + 1 : z]), '' order by a) as k from cuts join d using (r) group by r),
             removed as (select r, sum(z - a) as n, count(*) as spans from gone group by r),
             o as (select doc_id, octet_length(b) as n_bytes, coalesce(n, 0) as n_removed, coalesce(spans, 0) as n_spans,
                          case when k is null then b else unhex(k) end as kept
                   from d left join kept using (r) left join removed using (r))
        select doc_id, n_bytes, n_removed, n_spans, sha256(kept) as kept_sha256, n_bytes - n_removed as n_kept, try(decode(kept)) as text from o""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
             q as (select *, min(page_id) over (partition by html) as first from p)
        select page_id, n as payload_bytes, sha256(html) as payload_digest,
               case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id <> first then first end as refers_to
        from q""",
    "op12_negatives": """
        with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
                   from embeddings where vec_id is not null and label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
             s as (select a.r as anchor, a.vec_id as anchor_id, a.label = e.label as same, e.r, e.vec_id, cast(list_dot_product(a.v, e.v) as bigint) as score
                   from e as a join e on a.r <> e.r where a.vec_id % 100 = 0),
             p as (select *, row_number() over (partition by anchor order by score desc, vec_id, r) as k from s where same),
             n as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor, p.r order by s.score desc, s.vec_id, s.r) as rank,
                          s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
                   from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score where p.k <= 5)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op13_phrases": f"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents where text is not null),
             w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
             t as (select lang, sum(len(w)) as n from w group by lang),
             i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
             g as (select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k from i, (select unnest(range(1, 5)) as k) where i + k - 1 <= len(w)),
             f as (select lang, phrase, k as words, count(*) as f from g group by all having count(*) >= 30),
             c as (select lang, phrase, words, f as a, string_split(phrase, ' ') as w from f where words > 1),
             o as (select lang, unnest(flatten(list_transform(range(2, words), lambda m: list_transform(range(1, words - m + 2), lambda s: array_to_string(w[s : s + m - 1], ' '))))) as phrase, a as longer from c where words > 2),
             m as (select lang, phrase, max(longer) as longer from o group by all),
             x as (select c.lang, phrase, w, words, a, unnest(range(1, words)) as k from c left join m using (lang, phrase) where longer is null or 100 * longer < 80 * a),
             y as (select x.lang, x.phrase, a, k, b.f as l, e.f as r, cast(2000000 * cast(a as hugeint) // (b.f + e.f) as bigint) as score
                   from x join f b on b.lang = x.lang and b.phrase = array_to_string(x.w[1 : k], ' ') join f e on e.lang = x.lang and e.phrase = array_to_string(x.w[k + 1 : x.words], ' ')),
             z as (select *, row_number() over (partition by lang, phrase order by score, k) as best from y),
             r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z where best = 1)
        select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from r join t using (lang) where rank <= 2000""",
}
