"""Text columns: tokens, keys, company names, links, HTML, names and slugs. Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points with emoji presentation.
EMOJI = (
    r"\x{231A}-\x{231B}\x{23E9}-\x{23EC}\x{23F0}\x{23F3}\x{25FD}-\x{25FE}\x{2614}-\x{2615}\x{2648}-\x{2653}\x{267F}\x{2693}\x{26A1}\x{26AA}-\x{26AB}"
    r"\x{26BD}-\x{26BE}\x{26C4}-\x{26C5}\x{26CE}\x{26D4}\x{26EA}\x{26F2}-\x{26F3}\x{26F5}\x{26FA}\x{26FD}\x{2705}\x{270A}-\x{270B}\x{2728}\x{274C}\x{274E}"
    r"\x{2753}-\x{2755}\x{2757}\x{2795}-\x{2797}\x{27B0}\x{27BF}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{1F004}\x{1F0CF}\x{1F18E}\x{1F191}-\x{1F19A}"
    r"\x{1F1E6}-\x{1F1FF}\x{1F201}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FC}\x{1F7E0}-\x{1F7EB}\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
)
# Legal suffixes of company names, and brands that carry none.
LEGAL = "inc|incorporated|llc|l\\.l\\.c|corp|corporation|ltd|limited|co|company|gmbh|plc|llp|lp|pty|n\\.?a"
ALIASES = {
    "nvidia ai": "NVIDIA",
    "perplexity ai": "Perplexity",
    "adobe systems": "Adobe",
    "amazon.com": "Amazon",
    "amazon web services": "Amazon",
    "amazon science": "Amazon",
    "caci international": "CACI",
    "palantir technologies": "Palantir",
}
# Words that don't tell titles apart.
FILLERS = (
    "intern interns internship internships co-op coop co op apprentice apprenticeship trainee summer spring fall autumn winter "
    "2023 2024 2025 2026 2027 2028 2029 2030 full-time fulltime parttime part-time temporary temp seasonal remote hybrid onsite on-site "
    "a an the and or of for in on at with i ii iii iv"
).split()
TAIL = r"[-–—,/]\s*(remote|hybrid|onsite|on[-\s]?site|nyc|sf|ny|new\s+york|san\s+francisco|seattle|boston|austin|chicago|los\s+angeles|us|usa|united\s+states|summer|spring|fall|winter|\d{4})"
# Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_cid utm_reader utm_viz_id ref referrer ref_ affiliated affiliate partner "
    "source trk gh_src ic iorq vnp vnp_"
).split()


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric words, without a final -ing or -s where longer than five letters."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when((F.length(w) > 5) & w.endswith("ing"), F.left(w, F.length(w) - 3)).when((F.length(w) > 5) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w))


def padded(words: Column) -> Column:
    """Tokens as one string with a blank on both sides, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def stems(keyword: str) -> list[str]:
    """What tokens() makes of a dictionary entry, on the driver."""
    import re

    words = [w for w in re.split("[^a-z0-9]+", keyword.lower()) if w]
    return [w[:-3] if len(w) > 5 and w.endswith("ing") else w[:-1] if len(w) > 5 and w.endswith("s") else w for w in words]


def without_emoji(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{EMOJI}]\s*", ""))


def canonical_company(raw: Column) -> Column:
    name = F.trim(F.regexp_replace(raw, r"[\s ]+", " "))
    name = F.trim(F.regexp_replace(name, r"(?:\s*\([^)]*\)\s*)+$", ""))
    name = F.trim(F.regexp_replace(name, rf"(?i)(?:,?\s+(?:{LEGAL})\.?)+$", ""))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, F.lower(name)), name)


def normalized_key(company: Column, title: Column) -> Column:
    """company::title with clutter removed; equal keys are the same role on different boards."""
    t = F.regexp_replace(F.regexp_replace(F.lower(title), r"\(.*?\)", " "), r"\[.*?\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, f"(?i){TAIL}.*$", ""), r"[^\p{L}\p{N}\s]", " ")
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(FILLERS))
    return F.concat(F.trim(F.lower(company)), F.lit("::"), F.array_join(words, " "))


def strip_tracking(url: Column) -> Column:
    """The url without tracking parameters and tracking fragments."""
    hash_at, none = F.instr(url, "#"), F.lit("")
    fragment = F.when(hash_at > 0, F.substring(url, hash_at, F.length(url))).otherwise(none)
    front = F.when(hash_at > 0, F.substring(url, F.lit(1), hash_at - 1)).otherwise(url)
    mark = F.instr(front, "?")
    base = F.when(mark > 0, F.substring(front, F.lit(1), mark - 1)).otherwise(front)
    query = F.when(mark > 0, F.substring(front, mark + 1, F.length(front))).otherwise(none)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)), "&")
    fragment = F.regexp_replace(fragment, r"(?i)#*(utm-|ref=|trk=).*", "")
    clean = F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(none), F.when((fragment != "") & (fragment != "#"), fragment).otherwise(none))
    plain = F.regexp_replace(F.regexp_replace(url, r"(?i)[?#]&*(utm_|ref|trk|affiliated|affiliate|partner|source|gh_src)=[^&#]*", ""), r"\?$", "")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), clean).otherwise(plain)


#: White space as it is stripped from texts.
WHITE = " \t\n\x0b\x0c\r\xa0"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references as characters."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&bull;", "•"), ("&hellip;", "…")):
        text = F.replace(text, F.lit(name), F.lit(char))
    char = lambda hexed: F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")

    # a code point that isn't one (over 10FFFF, or half of a pair) stays a reference
    valid = lambda n: (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)

    def folded(t: Column, pattern: str, before: str, to_hex, number) -> Column:
        codes = lambda x: F.filter(F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(1))), lambda c: valid(number(c)))
        return let(t, lambda x: F.when(F.contains(x, F.lit(before)), F.aggregate(codes(x), x, lambda acc, c: F.replace(acc, F.concat(F.lit(before), c, F.lit(";")), char(to_hex(c))))).otherwise(x))

    text = folded(text, r"&#([0-9]{1,7});", "&#", lambda c: F.hex(c.cast("bigint")), lambda c: c.cast("bigint"))
    text = folded(text, r"&#x([0-9A-Fa-f]{1,6});", "&#x", lambda c: c, lambda c: F.conv(c, 16, 10).cast("bigint"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def strip_html(html: Column) -> Column:
    """Plain text: line breaks kept, other tags become blanks, references decoded before and after."""
    t = decode_entities(html)
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    return stripped(decode_entities(t))


def strip_markdown(text: Column) -> Column:
    """Text without markdown escapes, emphasis, headings and links, with runs of blanks collapsed."""
    t = decode_entities(text)
    t = F.regexp_replace(t, r"\\([\\`*_{}\[\]()#+\-.!|>~&])", "$1")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\*\*|__|`", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return stripped(t)


def slugs(name: Column, website: Column | None = None) -> Column:
    """Distinct slug candidates of 3 to 60 characters: hyphened, joined, and the site's own name."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    made = [F.array_join(words, "-"), F.array_join(words, ""), F.get(words, F.lit(0))]
    if website is not None:
        host = F.regexp_extract(F.lower(website), r"^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)", 1)
        made.append(F.regexp_replace(host, r"\.[a-z.]+$", ""))
    return F.array_distinct(F.filter(F.array(*made), lambda s: F.length(s).between(3, 60)))


def posting_id(company: Column, title: Column, link: Column) -> Column:
    return F.md5(F.concat(company, title, strip_tracking(link)).cast("binary"))


def season_label(token: Column) -> Column:
    first, year = F.substring_index(token, "-", 1), F.substring_index(token, "-", -1)
    return F.when(first == "year", year).otherwise(F.concat(F.initcap(first), F.lit(" "), year))


def slug_name(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def trimmed_description(text: Column, most: int = 2000) -> Column:
    """A description without its marketing opener and its legal tail, cut at a sentence's end near `most` characters."""

    def without_opener(t):
        opener = F.left(t, F.lit(250)).rlike(r"(?i)\b(who we are|about (us|the company|the team)|our (mission|story|company)|company overview|founded in|we are a)\b")
        heading = F.regexp_instr(t, F.lit(r"(?i)(?=[tajprwy])(the role|about the role|job (summary|description)|position (summary|overview)|team overview|responsibilities|what you.ll do|your role)\s*:?"))
        return F.when(opener, let(heading, lambda h: F.when(h.between(201, 1801), F.substring(t, h, F.length(t))).otherwise(t))).otherwise(t)

    def without_tail(t):
        # the first letters are tested before the alternatives
        end = F.regexp_instr(t, F.lit(r"(?s)(?=[eErRbBWC])(?:(?i:equal opportunity|eeo statement|reasonable accommodation|benefits include)|WHAT WE OFFER|COMPENSATION|BENEFITS)"))
        return let(end, lambda e: F.when(e > 300, F.rtrim(F.substring(t, F.lit(1), e - 1))).otherwise(F.trim(t)))

    def capped(t):
        head = F.left(t, F.lit(most))
        sentence = F.length(F.regexp_extract(F.right(head, F.lit(200)), r"(?s)^(.*[.!?])(\s|$)", 1))
        return F.when(F.length(t) <= most, t).otherwise(let(sentence, lambda n: F.when(n > 0, F.substring(t, F.lit(1), most - 200 + n)).otherwise(head)))

    return let(let(let(F.coalesce(text, F.lit("")), without_opener), without_tail), capped)
