"""Landed payloads to partial postings: one projection per payload shape, input (source, target_slug, fetched_at, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators.rules import INTERN, redirect_link

#: Characters of a body that are kept.
MOST_BODY = 20_000

GREENHOUSE = "struct<jobs:array<struct<id:bigint,title:string,updated_at:string,absolute_url:string,location:struct<name:string>,content:string>>>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,descriptionPlain:string,categories:struct<location:string,commitment:string>>>"
ASHBY = "struct<jobBoard:struct<jobPostings:array<struct<id:string,title:string,locationName:string,employmentType:string,publishedDate:string,isRemote:boolean>>>>"
WORKDAY = "struct<jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>>"
SMART = "struct<content:array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string>>>>"
RIPPLING = "array<struct<uuid:string,name:string,url:string,workLocation:struct<label:string>>>"
WORKABLE = "struct<results:array<struct<shortcode:string,title:string,published:string,remote:boolean,location:struct<city:string,region:string,country:string>>>>"
YC = "struct<props:struct<jobs:array<struct<id:bigint,title:string,jobType:string,location:string,salaryRange:string,companyName:string,oneLiner:string,url:string>>>>"
FACETS = "struct<facets:array<struct<facetParameter:string,values:array<struct<descriptor:string,id:string>>>>>"


def _body(text: Column, most: int | None) -> Column:
    """A landed description, cut at `most` characters; None keeps it whole."""
    return text if most is None else F.left(text, F.lit(most))


def _intern(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(INTERN)


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ", ")


def _rows(payloads: DataFrame, schema: str, path: str | None) -> DataFrame:
    parsed = F.from_json("body", schema)
    return payloads.select("source", "target_slug", "fetched_at", F.explode(parsed if path is None else parsed[path] if "." not in path else parsed[path.split(".")[0]][path.split(".")[1]]).alias("j"))


def _seed(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select("source", "target_slug", F.col("fetched_at").alias("seen_at"), *[c.alias(n) for n, c in columns.items()])


def greenhouse(payloads: DataFrame, most: int | None = MOST_BODY) -> DataFrame:
    rows = _rows(payloads, GREENHOUSE, "jobs").where(_intern(F.col("j.title")))
    link = F.coalesce("j.absolute_url", F.concat(F.lit("https://boards.greenhouse.io/"), "target_slug", F.lit("/jobs/"), F.col("j.id").cast("string")))
    return _seed(rows, title=text.decode_entities(F.col("j.title")), location=F.coalesce("j.location.name", F.lit("")), link=link, job_id=F.col("j.id").cast("string"), posted=F.col("j.updated_at"), description_html=_body(F.col("j.content"), most))


def lever(payloads: DataFrame, most: int | None = MOST_BODY) -> DataFrame:
    rows = _rows(payloads, LEVER, None).where(_intern(F.col("j.text")) | (F.lower("j.categories.commitment") == "internship"))
    place = F.coalesce(F.nullif(F.col("j.categories.location"), F.lit("")), F.when(F.lower("j.workplaceType") == "remote", "Remote"), F.lit(""))
    return _seed(rows, title=F.col("j.text"), location=place, link=F.col("j.hostedUrl"), job_id=F.col("j.id"), posted=F.timestamp_millis("j.createdAt").cast("string"), description=_body(F.col("j.descriptionPlain"), most))


def ashby(payloads: DataFrame) -> DataFrame:
    inner = F.regexp_extract("body", r"(?s)window\.__appData\s*=\s*(\{.*?\});?\s*</script>", 1)
    rows = payloads.select("source", "target_slug", "fetched_at", F.explode(F.from_json(inner, ASHBY)["jobBoard"]["jobPostings"]).alias("j")).where(_intern(F.col("j.title")) | (F.lower("j.employmentType") == "intern"))
    place = F.when(F.coalesce("j.isRemote", F.lit(False)), "Remote").otherwise(F.coalesce("j.locationName", F.lit("")))
    return _seed(rows, title=F.col("j.title"), location=place, link=F.concat(F.lit("https://jobs.ashbyhq.com/"), "target_slug", F.lit("/"), "j.id"), job_id=F.col("j.id"), posted=F.col("j.publishedDate"))


def workday(payloads: DataFrame) -> DataFrame:
    """target_slug is tenant/instance/board/name."""
    rows = _rows(payloads, WORKDAY, "jobPostings").where(_intern(F.col("j.title")))
    part = lambda n: F.get(F.split("target_slug", "/"), F.lit(n))
    place = F.when((F.coalesce("j.locationsText", F.lit("")) == "") | (F.col("j.locationsText") == part(3)), "United States").otherwise(F.col("j.locationsText"))
    link = F.concat(F.lit("https://"), part(0), F.lit("."), part(1), F.lit(".myworkdayjobs.com/"), part(2), "j.externalPath")
    return _seed(rows, title=F.col("j.title"), location=place, link=link, job_id=F.element_at(F.split("j.externalPath", "/"), -1), posted=F.col("j.postedOn"))


def intern_facets(payloads: DataFrame) -> DataFrame:
    """target_slug, facets: map of parameter to the ids whose descriptor means an internship."""
    one = payloads.select("target_slug", F.posexplode(F.from_json("body", FACETS)["facets"]).alias("at", "f"))
    values = one.where(F.col("f.facetParameter").isin("jobFamilyGroup", "workerSubType")).select("target_slug", F.col("f.facetParameter").alias("param"), F.posexplode("f.values").alias("place", "v"))
    hits = values.where(_intern(F.col("v.descriptor"))).groupBy("target_slug", "param").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v.id"))), lambda x: x["id"]).alias("ids"))
    return hits.groupBy("target_slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "ids")))).alias("facets"))


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, SMART, "content").where(_intern(F.col("j.name")))
    place = F.coalesce(F.nullif(_joined(F.col("j.location.city"), F.col("j.location.region"), F.col("j.location.country")), F.lit("")), F.lit("United States"))
    return _seed(rows, title=F.col("j.name"), location=place, link=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "target_slug", F.lit("/"), "j.id"), job_id=F.col("j.id"), posted=F.col("j.releasedDate"))


def rippling(payloads: DataFrame) -> DataFrame:
    """One row per uuid, its distinct locations in order."""
    parsed = payloads.select("source", "target_slug", "fetched_at", F.posexplode(F.from_json("body", RIPPLING)).alias("place", "j")).where(_intern(F.col("j.name")))
    rows = parsed.groupBy("source", "target_slug", "fetched_at", "j.uuid").agg(F.min_by("j", "place").alias("j"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("place", "j.workLocation.label"))), lambda x: x["label"])).alias("places"))
    places = F.filter("places", lambda p: p.isNotNull() & (p != ""))
    return _seed(rows, title=F.col("j.name"), location=F.coalesce(F.get(places, F.lit(0)), F.lit("")), link=F.col("j.url"), job_id=F.col("uuid"), multi_location=F.when(F.size(places) > 1, places))


def workable(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, WORKABLE, "results").where(_intern(F.col("j.title")))
    city = _joined(F.col("j.location.city"), F.col("j.location.region"), F.col("j.location.country"))
    place = F.when(F.coalesce("j.location.city", F.lit("")) != "", city).when(F.coalesce("j.remote", F.lit(False)), "Remote").otherwise(F.coalesce("j.location.country", F.lit("")))
    return _seed(rows, title=F.col("j.title"), location=place, link=F.concat(F.lit("https://apply.workable.com/"), "target_slug", F.lit("/j/"), "j.shortcode", F.lit("/")), job_id=F.col("j.shortcode"), posted=F.col("j.published"))


def yc(payloads: DataFrame) -> DataFrame:
    """The page's attribute holds escaped JSON."""
    inner = text.decode_entities(F.regexp_extract("body", r'data-page="([^"]*)"', 1))
    rows = payloads.select("source", "target_slug", "fetched_at", F.explode(F.from_json(inner, YC)["props"]["jobs"]).alias("j")).where(F.lower("j.jobType") == "intern")
    return _seed(rows, title=F.col("j.title"), company=F.col("j.companyName"), location=F.coalesce("j.location", F.lit("")), link=F.col("j.url"), job_id=F.col("j.id").cast("string"), description=F.nullif(F.concat_ws("\n", "j.salaryRange", "j.oneLiner"), F.lit("")))


def list_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, place, href, label of each list item with a link."""
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("place", "item"))
    return items.select("page_id", "place", F.regexp_extract("item", r'href="([^"]*)"', 1).alias("href"), text.strip_html(F.col("item")).alias("label")).where("href <> ''")


def icims(payloads: DataFrame) -> DataFrame:
    items = payloads.select("source", "target_slug", "fetched_at", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("item"))
    link = F.regexp_extract("item", r'href="([^"]*/jobs/(\d+)/[^"]*)"', 1)
    title = text.strip_html(F.regexp_extract("item", r"(?s)<h[23][^>]*>(.*?)</h[23]>", 1))
    rows = items.withColumns({"link": link, "title": title}).where((F.col("link") != "") & _intern(F.col("title")))
    return _seed(rows, title=F.col("title"), link=F.col("link"), job_id=F.regexp_extract("link", r"/jobs/(\d+)/", 1))


# Markers of direct application links, the preferred ones.
DIRECT = "greenhouse.io|lever.co|ashbyhq.com|myworkdayjobs.com|icims.com|smartrecruiters.com|rippling.com|workable.com|jobvite.com|oraclecloud.com"


def apply_link(cell: Column) -> Column:
    """The first direct link of a cell, else the first by a wrapper, else the first."""
    links = F.regexp_extract_all(cell, F.lit(r'href="([^"]+)"'), F.lit(1))
    first = lambda test: F.get(F.filter(links, test), F.lit(0))
    return F.coalesce(first(lambda u: u.rlike(DIRECT.replace(".", r"\."))), first(lambda u: F.contains(u, F.lit("simplify.jobs"))), F.get(links, F.lit(0)))


def cell_locations(cell: Column) -> Column:
    """Locations of a table cell: one a line, without the counter."""
    lines = F.split(F.regexp_replace(F.regexp_replace(cell, r"(?i)</?(br|summary|details|strong)[^>]*>", "\n"), "<[^>]+>", ""), "\n")
    return F.filter(F.transform(lines, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\d+$") & ~F.contains(F.lower(p), F.lit("location")))


def table_rows(payloads: DataFrame) -> DataFrame:
    """Rows of an HTML table: company, title, location, [season,] link, age; headers, continuations and short rows go."""
    rows = payloads.select("source", "target_slug", "fetched_at", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    rows = rows.withColumn("td", F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)))
    company = text.strip_html(F.get("td", F.lit(0)))
    rows = rows.withColumn("company", company).where((F.size("td") >= 5) & (F.col("company") != "↳"))
    places = cell_locations(F.get("td", F.lit(2)))
    return _seed(rows, company=text.without_emoji(F.col("company")), title=text.strip_html(F.get("td", F.lit(1))), location=F.coalesce(F.get(places, F.lit(0)), F.lit("")), multi_location=F.when(F.size(places) > 1, places), link=apply_link(F.element_at("td", -2)), season=F.when(F.size("td") >= 6, text.strip_html(F.get("td", F.lit(3)))))


def scraped(rows: DataFrame, most: int | None = MOST_BODY) -> DataFrame:
    """Job-board scrape rows (seq, site, title, company, location, job_url, date_posted, description): usable ones, each once."""
    clean = lambda c: F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("nan", "none"), "").otherwise(F.trim(F.coalesce(c, F.lit(""))))
    r = rows.select("seq", F.initcap(clean("site")).alias("source"), *[clean(c).alias(n) for c, n in (("title", "title"), ("company", "company"), ("location", "location"), ("job_url", "link"))], F.try_to_timestamp("date_posted").alias("posted_at"), _body(clean("description"), most).alias("description"))
    r = r.where((F.col("title") != "") & (F.col("company") != "") & (F.col("link") != "") & ~redirect_link(F.col("link"), ["glassdoor.com", "ziprecruiter.com"]) & _intern(F.col("title")))
    r = r.withColumn("row_id", text.posting_id(F.col("company"), F.col("title"), F.col("link")))
    return r.groupBy("row_id").agg(F.min_by(F.struct(*r.columns), "seq").alias("_r")).select("_r.*")


def cards(rows: DataFrame) -> DataFrame:
    """Card labels (label, company, footer) to role, pay and location."""
    body = F.trim(F.when(F.startswith("label", F.col("company")), F.substring(F.col("label"), F.length("company") + 1, F.length("label"))).otherwise(F.col("label")))
    rows = rows.withColumn("_body", body)
    pay = F.regexp_extract("_body", r"(\$[\d,.]+(?:[–-]\$?[\d,.]+)?(?:K|k)?(?:/(?:hr|mo|yr|wk))?)", 1)
    cut = F.least(*[F.nullif(F.regexp_instr("_body", F.lit(p)), F.lit(0)) for p in (r"\$[\d,.]+", r"\bUnpaid\b", " · ")])
    tail = F.trim(F.regexp_replace("_body", r"(?i)(\s+(internship|full-time|part-time|remote|\d+(d|wk|mo) ago))+$", ""))
    role = F.when(cut.isNotNull(), F.trim(F.substring(F.col("_body"), F.lit(1), cut - 1))).otherwise(tail)
    bits = F.filter(F.transform(F.split("footer", "[∙·]"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"(?i)^(promoted|viewed|saved|\d+\s*(h|d|wk|mo)\s*ago)$"))
    return rows.select(*[c for c in rows.columns if c != "_body"], role.alias("role"), F.nullif(pay, F.lit("")).alias("pay"), F.coalesce(F.get(bits, F.lit(0)), F.lit("")).alias("card_location"))


def with_company(cards_: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with the company of the detail table where their own is missing; those still without one go."""
    joined = cards_.join(details.select("job_id", F.col("company").alias("_company")), "job_id", "left")
    return joined.withColumn("company", F.coalesce(F.nullif(F.col("company"), F.lit("")), "_company")).where("company is not null and company <> ''").drop("_company")


def without_company(cards_: DataFrame, details: DataFrame) -> DataFrame:
    """The cards that `with_company` drops."""
    named = details.where("company is not null and company <> ''").select("job_id").distinct()
    return cards_.where("company is null or company = ''").join(named, "job_id", "left_anti")


def assembled_description(rows: DataFrame) -> DataFrame:
    """Plain text wins; else the HTML with its list sections, each under its heading. rows: plain, html, lists array<struct<text,content>>."""
    sections = F.transform("lists", lambda s: F.concat_ws("\n", s["text"], text.strip_html(s["content"])))
    built = F.concat_ws("\n\n", F.nullif(text.strip_html(F.coalesce("html", F.lit(""))), F.lit("")), F.nullif(F.array_join(sections, "\n\n"), F.lit("")))
    return rows.withColumn("description", F.nullif(F.coalesce(F.nullif(F.trim("plain"), F.lit("")), built), F.lit("")))


def with_fetched(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows with descriptions and resolved links landed by link; an unresolved link stays."""
    joined = rows.join(fetched.select("link", F.col("description").alias("_d"), F.col("resolved").alias("_r")), "link", "left")
    return joined.withColumns({"description": F.coalesce("description", "_d"), "link": F.coalesce("_r", "link")}).drop("_d", "_r")


def built_rows(seeds: DataFrame) -> DataFrame:
    """Seeds (title, company, location, link, source, seen_at, upstream_posted_at, description, description_html) as posting rows."""
    iso = F.when(F.col("upstream_posted_at").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp("upstream_posted_at"))
    described = F.coalesce(F.nullif(text.strip_html(F.coalesce("description_html", F.lit(""))), F.lit("")), F.nullif(F.trim("description"), F.lit("")))
    described = F.when(F.coalesce("description_html", F.lit("")) != "", F.nullif(text.strip_html(F.col("description_html")), F.lit(""))).otherwise(described)
    return seeds.withColumns({"company": text.without_emoji(F.col("company")), "location": F.coalesce("location", F.lit("")), "posted_at": F.coalesce(iso, "seen_at"), "description": described}).drop("upstream_posted_at", "description_html")
