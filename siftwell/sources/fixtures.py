"""The postings table derived from the supplied orders, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TITLES = [
    "Software Engineer Intern", "Backend Engineer Intern, Summer 2026", "Data Science Intern (Remote)", "Frontend Developer Co-op - Fall 2026",
    "PhD Research Engineer Intern", "Marketing Intern", "Machine Learning Intern - Winter 2026", "Software Engineer", "Hardware Engineer Intern",
    "Security Engineer Internship Summer 2025", "Research Intern", "Platform Engineer Intern (Fall / Winter 2026)", "Quantitative Developer Intern '26",
    "DevOps Intern [Hybrid]", "Full-Stack Intern, NYC", "Intern", "Product Marketing Intern", "SWE Intern - Spring 2027", "AI Engineer Intern 2027",
    "Data Engineer Co-op (Summer/Fall 2026)", "MBA Intern", "Cloud Infrastructure Intern - closed", "Undergrad Engineering Intern", "Legal Intern",
    "Systems Engineer Intern - Autumn 2026", "Web Developer Internship", "Summer 2026 Software Engineer Intern", "Mobile Engineer Intern, San Francisco",
    "Data Analyst Intern - Summer 2020", "Embedded Software Intern", "Sales Development Intern", "Site Reliability Intern (Winter 2027)",
    "Cybersecurity Intern", "Computer Vision Intern - Remote", "Operations Intern", "NLP Research Scientist Intern", "API Engineer Intern",
    "Graduate Software Engineer Intern", "Blockchain Engineer Intern, Spring 2026", "Software Testing Intern - User Growth",
]
COMPANIES = [
    "Stripe", "Stripe, Inc.", "NVIDIA", "NVIDIA AI", "Adobe Systems", "Adobe", "Amazon.com", "Amazon Web Services", "Box", "Box Inc", "Black Box Corp",
    "Snyk", "Coinbase", "QUADRIC", "Quadric", "Costco", "🔥   Apple", "Two Sigma Investments LLC", "Snowflake", "Corp LLC", "Anthropic",
    "Samsung Research America (SRA)", "Al Warren Oil Company, Inc.", "Palo Alto Networks",
]
LOCATIONS = [
    "Cambridge, United Kingdom", "Hsinchu, Taiwan", "Moscow, Russia", "Abidjan, Ivory Coast", "Edinburgh, Scotland", "DE - Berlin", "CA-ON-MISSISSAUGA-P22M01",
    "IN-Pune", "Las Cruces, New Mexico", "AZ - Chandler", "CA - San Francisco", "", "Remote", "New York, NY", "San Francisco, CA", "Austin, Texas Metropolitan Area",
    "Cambridge, MA USA", "San Mateo, CA United States", "Reutlingen, BW, de", "Wilmington, DE", "Boston, UK", "NYC", "Working in San Francisco", "Remote in Poland",
    "Office: Bangalore", "Remote in USA", "Toronto", "Seattle, WA", "Dublin, OH / Hybrid", "Nowhere",
]
SOURCES = ["Greenhouse", "Lever", "Ashby", "Workday", "SimplifyJobs", "Linkedin", "Indeed", "Handshake"]
PAY = [
    "Pays $25-30/hr in season", "$28.50 per hour", "Stipend of $5,000-$6,000/month", "New Grad $120-180k", "Base $80k-$120k", "around $95k", "$50,000-$75,000 per year",
    "$80,000/year", "Internship Unpaid. $120,000-$180,000 in assets.", "We raised $50,000-$75,000 in our seed round.", "tips of $3/hr", "no figure here",
]


def _values(rows: list[str], quote: str = "''") -> str:
    return ", ".join("({}, '{}')".format(n, row.replace("'", quote)) for n, row in enumerate(rows))


def postings_cte(spark: bool = False) -> str:
    """The CTEs up to `postings`. Spark and DuckDB escape quotes differently."""
    values = lambda rows: _values(rows, "\\'" if spark else "''")
    return f"""
    d_title(n, title) as (select * from (values {values(TITLES)}) as t(n, title)),
    d_company(n, company) as (select * from (values {values(COMPANIES)}) as t(n, company)),
    d_location(n, location) as (select * from (values {values(LOCATIONS)}) as t(n, location)),
    d_source(n, source) as (select * from (values {values(SOURCES)}) as t(n, source)),
    d_pay(n, pay) as (select * from (values {values(PAY)}) as t(n, pay)),
    numbered as (select cast(o_orderkey as bigint) as k, cast(o_custkey as bigint) as c, cast(o_orderdate as timestamp) + interval 25 year as posted_at,
                        case when o_orderkey % 6 = 1 or o_orderkey % 12 = 8 then o_orderkey - 1 else o_orderkey end as ln from orders),
    postings as (
        select k as seq, 'p' || cast(case when k % 3 <> 0 and k % 15 = 1 then k - 1 else k end as varchar(20)) as id,
               'Team ' || cast(k % 97 as varchar(20)) || ' ' || d_title.title as title, company, location, source,
               case when k % 11 = 0 then 'https://simplify.jobs/p/' else 'https://jobs.example.com/' end || cast(ln as varchar(20))
                   || case when k % 5 = 0 then '?utm_source=x&ref=y' else '' end as link,
               posted_at, posted_at + interval 1 day * cast(k % 60 as int) as seen_at, pay,
               k % 17 = 0 as applied, k % 23 = 0 as hidden, cast(case when k % 29 = 0 then 2 else 0 end as int) as failed_check_count,
               k % 31 = 0 as archived, k % 3 = 0 as stored
        from numbered join d_title on d_title.n = k % {len(TITLES)} join d_company on d_company.n = c % {len(COMPANIES)}
             join d_location on d_location.n = (k * 7 + c) % {len(LOCATIONS)} join d_source on d_source.n = k % {len(SOURCES)} join d_pay on d_pay.n = k % {len(PAY)})"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived postings: five broadcast dimensions of fixed size on one scan of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # narrow rows are dealt out evenly before the costly expressions, as splits of a file differ in rows: a small table to
    # all cores, one with splits enough to four tasks for each. By a number of partitions, as adaptive execution would join them again.
    cores, splits = spark.sparkContext.defaultParallelism, orders.rdd.getNumPartitions()
    orders = orders.repartition(cores if splits < cores else 4 * splits, "o_orderkey")
    return postings_of(orders)


def postings_of(orders: DataFrame) -> DataFrame:
    """The postings of these orders."""
    text = postings_cte(spark=True).replace("from orders)", "from {orders})")
    return orders.sparkSession.sql(f"with {text} select * from postings", orders=orders)
