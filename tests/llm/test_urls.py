"""URL judging against plain loops: hosts, rules, n-gram features and gradient descent."""

import hashlib
import math

from conftest import SMALL
from test_operators import odd
from pyspark.sql import functions as F

from siftwell.llm import queries, urls

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    return rest[:cut].translate(UPPER_TO_LOWER), path[:end]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_features(host, path):
    out = set()
    for salt, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in (3, 4):
            for k in range(len(text) - n + 1):
                h = salt
                for c in text[k : k + n]:
                    h = h * 131 + ord(c)
                out.add(h % 1_000_003 % 1024)
    return out


def brute_verdicts(pages):
    labels = {}
    for url in {u for u in pages.values() if u is not None}:
        rule, verdict = brute_rule(*brute_parts(url))
        if rule:
            labels[url] = float(verdict == "block")
    labels = {u: labels[u] for u in sorted(labels, key=lambda u: (hashlib.md5(u.encode()).hexdigest(), u))[:2000]}
    rows = [(brute_features(*brute_parts(u)), y) for u, y in labels.items()]
    n, positive = len(rows), sum(labels.values())
    w, b = [0.0] * 1024, math.log(positive / (n - positive))
    for _ in range(16):
        g, all_ = [0.0] * 1024, 0.0
        for f, y in rows:
            e = y - 1 / (1 + math.exp(-(b + sum(w[k] for k in f))))
            all_ += e
            for k in f:
                g[k] += e
        w = [x * (1 - 2.0 * 1e-4) + 2.0 * v / n for x, v in zip(w, g)]
        b += 2.0 * all_ / n
    out = {}
    for page, url in pages.items():
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        out[page] = (host, path, rule, verdict or ("block" if b + sum(w[k] for k in brute_features(host, path)) > 0 else "allow"))
    return out


def test_verdicts_equal_plain_loops(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    want = brute_verdicts(pages)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op8_urls(spark, SMALL).collect()}
    assert got == want


def test_long_urls_ties_and_clashing_names(spark):
    long = "http://a.b/" + "x/" * 200_000
    rows = [(1, long), (2, "http://" + "s." * 50_000 + "org/"), (3, None), (4, ""), (4, ""), (5, "HTTP://Example.ORG/en/1#x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("_features", "_rest", "rule_verdict", "_page", "host")})
    got = urls.judge(df, rules=[*urls.RULES, ("block", "example.org", "/en/1")])
    assert set(got.columns) == {*df.columns, "path", "rule", "score", "verdict"}
    by_id = {r["page_id"]: r for r in got.collect()}
    assert by_id[5]["rule"] == "example.org/en/1" and by_id[5]["verdict"] == "block" and by_id[2]["rule"] == "org/" and by_id[1]["path"] == long[10:]
    assert by_id[5]["_features"] == "mine" and by_id[5]["rule_verdict"] == "mine" and by_id[5]["host"] == "example.org" and by_id[3]["host"] == ""
    assert got.count() == 6 and urls.judge(df.limit(0)).count() == 0
    assert urls.judge(odd(spark).withColumnRenamed("text", "url")).count() == 10
