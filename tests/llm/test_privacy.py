"""Personal data and secrets: brute-force versions of the added spans, long texts, many spans."""

import random
import re
import time
from collections import Counter, defaultdict
from math import log

import pytest
from pyspark.sql import functions as F
from test_operators import DOC, brute_pii, docs

from siftwell.llm import pii, secrets, spans


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 130, 5000])
def test_running_sums(spark, n):
    rnd = random.Random(n)
    sizes = [rnd.randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([(sizes,)], "x array<int>")
    sums, greatest = df.select(spans.running_sums(F.col("x")), spans.running_greatest(F.col("x"))).first()
    assert sums == [sum(sizes[:k]) for k in range(n)] and greatest == [max(sizes[: k + 1]) for k in range(n)]


def brute_terms(texts, least_contexts=3, generalise=0.85, remove=0.95):
    """doc number: {(start, end, action)} by counting in plain loops."""
    words = Counter(w for t in texts if t is not None for w in re.split(r"[^\w]|_", t.lower()) if len(w) >= 3)
    total = sum(words.values())
    near, spots, contexts, spells = defaultdict(list), set(), defaultdict(set), Counter()
    for n, text in enumerate(texts):
        runs = [m for m in re.finditer(r"[^\W_]+", text or "") if len(m[0]) >= 3 and m[0].isalpha()]
        for _, a, z, kind in brute_pii(text):
            entity = f"{kind}:{text[a:z].lower()}"
            before = [m for m in runs if m.end() <= a][-4:]
            around = before + [m for m in runs if m.start() >= z][:4]
            spots.add((entity, n, a))
            said = tuple(m[0].lower() for m in around)
            for m in around:
                near[entity, m[0].lower()].append((n, m.start(), m.end()))
                contexts[entity, m[0].lower()].add(said)
                spells[entity, m[0].lower()] += 1
    times = Counter(e for e, _, _ in spots)
    out = defaultdict(set)
    for (entity, term), where in near.items():
        share = log(min(1, spells[entity, term] / max(words[term], spells[entity, term]))) / max(log(max(total, 2) / times[entity]), 1e-9)
        if len(contexts[entity, term]) >= least_contexts and 1 + share >= generalise:
            for n, a, z in where:
                out[n].add((a, z, "removed" if 1 + share >= remove else "generalised"))
    return out


def planted_people(seed):
    """Texts in which some names stand by one entity only, and common words by all of them; (texts, the planted terms of each)."""
    rnd = random.Random(seed)
    plain = ["river", "stone", "garden", "window", "paper", "market", "bridge", "letter", "winter", "music"]
    texts, want = [], []
    for p in range(12):
        name, mail = f"name{'abcdefghijkl'[p]}sson", f"u{p}@corp.example"
        for _ in range(8):
            words = [rnd.choice(plain) for _ in range(30)]
            far = "x" * 90 if p % 3 == 0 else rnd.choice(plain)
            k = rnd.randint(5, 25)
            words[k:k] = [name, far, mail] if p % 2 else [mail, far, name]
            texts.append(" ".join(words))
            want.append({name})
    texts += [" ".join(rnd.choice(plain) for _ in range(60)) for _ in range(300)]
    return texts, want + [set()] * 300


def test_added_terms_equal_a_plain_count(spark):
    texts, want = planted_people(5)
    texts += ["", None, "mail u0@corp.example only", texts[0], "né u1@corp.example.x"]
    got = {r["doc_id"]: {(s["start"], s["end"], s["kind"]) for s in r["terms"]} for r in pii.find(docs(spark, texts)).collect()}
    brute = brute_terms(texts)
    assert all(got[n] == brute[n] for n in range(len(texts)))
    found = [{texts[n][a:z] for a, z, _ in got[n]} for n in range(len(want))]
    hits, planted, said = (sum(map(len, x)) for x in ([f & w for f, w in zip(found, want)], want, found))
    assert hits / planted >= 0.95 and hits / said >= 0.95, (hits, planted, said)


def test_long_domains_and_many_spans(spark):
    label = "a@" + "b." * 100_000 + "b end"
    digits = "7" * 200_000
    mails = " ".join(f"user{n} writes m{n}@corp.example today" for n in range(8_000))
    tokens = " ".join(f"token = abcdef{n:06d} here" for n in range(8_000))
    df = docs(spark, [label, digits, mails, tokens])
    start = time.time()
    found = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    assert [found[n]["n_email"] for n in range(4)] == [1, 0, 8_000, 0] and found[0]["spans"] == f"email:0:{len(label) - 4}"
    assert brute_pii(mails)[-1][1] == int(found[2]["spans"].split(",")[7_999].split(":")[1])
    scanned = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    assert scanned[3]["n_assign"] == 8_000 and scanned[0]["n_assign"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[2].count("[EMAIL]") == 8_000 and "@" not in clean[2] and clean[0] == "[EMAIL] end"
    assert time.time() - start < 60


def test_secret_model_on_planted_strings(spark):
    """Random strings among ordinary identifiers, both unseen in training."""
    rnd = random.Random(3)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = [w for w in "account balance customer document element function garden handler interval journal keyboard language message network operator".split()]
    key = lambda: "".join(rnd.choice(every) for _ in range(rnd.randint(24, 40))) + "7q"
    name = lambda: "_".join(rnd.choice(words) for _ in range(4)) + f"_{rnd.randint(0, 99)}"
    texts = [" ".join(rnd.choice(words) for _ in range(60)) + f" secret = {key()} ." for _ in range(150)]
    held = [(key(), True) for _ in range(200)] + [(name(), False) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts + [f"see {s} there" for s, _ in held])), DOC)
    got = {r["doc_id"]: r["n_markov"] for r in secrets.digest(secrets.scan(df)).collect()}
    hits = sum(got[150 + n] for n, (_, random_) in enumerate(held) if random_)
    false = sum(got[150 + n] for n, (_, random_) in enumerate(held) if not random_)
    assert hits >= 190 and false <= 10, (hits, false)
