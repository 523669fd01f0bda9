import math
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from gridloom.llm import pii


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def number(text):
    return re.sub("[^0-9]", "", text)


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
]


def brute_base(text):
    return sorted((m.start(), place, list(pii.PLACES)[place], m.end()) for place, (p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0]))


def long_texts(n):
    """Quadratic for the plain patterns, or deep for an engine that calls itself."""
    return ["7" * n, "1." * n + "1", "a@" + "b." * n + "c", "+" + "1 " * n, "a" * n + "@b.c", "12 " * n, "mail a@b.com " * (n // 4), "(" * n + "1", "a (at) " * (n // 4)]


ODD = [
    "a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 256.1.1.1 1.2.3.0000000000000000000000000000000000255", "+1 (314) 555-6532 4663622617512349 +1 (608) 555-2280 37.92.178.161 x",
    "4539 1488 0343 6467 4539148803436467, 4539-1488-0343-6467é", "𝔘𝔘 mail: ann.lee@mail.example.com\n𝔘 tel +49 (30) 1234-5678.", "write to bob (at) site [dot] org now", "call 030 1234 5678", "version 10.20.30.40", "token=80720808a7 sha 123456789012345",
    "+1 555 555 5555+1 555 555 5556", "a@b", "@", "+", "1", "12", "+12", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9-0", "1--2", "a@b..c", "a@-.-", "é1234567890123é",
]


@pytest.fixture(scope="module")
def texts(spark, docs):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rng = random.Random(9)
    parts = ["+1 (310) 555-4510", "4465758382889437", "10.77.3.200", "ann.5@mail.example.com", "tel", "the", "of", "card", "7712345678", "7712345679123456", "token", "80720808ab", "2.0", "ip", "mail"]
    mixed = spark.createDataFrame([(2000 + i, " ".join(rng.choices(parts, k=rng.randrange(1, 9)))) for i in range(300)], "doc_id long, text string")
    return docs.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 12").union(odd).union(mixed).cache()


def test_base_spans(spark, texts):
    table = texts.where("doc_id NOT IN (12, 13)").union(spark.createDataFrame([(3000, t) for t in long_texts(600)], "doc_id long, text string"))
    text = F.coalesce("text", F.lit(""))
    for r in table.select("text", pii.base_spans(text).alias("base")).collect():
        assert [tuple(x) for x in r.base] == brute_base(r.text or ""), (r.text or "")[:80]
    large = spark.createDataFrame([(t,) for t in long_texts(60_000)], "text string").select(pii.base_spans(text).alias("base"), pii.candidate_spans(text).alias("candidates"))
    assert [(r.base, r.candidates) for r in large.select(F.size("base").alias("base"), F.size("candidates").alias("candidates")).collect()] == [
        (0, 0), (15_000, 0), (1, 1), (0, 1), (1, 1), (0, 12_000), (15_000, 15_000), (0, 0), (0, 0)]


def read(text):
    """Candidates of a text by another engine: (start, end, span, before, after)."""
    out, at, found = [], 0, list(regex.finditer(pii.CANDIDATE, text))
    for m, after in zip(found, [*found[1:], None]):
        until = after.start() if after else len(text)
        out.append((m.start(), m.end(), m[0], text[at : m.start()][-pii.BEFORE :], text[m.end() : until][: pii.AFTER]))
        at = m.end()
    return out


def brute_kind(span):
    n = len(number(span))
    if regex.search(r"@|[(\[] ?(at|AT)", span):
        return "email"
    if span[0] == "+":
        return "phone" if 7 <= n <= 15 else None
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", span):
        return "ip"
    return "card" if 12 <= n <= 19 else "phone" if 7 <= n <= 11 else None


def brute_votes(kind, span, before, after, in_base):
    n, digits = len(number(span)), number(span)
    say = lambda yes: "1" if yes else "0"
    form = {
        "email": lambda: say(re.search(r"[.)\] ][A-Za-z]{2,}$", span)), "ip": lambda: say(all(int(x) <= 255 for x in span.split("."))), "card": lambda: say(luhn(digits)),
        "phone": lambda: "1" if span[0] == "+" and 9 <= n <= 15 else "0" if span[0] != "+" and span == digits else "-",
    }[kind]()
    listed = {
        "email": lambda: say(span.lower().endswith(tuple(s + d for d in pii.DOMAINS.split("|") for s in (".", "]", ")", ". ", "] ", ") ")))), "ip": lambda: say(not re.match(pii.NOBODY, span)),
        "card": lambda: say(re.match(f"(?:{pii.ISSUERS})", digits)), "phone": lambda: "-" if span[0] != "+" else say(re.match(f"(?:{pii.CALLING})", digits)),
    }[kind]()
    last = regex.search(r"(\p{L}[\p{L}\s-]*)?[^\p{L}]*$", before)[0]
    says = lambda words: regex.search(rf"(?i)(?<!\p{{L}})(?:{words})[^\p{{L}}]*$", last)
    inside = before[-1:].isalnum() or before[-1:] == "_" or after[:1].isalnum() or after[:1] == "_"
    plain = len(set(digits)) == 1 or digits.startswith(("1234567", "01234567"))
    return form + ("1" if in_base else "-") + listed + ("1" if says(pii.ANNOUNCED[kind]) else "-") + ("0" if says(pii.OTHERWISE) else "-") + say(not inside) + ("0" if plain else "-")


def test_whole_job_against_brute_force(spark, texts, no_docs):
    rows = pii.find(texts).collect()
    held = [(r.doc_id, r.text or "") for r in texts.collect()]
    by_kind, all_of = defaultdict(lambda: defaultdict(int)), []
    for doc, text in held:
        base = brute_base(text)
        for start, end, span, before, after in read(text):
            if kind := brute_kind(span):
                in_base = any(b[0] < end and start < b[3] for b in base)
                votes = brute_votes(kind, span, before, after, in_base)
                by_kind[kind][votes] += 1
                all_of.append((doc, kind, start, end, in_base, votes))
    found = pii.find(texts.select("doc_id", "text"))
    with_votes = pii._voted(texts.select(F.monotonically_increasing_id().alias("key"), pii.base_spans(F.coalesce("text", F.lit(""))).alias("base"), pii.candidate_spans(F.coalesce("text", F.lit(""))).alias("candidates")))
    assert sorted((r.kind, r.start, r.end, r.in_base, r.votes) for r in with_votes.collect()) == sorted(x[1:] for x in all_of)
    truth = {(k, v): p for k, counts in by_kind.items() for v, p in pii.estimate(sorted(counts.items()))[0].items()}
    assert truth["phone", "11111--"[:4] + "-1-"] > 0.9 if ("phone", "1111-1-") in truth else True
    assert all(p < 0.5 for (k, v), p in truth.items() if v[5] == "0" and "1" not in v)
    # the base spans stay, what is added overlaps none of them, and every planted span outside them is found
    assert sorted(str((r.id, [tuple(x) for x in r.base])) for r in rows) == sorted(str((i, brute_base(t))) for i, t in held)
    texts_of = dict(held)
    for r in found.collect():
        base, all_spans = [tuple(x) for x in r.base], [tuple(x) for x in r.found]
        assert all_spans == sorted(all_spans) and set(base) <= set(all_spans)
        for a, _, kind, b in set(all_spans) - set(base):
            assert not any(x[0] < b and a < x[3] for x in base)
            assert kind == brute_kind(texts_of[r.id][a:b])
        if r.id and r.id >= 2000:
            for m in re.finditer(r"\+1 \(310\) 555-4510|4465758382889437|10\.77\.3\.200|ann\.5@mail\.example\.com", texts_of[r.id]):
                assert any(a <= m.start() and m.end() <= b for a, _, _, b in all_spans), texts_of[r.id]
            assert not any(texts_of[r.id][a:b].startswith("80720808") for a, _, _, b in all_spans)
    assert pii.find(no_docs).count() == 0


def test_clashing_columns_and_repeats(spark, docs):
    clash = docs.withColumnsRenamed({"lang": "base", "source": "candidates", "norm": "found", "size": "key"})
    rows = pii.find(clash).collect()
    assert len(rows) == docs.count() and len({str(r.found) for r in rows if r.id == 13}) == 1


def test_estimate_finds_reliabilities():
    rng = random.Random(2)
    rates = [(0.95, 0.9), (0.8, 0.85), (0.7, 0.6), (0.9, 0.97), (0.6, 0.7)]
    counts, true = defaultdict(int), defaultdict(int)
    for _ in range(60_000):
        y = rng.random() < 0.3
        v = "".join("-" if rng.random() < 0.2 else str(int(rng.random() < a)) if y else str(int(rng.random() > b)) for a, b in rates)
        counts[v] += 1
        true[v] += y
    p, found = pii.estimate(sorted(counts.items()), rounds=200)
    for (a, b), (x, y) in zip(rates, found):
        assert x == pytest.approx(a, abs=0.03) and y == pytest.approx(b, abs=0.03)
    assert sum(abs(p[v] * n - true[v]) for v, n in counts.items()) / 60_000 < 0.06
    assert pii.estimate([]) == ({}, [])


def test_classifier_adds_log_ratios():
    prior, adds = pii._classifier([("ip", 0, "1", 3.0, 1.0), ("ip", 0, "-", 1.0, 4.0)])
    assert prior == {"ip": math.log(5 / 6)}
    assert adds["ip", 0, "1"] == pytest.approx(math.log(4 / 6) - math.log(2 / 7)) and adds["ip", 0, "-"] == pytest.approx(math.log(2 / 6) - math.log(5 / 7))
