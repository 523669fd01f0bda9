import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import lexical

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, q, **options).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ÄB", "x_y", "a-b", "\U0001d518"]
    texts = [" ".join(rng.choice(names) if rng.random() < 0.8 else names[0] for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return [(rng.choice([None, i, i, i % 7]), rng.choice([t, t, t, None, texts[0]])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"grid_docs": 3}, {"grid_postings": 25, "fan": 2}, {"grid_docs": 16, "held_bytes": 400}])
def test_against_brute_force(spark, options):
    docs = corpus(5, 300)
    items = [(i, t) for i, (_, t) in enumerate(corpus(6, 12))] + [(0, "w1 W2 w1"), (0, "w1 W2 w1"), (None, "w3 w4"), (3, ""), (4, None), (5, "nowhere"), (6, "Éa ÄB \U0001d518")]
    assert run(spark, docs, items, k=4, **options) == brute(docs, items, 4)


def test_odd_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta omega"), (2, "word x"), (3, "X" * 300_000)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=str)
    assert found == brute(rows, [tuple(r) for r in items.collect()], 20)
    assert lexical.search(no_docs, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    clash = lexical.search(docs.withColumnsRenamed({"id": "terms", "size": "n", "c1": "score"}), items.selectExpr("item_id", "text", "1 AS term", "2 AS times", "3 AS key"))
    assert sorted((tuple(r) for r in clash.collect()), key=str) == found


def test_treap_holds_its_points():
    rng = np.random.default_rng(3)
    for depth, rows, n in ((1, 2, 3), (3, 20, 60), (5, 100, 900)):
        cells = rng.choice(rows << depth, n, replace=False)
        cells = np.union1d(cells, np.arange(rows) << depth)  # a point in every row
        row, column, value = cells >> depth, cells & ((1 << depth) - 1), rng.integers(0, 50, len(cells))
        t = lexical.Treap.build(row, column, value, depth)
        assert len(t.mask) < 2.5 * len(cells) + rows
        t = lexical.Treap.unpacked(t.packed(), depth, len(t.mask), len(t.row)).opened()
        grid = np.zeros((rows, 1 << depth), int)
        grid[row, column] = value
        for _ in range(20):
            asked = rng.choice(rows, min(rows, 4), replace=False)
            weights, best = rng.integers(1, 9, len(asked)), lexical.Best(5)
            t.top(asked, weights, best, lexical.Ids(np.arange(1 << depth), 0))
            sums = weights @ grid[asked]
            want = sorted((-s, c) for c, s in enumerate(sums.tolist()) if s > 0)[:5]
            assert list(zip((-best.score).tolist(), best.id.tolist())) == want


def test_descent_leaves_most_of_a_large_grid(monkeypatch):
    """Documents with the item's rare words are found without opening most ranges."""
    rng = np.random.default_rng(4)
    depth, rows = 12, 4096
    cells = np.unique(np.r_[rng.choice(rows << depth, 200_000), np.arange(rows) << depth, (np.arange(40) << depth) + 77])
    row, column = cells >> depth, cells & ((1 << depth) - 1)
    value = np.where(column == 77, 900, rng.integers(300, 500, len(cells)))
    t = lexical.Treap.build(row, column, value, depth).opened()
    opened = []
    plain = lexical.Treap._bounds
    monkeypatch.setattr(lexical.Treap, "_bounds", lambda self, cell, *rest: opened.append(len(cell)) or plain(self, cell, *rest))
    best = lexical.Best(1)
    t.top(np.arange(40), np.ones(40, np.int64), best, lexical.Ids(np.arange(1 << depth), 0))
    assert best.id.tolist() == [77] and sum(opened) < 2 * (1 << depth) / 4


def test_corpus_sums_need_no_regular_expression(spark, monkeypatch):
    """The first pass cost three quarters of the query: Spark's expression ran twice over each text."""
    monkeypatch.setattr(lexical.F, "regexp_count", None)
    odd = [None, "", " ", "a", "-a", "a-", "É", "\0é\x7f\U0001d518_x", "Zz9 zZ", "x" * 70_000, "a " * 40_000, *(t for _, t in corpus(8, 200))]
    assert [lexical.size_of((t or "").encode()) for t in odd] == [len(words(t)) for t in odd]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    assert lexical.index(table)[1:] == lexical.totals(table.select("text")) == (sum(bool(words(t)) for t in odd), sum(len(words(t)) for t in odd))
    assert lexical.totals(table.select("text").limit(0)) == (0, 0)
    rng = random.Random(2)
    raw = [bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(500)]
    assert [lexical.size_of(x) for x in raw] == [len(lexical.terms_of(x)) for x in raw]
