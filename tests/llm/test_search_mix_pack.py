import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.llm import mixing, packing, topk


@pytest.mark.parametrize(("query_rows", "shard_rows", "groups", "fan"), [(3, 16, (2, 5), 2), (1024, 8192, None, 16), (1, 1, (1, 300), 7)])
def test_top_k(spark, query_rows, shard_rows, groups, fan):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 7]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [1.0, 2.0]), (306, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5, rows[5][1]), (400, [1e14, 1e9, 0.0, 3.0]), (450, []), (451, []), (500, [1e6, -2e6, 0.5, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, ids string")
    found = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, query_rows=query_rows, shard_rows=shard_rows, groups=groups, fan=fan).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = [g for g in good if g[0] % 50 == 0]
    for q, a in asked:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:5]
        if all(-s < 2**63 for s, _ in scores):
            assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert found[450] == [(1, 451, 0)]
    empty = df.limit(0)
    assert topk.top_k(empty, empty).count() == 0


def test_groups_grow_with_the_tables():
    assert topk._groups(0, 0, 0, 8) == (1, 1)
    assert topk._groups(1 << 20, 1 << 24, 7, 8) == (1, 7)
    small, large = (topk._groups(n << 30, n << 36, n << 14, 8) for n in (1, 10))
    assert large[0] == 10 * small[0] and large[1] == 10 * small[1]


def test_two_vectors_of_a_length(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), k=5).collect()] == [(0, 1, 1, 256 * 512)]


def fair(sizes, weights=(1, 2, 3), limit=3):
    """Targets by handing out and capping, over and over."""
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while left:
        rest = total - sum(limit * sizes[i] for i in range(len(sizes)) if i not in left)
        share = {i: rest * w[i] / sum(w[j] for j in left) for i in left}
        over = {i for i in left if share[i] > limit * sizes[i]}
        if not over:
            for i in left:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(limit * sizes[i])
        left -= over
    return target


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 100, 3, 1000, 2], [0, 10, 0], [7], [1, 1, 1, 1, 1, 1, 500]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    for i, t in enumerate(fair(sizes)):
        assert found[f"s{i}"] == pytest.approx(t)


def test_mix(spark, docs, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect() if r.doc_id is not None}
    assert all(r.size == words[r.id] for r in rows if r.id is not None)
    assert all(0 <= r.copies <= 3 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    many = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "concat('s', cast(id % 7 as string)) as source")
    sums, goal = defaultdict(int), {}
    for r in mixing.mix(many).collect():
        sums[r.source] += r.copies * r.size
        goal[r.source] = r.target
        assert abs(r.copies - r.target / r.source_size) < 1
    assert all(abs(sums[s] - goal[s]) <= 80 for s in goal)
    assert mixing.mix(no_docs).count() == 0
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    own = packing.Tokenizer(*(str(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken")), public_tokenizers.PATTERN)
    return own, reference


@given(st.text(alphabet="abé'st 1!\n\t\u00a0\u3000ß𝔘\x1c", max_size=40))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_tokens_equal_those_of_tokenizers(tokens, text):
    own, reference = tokens
    ids = reference.encode(text, add_special_tokens=False).ids
    assert own.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "a " + "\n" * 5000 + " b", "hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b ", "<|endoftext", "x  y", " x y", "x y ", "né" * 3000 + " b c"])
def test_long_runs_and_added_tokens(tokens, text):
    own, reference = tokens
    ids = reference.encode(text, add_special_tokens=False).ids
    assert own.ids(text) == own.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def fewest(sizes, capacity):
    """The least number of bins, by trying all places for each size, largest first."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= sizes[k]
                place(k + 1, rest)
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 12), min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_plan_against_exhaustive_search(sizes):
    counts = {n: sizes.count(n) for n in sizes}
    bins = max(first + -(-(b - a) // row) for _, a, b, first, row, _ in packing.plan(counts, 12))
    assert bins <= fewest(sorted(sizes, reverse=True), 12) + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan(counts):
    slots = packing.plan(counts, 30)
    bins = defaultdict(list)
    for n, a, b, first, row, offset in slots:
        for k in range(b - a):
            bins[first + k // row].append((offset + k % row * n, n))
    for content in bins.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 30
    packed = defaultdict(int)
    for content in bins.values():
        for _, n in content:
            packed[n] += 1
        assert sum(3 * n > 30 for _, n in content) <= 2
    assert packed == counts
    assert len(bins) <= 1.3 * -(-sum(n * c for n, c in counts.items()) // 30) + 1 + sum(c for n, c in counts.items() if 2 * n > 30)


def test_pack(docs, no_docs, tokens):
    _, reference = tokens
    found = packing.pack(docs).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*reference.encode(r.text or "", add_special_tokens=False).ids, 2]
        at, piece, size = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            part = ids[at : at + size]
            want[r.doc_id, piece, at, size, zlib.crc32(struct.pack(f"<{size}I", *part))] += 1
            at, piece, size = at + size, piece + 1, 1024
    have, places = defaultdict(int), defaultdict(list)
    for f in found:
        have[f.id, f.piece, f.start, f.length, f.crc] += 1
        places[f.sequence].append((f.offset, f.length))
    assert have == want
    for content in places.values():
        ends = np.cumsum([n for _, n in sorted(content)])
        assert [o for o, _ in sorted(content)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packing.pack(no_docs).count() == 0
