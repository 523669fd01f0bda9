import hashlib
import math

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.llm import common, exact_dedup, simhash

BLANKS = dict.fromkeys(map(ord, common.BLANKS))


def test_exact_groups(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(BLANKS), []).append(r)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for f in found:
        own = by_sha[f.sha256]
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert (f.keep_id, f.group_size) == (best.doc_id, len(own)) and (not f.kept or f.id == best.doc_id)
    assert sorted(f.sha256 for f in found if f.kept) == sorted(by_sha)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    assert exact_dedup.deduplicated(no_docs).count() == 0


def test_one_row_a_group_stays(spark):
    """Ids that repeat with other white space, null ids, and rows that repeat whole."""
    table = [(1, "a b"), (1, "ab"), (None, "x   y"), (None, "x y"), (2, "c d"), (2, "c\td"), (3, "e"), (3, "e"), (3, "e"), (4, None), (5, " "), (None, "f"), (6, "f")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(table)], "doc_id long, text string, _sha int")
    found = [(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [
        (1, 1, 2, True), (1, 1, 2, False), (None, None, 2, True), (None, None, 2, False), (2, 2, 2, True), (2, 2, 2, False), (3, 3, 3, True), (3, 3, 3, False), (3, 3, 3, False), (4, 5, 2, False), (5, 5, 2, True), (None, 6, 2, False), (6, 6, 2, True)]))
    kept = {(r.doc_id, r.text) for r in exact_dedup.deduplicated(df).collect()}
    assert kept - {(2, "c d"), (2, "c\td")} == {(1, "a b"), (None, "x   y"), (3, "e"), (5, " "), (6, "f")} and len(kept) == 6


def test_scratch_leaves_other_tables(spark, docs):
    lazy = simhash.near_duplicates(docs.select("doc_id", "text"))
    with common.scratch(spark):
        inner, path = common.spool(docs.select("doc_id"), "inner")
        assert inner.count() == docs.count()
    assert lazy.count() == docs.count()
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST|PATH"):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("tile", [2, 4, 16])
def test_links_between_groups_of_leaders(spark, tile):
    """Chains whose links join the groups of different leaders: sets of ten numbers, each next one moved by one."""
    orders = [[0, 3, 1, 2], [0, 6, 3, 1, 2, 5, 4], list(range(12)), [11, 0, 5, 6, 1, 10, 2, 9, 3, 8, 4, 7], [0, 3, 20, 23, 1, 2, 21, 22]]
    rows, families, want = [], [], {}
    for f, order in enumerate(orders):
        for i, at in enumerate(order):
            node = 1000 * f + i
            rows.append((node, np.arange(at, at + 10, dtype="<u8").tobytes()))
            families.append((node, 1000 * f))
            want[node] = 1000 * f + min(j for j, x in enumerate(order) if all(y in order for y in range(min(x, at), max(x, at) + 1)))
    sets = spark.createDataFrame(rows, "id long, hashes binary")
    edges = simhash._family_links(spark.createDataFrame(families, "node long, component long"), sets, 0.8, tile=tile)
    found = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert found == {n: c for n, c in want.items() if sum(x == c for x in want.values()) > 1}


def test_two_large_groups_and_a_bridge(spark):
    """Default settings: two groups of 300 copies, whose only link is between two further texts."""
    words = [f"w{i}" for i in range(121)]
    texts = [" ".join([*words[:105], f"a{i}"]) for i in range(300)] + [" ".join([*words[16:], f"b{i}"]) for i in range(300)] + [" ".join(words[4:109]), " ".join(words[12:117])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component for r in simhash.verified_duplicates(rows, shingle=1).collect()} == {0}


def brute_fingerprint(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aA é\n\t\x0b", max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
def test_fingerprint(text, k):
    assert simhash.fingerprint(text.encode(), k) == brute_fingerprint(text, k)


def test_fingerprint_of_long_text(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog again and again " * 50
    whole = simhash.fingerprint(text.encode(), 4)
    monkeypatch.setattr(simhash, "RUN_BYTES", 64)
    assert simhash.fingerprint(text.encode(), 4) == whole == brute_fingerprint(text, 4)


def components(codes, distance):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize(("tile", "blocks"), [(8192, 6), (40, 6), (8192, 7)])
def test_links_of_families(spark, tile, blocks):
    """Families of codes around random centres: chains at the limit, pairs beyond it, one family larger than a tile."""
    rng = np.random.default_rng(7)
    codes = set()
    for size in (300, 20, 20, 5, 1, 1):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            codes.add(x ^ sum(1 << int(b) for b in flips))
            x = x if size != 5 else x ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
    codes = sorted(codes)
    table = spark.createDataFrame([(simhash._signed(c), simhash._signed(c)) for c in codes], "node long, fp long")
    edges = simhash.links(table, 4, blocks, tile, short=8)
    assert edges.count() < len(codes) * 4 * math.comb(blocks, 4)
    for e in edges.collect():
        assert bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= 4
    found = {r.node & (1 << 64) - 1: r.component for r in common.connected_components(edges).collect()}
    own = components(codes, 4)
    for i, c in enumerate(codes):
        mates = {codes[j] for j in range(len(codes)) if own[j] == own[i]}
        if len(mates) > 1:
            assert {x for x, y in found.items() if y == found[c]} == mates
        else:
            assert c not in found


def test_near_duplicates(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    codes = [brute_fingerprint(r.text, 4) for r in rows]
    own = components(codes, 4)
    want = sorted((str(r.doc_id), c, min((rows[j].doc_id for j in range(len(rows)) if own[j] == own[i] and rows[j].doc_id is not None), default=None) or -1) for i, (r, c) in enumerate(zip(rows, codes)))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(f.id), f.fp & (1 << 64) - 1, f.component if f.component is not None else -1) for f in found) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7), (2, 1), (1, 2)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[k] == 1 for k in range(1, 50))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hub", [0, 10_000])
def test_components_of_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "SPLIT", 16)
    edges = [(hub, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in [hub, *range(1, 3000)]} == {min(hub, 1)} and {found[5000 + k] for k in range(41)} == {5000}


def test_all_pairs_of_short_keys(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    codes = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(40)})
    table = spark.createDataFrame([(i, simhash._signed(c)) for i, c in enumerate(codes)], "node long, fp long")
    want = {(i, j) for j in range(len(codes)) for i in range(j) if bin(codes[i] ^ codes[j]).count("1") <= 6}
    for short in (64, None):
        assert {(e.a, e.b) for e in simhash.links(table, 6, short=short).collect()} == want


def test_forest_keeps_edges_of_short_keys(spark):
    """x-y and x-w are the forest of a long key; x and y also share short keys. All three are one family."""
    x, y, w = 0, sum(1 << 8 * b for b in range(2, 7)), sum(2 << 8 * b for b in range(2, 8))
    table = spark.createDataFrame([(0, x), (1, y), (2, w)], "node long, fp long")
    edges = simhash.links(table, 6, blocks=8, short=2)
    assert {(e.a, e.b, e.whole) for e in edges.where("partial").collect()} == {(0, 1, True), (0, 2, False)}
    families = common.connected_components(edges.where("partial").select("a", "b"))
    assert {(r.node, r.component) for r in families.collect()} == {(0, 0), (1, 0), (2, 0)}


@pytest.mark.parametrize(("short", "tile", "leaders"), [(64, 512, 4), (2, 512, 4), (2, 4, 0), (2, 4, 1), (2, 4, 40)])
def test_verified_duplicates(spark, docs, no_docs, short, tile, leaders):
    """Edits of one word in long texts link, other texts of the same words do not."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for family in range(6):
        base = list(rng.choice(words, 200))
        for _ in range(8):
            text = list(base)
            text[int(rng.integers(200))] = "edited"
            rows.append((n, " ".join(text), "x"))
            n += 1
        rows.append((n, " ".join(rng.permutation(base)), "x"))
        n += 1
    rows += [(900, None, "x"), (901, "", "x"), (None, rows[0][1], "x"), (902, "a b", "x"), (903, "A  b", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, node string")
    found = {r.id: r.component for r in simhash.verified_duplicates(table, short=short, tile=tile, leaders=leaders).collect()}
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) for i, t, _ in rows[:n]}
    for i in sets:
        same = [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert found.get(i, i) == min(same)
    assert found[902] == found[903] == 902
    assert simhash.verified_duplicates(no_docs).count() == 0
    assert simhash.verified_duplicates(docs).count() >= 3


def test_rows_that_share_an_id(spark):
    """Rows of one id, null ids, repeated rows and ties: one row of each group stays, no other text goes."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text + " end"), (7, "something else"), (7, "something else"), (3, text + " x"), (None, text), (None, text + " y z"), (None, "alone"), (9, None), (9, ""), (8, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.verified_duplicates(table, short=2)
    assert sorted((str(r.id), str(r.component), r.kept) for r in found.collect()) == [("3", "3", True), ("7", "3", False), ("8", "8", True), ("9", "8", False), ("None", "3", False), ("None", "3", False)]
    gone = found.where("NOT kept").select("node", "digest")
    left = table.select("*", *simhash.row_keys()).join(gone, ["node", "digest"], "left_anti")
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(str(r) for r in spark.createDataFrame([rows[1], rows[2], rows[3], rows[6], rows[9]], "doc_id long, text string").collect())


def test_tiles_of_a_family_of_millions(spark):
    """Two million ids make 3,907 tiles of 512: pairs of tiles stay apart as numbers, and any two nodes meet in one."""
    tiles, nodes = 3907, [5, 1_999_999]
    rows = spark.createDataFrame([(n, tiles) for n in nodes], "node long, tiles int")
    a, b = (set(r.p) for r in rows.select(simhash._tile_pairs(rows.node, rows.tiles).alias("p")).collect())
    assert len(a) == len(b) == tiles and len(a & b) == 1
    pairs = {divmod(x, 1 << 31) for x in a}
    assert all(0 <= i <= j < tiles for i, j in pairs)


@pytest.mark.parametrize(("short", "hot", "shard"), [(64, 50, 1 << 20), (1, 50, 1 << 8), (64, 2, 1 << 8), (1, 2, 1 << 20)])
def test_cut_and_extended_copies(spark, monkeypatch, short, hot, shard):
    """Passages cut or appended move many bits of a fingerprint; every pair with the similarity is still found."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)] + "the same line ends each of these texts".split()
        cut, more = int(rng.integers(90, 128)), [f"m{x}" for x in rng.integers(0, 5000, int(rng.integers(1, 30)))]
        texts += [words, words[:cut], words[-cut:], words + more][: 4 if k % 2 else 2]
    sets = [set(zip(*[t[k:] for k in range(5)])) for t in texts]
    parent = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if x == b else x for x in parent]
                codes = [simhash.fingerprint(" ".join(texts[x]).encode(), 1, distinct=True) for x in (i, j)]
                far += (codes[0] ^ codes[1]).bit_count() > 6
    assert far > 10
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.id: r.component for r in simhash.verified_duplicates(table, short=short, tile=16).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == parent
