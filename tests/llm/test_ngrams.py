import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from test_text_ops import brute_probability

import corpus_pipeline
from gridloom.llm import ngrams, quality


def grams_of(text):
    signs = "\n" * 3 + "".join("0" if "0" <= x <= "9" else x for x in text or "")
    return [tuple(signs[i : i + 4]) for i in range(len(signs) - 3)]


def test_bags_hold_every_ngram():
    rng = random.Random(3)
    for letters in ("ab\0", "".join(map(chr, range(0x4E00, 0x9000))) + "𝔘"):  # the second alphabet needs ranks of pairs
        texts = ["".join(rng.choices(letters, k=n)) for n in (1, 3, 400, 60_000)]
        runs = [np.frombuffer(("\n\n\n" + t).encode("utf-32-le"), np.uint32) for t in texts]
        found = Counter()
        for shard, grams, sizes, places, counts in ngrams.bags(runs, [1, 2, 5, 9], 3):
            assert (ngrams._shard_of(grams, 3) == shard).all() and (ngrams._places(ngrams._steps(places, sizes), sizes) == places).all()
            for g, p, n in zip(np.repeat(grams, sizes, axis=0).tolist(), places.tolist(), counts.tolist()):
                found[tuple(map(chr, g)), p] += n
        assert found == Counter((g, p) for t, p in zip(texts, (1, 2, 5, 9)) for g in grams_of(t))


def test_bags_of_many_pieces(monkeypatch):
    monkeypatch.setattr(ngrams, "PIECE", 50)
    rng = random.Random(4)
    for letters in ("ab", "".join(map(chr, range(0x4E00, 0x9000))) * 4 + "𝔘"):
        texts = ["".join(rng.choices(letters, k=rng.choice([1, 2, 30, 49, 50, 51, 300]))) for _ in range(60)] + ["".join(rng.choices(letters, k=40_000))]
        runs = [np.frombuffer(("\n\n\n" + t).encode("utf-32-le"), np.uint32) for t in texts]
        found = Counter()
        for _, grams, sizes, places, counts in ngrams.bags(runs, list(range(61)), 3):
            for g, p, n in zip(np.repeat(grams, sizes, axis=0).tolist(), places.tolist(), counts.tolist()):
                found[tuple(map(chr, g)), p] += n
        assert found == Counter((g, p) for p, t in enumerate(texts) for g in grams_of(t))


def test_bags_hold_few_bytes_a_character():
    """A whole block is in a worker at once, beside the executor's heap: 37 bytes a character of this
    text, where it was 74."""
    rng = np.random.default_rng(1)
    runs = [rng.integers(97, 123, 1003).astype(np.uint32) for _ in range(ngrams.BLOCK)]
    points = sum(map(len, runs))
    tracemalloc.start()
    for _ in ngrams.bags(runs, list(range(ngrams.BLOCK)), ngrams.SHARDS):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 * points, most / points


def test_costs_match_brute_force(spark, monkeypatch):
    """In small blocks and runs, with repeated and null rows; characters are told apart, in every plane."""
    for name, value in (("BLOCK", 4), ("CHARS", 60), ("RUN", 16), ("GROUP", 2)):
        monkeypatch.setattr(ngrams, name, value)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abÉéчж𝔘 d.17", k=rng.randrange(1, 50))) for _ in range(40)] + [None, "", "zz É7"]
    rows = [(i, t, [None, "en"][i % 2]) for i, t in enumerate([*texts, *texts[:5]])] + [(None, "no id", "en"), (0, texts[0], None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {r.text: r.fold for r in table.select("text", ngrams.fold_of("text", 2).alias("fold")).collect()}
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    found = ngrams.costed(table, trusted).collect()
    size = len({g[-1] for _, t, _ in rows for g in grams_of(t)}) + 1
    want = []
    for f in (0, 1):
        p = brute_probability(dict(Counter(g for i, t, _ in rows if i is not None and i < 30 and fold[t] != f for g in grams_of(t))), 4, size)
        want += [(i, lang, -sum(np.log(max(p(g), 1e-12)) for g in grams_of(t)), len(t or "")) for i, t, lang in rows if fold[t] == f]
    key = lambda r: (str(r[0]), str(r[1]), r[-1], r[-2])
    found = sorted([(r.doc_id, r.lang, r._cost, r._symbols) for r in found], key=key)
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want, key=key)):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], abs=1e-3)


def test_letters_are_not_folded(spark):
    """Letters that share a symbol of the closed alphabet: 13 code points apart."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("абвг ", k=200)) for _ in range(60)]
    shifted = ["".join(chr(ord(x) + 13) if x != " " else x for x in t) for t in texts[:5]]
    signs = quality.alphabet()
    assert all((signs[[ord(x) for x in a]] == signs[[ord(x) for x in b]]).all() for a, b in zip(texts, shifted))
    table = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts + shifted)], "doc_id long, text string, lang string")
    found = {r.id: r.keep for r in quality.classify(table, table.where("doc_id < 60").selectExpr("doc_id", "1 AS quality")).collect()}
    assert sum(found[i] for i in range(60)) >= 58 and not any(found[60 + i] for i in range(5))


def test_pipeline_does_not_fold_letters(spark, tmp_path):
    """The stage leaves out the texts of other letters, copies too, and keeps rows and columns as they are."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("абвг ", k=200)) for _ in range(60)]
    shifted = ["".join(chr(ord(x) + 13) if x != " " else x for x in texts[k]) for k in (0, 1, 1)]
    table = spark.createDataFrame([(i, t, "ru", 7) for i, t in enumerate(texts + shifted)], "doc_id long, text string, lang string, middle int")
    table.where("doc_id < 60").selectExpr("doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, table, str(tmp_path))
    assert kept.columns == table.columns and kept.subtract(table).count() == 0
    assert kept.where("doc_id < 60").count() >= 58 and kept.where("doc_id >= 60").count() == 0
