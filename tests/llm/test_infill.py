import re
from hashlib import sha256

import pytest

from gridloom.llm import infill


def brute(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = sha256(b"1:" + (b"" if doc is None else str(doc).encode())).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (len(units), "plain", None, None, text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (len(units), form, len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m if form == "spm" else "<P>" + p + "<S>" + s + "<M>" + m)


ODD = ["<P>", "a <S> b", "<M", "<<P", "x<P", "<S<P<M", "P>S>M>", "é𝔘a b", "\r\n\t", "a", " ", "ß1a2", "a" * 700_000, "1" * 600_000 + "ab", "ab1" * 300_000]


def test_rows(spark, docs, no_docs):
    odd = spark.createDataFrame([(1000 + 7 * i + k, t) for i, t in enumerate(ODD) for k in range(7)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd)
    found = infill.transform(table)
    found = found.withColumn("text", infill.restored(found.output, found.form)).collect()
    want = [(r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in table.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.transform(no_docs).count() == 0
    clash = infill.transform(docs.withColumnsRenamed({"lang": "n", "source": "form", "norm": "output"}))
    assert clash.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"] and clash.count() == docs.count()


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 100])
def test_stretches_find_the_same_units(stretch):
    for text in ["", "a", "ab cd", "a1b22ccc  d\n", "𝔘𝔘ab" * 9, "abcdefgh" * 9, "1234567" * 3, "é a" * 11]:
        assert list(infill.Units(stretch)(text)) == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
