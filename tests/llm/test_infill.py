import random
import re

import numpy as np
import pytest

from plumbline.llm import op13_infill as m

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def parts(text, unit):
    if unit == "chars":
        return list(text)
    return TOKEN.findall(text) if unit == "tokens" else re.findall(r"[^\n]*\n|[^\n]+", text)


def brute(doc_id, text, unit="tokens"):
    u, (h1, h2, h3, h4) = parts(text or "", unit), m.drawn(42, doc_id)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(s in text for s in m.SENTINELS) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(u), form, len(x), len(y), m.joined(form, x, y, z)


def random_text(rng):
    return "".join(rng.choice(["a", "é", "漢", "😀", " ", " ", "\n", "\t", "\r", " ", "word", ".", "<", "P>"]) for _ in range(rng.randrange(0, 40)))


def test_matrix_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, n).astype(np.uint8)
        matrix = m.WaveletMatrix(values)
        at = np.arange(n + 1)
        for v in range(8):
            assert matrix.rank(v, at).tolist() == [0, *np.cumsum(values == v)]


@pytest.mark.parametrize("unit", ["tokens", "lines", "chars"])
def test_every_cut_of_a_block(unit):
    rng = random.Random(unit)
    texts = [random_text(rng) for _ in range(200)] + ["", " ", "\n", "a", " a", "a ", "\n\na\n\n"]
    units = m.Units(texts, unit)
    pieces = [parts(t, unit) for t in texts]
    assert units.count().tolist() == [len(p) for p in pieces]
    for k in range(max(map(len, pieces)) + 1):
        got = units.cut(np.array([min(k, len(p)) for p in pieces]))
        assert got.tolist() == [len("".join(p[:k])) for p in pieces]


def test_against_brute_force_and_back(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 64)  # texts longer than a block, blocks of several texts
    rng = random.Random(13)
    rows = [(i, random_text(rng) * rng.choice([1, 1, 9]), "own") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "no id at all " * 9, "x"), (3, rows[3][1], "own"), (1002, "holds <P> itself", None), (1003, " \n ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    made = m.fill_in_middle(docs, told=("units", "form", "prefix_chars", "middle_chars"))
    got = made.collect()
    assert sorted(((r.doc_id, r.n, r.units, r.form, r.prefix_chars, r.middle_chars, r.text) for r in got), key=repr) == sorted(
        ((i, n, *brute(i, t)) for i, t, n in rows), key=repr
    )
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert sorted((r.doc_id, r.text, r.n) for r in m.restore(made).filter("doc_id IS NOT NULL AND text IS NOT NULL").collect()) == sorted(r for r in rows if r[0] is not None and r[1] is not None)
    assert "n" in m.fill_in_middle(docs).columns and m.fill_in_middle(docs).schema["n"].dataType.simpleString() == "bigint"
    assert m.fill_in_middle(docs.limit(0)).count() == 0
