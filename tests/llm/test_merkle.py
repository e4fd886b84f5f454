import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op09_merkle as m


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab .!\n#é\r\x0b")), max_size=400), st.text(st.sampled_from(list("ab .!\n#é")), max_size=400))
def test_roots_and_leaves(a, b):
    x, y = m.Tree(a), m.Tree(b)
    assert (x.root == y.root) == (a == b)
    assert sum(n * c for (_, n), c in x.leaves.items()) == len(a)
    assert m.likeness(x.text(), y.text()) == pytest.approx(1.0 if a == b else m._alike(x.leaves, y.leaves))
    assert m.differing(x.text(), x.text()) == []


def test_an_edit_is_located():
    lines = [f"Line number {i} says this. And that too!\n" for i in range(60)]
    changed = lines.copy()
    changed[17] = "Line number 17 says something else. And that too!\n"
    a, b = m.Tree("".join(lines)).text(), m.Tree("".join(changed)).text()
    found = m.differing(a, b)
    assert len(found) == 1 and 0.95 < m.likeness(a, b) < 1
    flat = [(i, k) for i, (_, body) in enumerate(m._SECTION.findall(a)) for k, _ in enumerate(m._PARAGRAPH.findall(body))]
    assert flat.index(found[0]) == 17
    words = [f"w{i}" for i in range(3000)]
    assert m.likeness(m.Tree(" ".join(words)).text(), m.Tree(" ".join(words[:1500] + ["new"] + words[1500:])).text()) > 0.95


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_document_and_odd_rows(spark, parts):
    texts = ["", None, "a", "ab.", "Some words here. More of them!\n" * 9, "x " * 5000, "é中🙂" * 5, "Some words here. More of them!\n" * 9]
    rows = [(i * 7 % 61, f"{i} " + (texts[i % len(texts)] or ""), "z") for i in range(61)] + [(5, None, None), (5, None, None), (None, "no id at all", "q"), (-3, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = m.edit_report(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    order = sorted(((d is None, -(d or 0), t or "", d) for d, t, _ in rows))
    want = set()
    for i, (_, _, text, doc_id) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        cut = len(text) // 3
        want.add((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest(), m.Tree(text).text()))
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got} == want
    assert all(0 <= r.near_next <= 1 and r.near_edited == pytest.approx(m.likeness(r.fingerprint, r.edited_fingerprint)) for r in got)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.edit_report(empty).count() == 0 and m.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(4, "alone in here")], "doc_id long, text string")
    assert m.edit_report(one).first().near_next == 1.0
    assert m.fingerprints(one).first().fingerprint == m.Tree("alone in here").text()
