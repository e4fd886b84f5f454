import random

import pytest

from plumbline.llm import op04_lines as m


def near(a, b):
    """One word put in, left out or exchanged at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def words_of(line):
    return [w.decode() for w in line.encode().split()]


def brute(rows, least):
    first = {}
    for i, text, *_ in rows:
        for at, line in enumerate((text or "").split("\n") if i is not None else []):
            if w := tuple(words_of(line)):
                first[w] = min(first.get(w, (i, at)), (i, at))
    close = {w for w in first if len(w) >= least and any(len(v) >= least and first[v] < first[w] and near(w, v) for v in first if v != w)}
    out = []
    for i, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        fate = [2 if i is not None and tuple(words_of(x)) in close else 1 if i is not None and words_of(x) and first[tuple(words_of(x))] < (i, at) else 0 for at, x in enumerate(lines)]
        out.append((i, None if text is None else "\n".join(x for x, f in zip(lines, fate, strict=True) if not f), len(lines), fate.count(1), fate.count(2)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "seed"), [(5, 1), (5, 2), (1, 3), (2, 4)])
def test_against_brute_force(spark, least, seed):
    rng = random.Random(seed)
    pool = [[rng.choice("abcd") + rng.choice(["", "x", "y"]) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 20]))] for _ in range(25)]
    rows = []
    for i in range(45):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            words = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(words)) if words else 0
                words[k : k + 1] = rng.choice([[], ["new"], [*words[k : k + 1], "a"], ["a", *words[k : k + 1]]])
            lines.append(rng.choice([" ", "\t", "  "]).join(words) + rng.choice(["", " ", "\r"]))
        rows.append((rng.choice([1, -1]) * (1 + i * 17 % 45), "\n".join(lines), "x", None))
    rows += [(900, None, "x", 1), (901, "", "x", None), (902, "\n \n\t", "x", None), (None, rows[3][1], None, None), (903, " ".join(["w"] * 4000) + "\n" + " ".join(["w"] * 3999), "x", 5), rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near string, n_exact int").repartition(3)
    got = m.dedup_lines(docs, least, counts=("lines", "exact", "close"))
    assert got.columns == ["doc_id", "text", "near", "n_exact", "lines", "exact", "close"]
    assert sorted(((r.doc_id, r.text, r.lines, r.exact, r.close) for r in got.collect()), key=repr) == brute(rows, least)
    assert m.dedup_lines(docs).columns == ["doc_id", "text", "near", "n_exact", "n_lines", "n_near"]


def test_pairs_and_plan(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four FIVE six"), (3, "one two three four five six seven\nquite another line of words here")], "id long, text string")
    _, _, close = m.near_lines(docs)
    assert sorted((r.other_id, r.other_at) for r in close.collect()) == [(1, 0), (1, 0)]
    plan = m.dedup_lines(docs.withColumnRenamed("id", "doc_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert m.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
