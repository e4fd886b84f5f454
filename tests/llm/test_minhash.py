import random

import numpy as np
import pytest

from plumbline.llm import op08_minhash as m
from plumbline.llm.components import components
from plumbline.llm.shingles import shingle_set


def brute(rows, words, percent=80):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = low.encode().split()
        return {tuple(w[i : i + min(words, len(w))]) for i in range(len(w) - min(words, len(w)) + 1)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=repr)


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new"], [words[k], "more"]])
    return words


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, doc_id = [], 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((doc_id, " ".join(mutated(rng, base, rng.randrange(0, 7))), "x"))
            doc_id -= rng.choice([1, 1, -60])
        for step in range(4):  # a chain: each is near the last, the ends are not
            base = mutated(rng, base, max(1, len(base) // 40))
            rows.append((doc_id + 500 + step, " ".join(base), None))
        doc_id += 37
    rows = list({r[0]: r for r in rows}.values())
    rows += [(-1, None, "x"), (-2, "", "x"), (-3, " \n\t", "x"), (-4, "One", "x"), (-5, "one", None), (-6, "ONE two", "x"), (None, "one", "x"), (-7, "ÉTÉ été", "x"), (-8, "Été été", "x")]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(docs, words).collect()), key=repr)
    assert got == brute(rows, words)


def test_links_that_the_least_member_does_not_have(spark):
    # 40 texts on a path: text i and i + 1 are near, text 0 is near few; all share long runs, so buckets mix them
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: 400 - 12 * k] + [f"v{k}-{j}" for j in range(12 * k)])) for i, k in enumerate([0, 7, 3, 9, 1, 5, 8, 2, 6, 4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(docs, 2).collect())
    assert got == brute(rows, 2)


def test_signature_estimates_and_permutation():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(m._permute(x, 5))) == len(x)
    words = [f"w{i}" for i in range(900)]
    a, b = shingle_set(" ".join(words), 2), shingle_set(" ".join(words[:700] + ["z"] * 3 + words[700:800]), 2)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(np.mean(m.signature(a, 600) == m.signature(b, 600)) - true) < 0.06


def test_empty_table_and_components(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
