import random

import numpy as np
import pytest

from plumbline.llm import op10_anchors as m


def brute(rows, window):
    first = {}
    docs = {i: (t or "").encode().split() for i, t, *_ in rows if i is not None}
    for i, words in docs.items():
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


def corpus(rng, window, n=60):
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 2 * window))]
        rows.append((rng.choice([i, -i, 1000 - i]), rng.choice([" ", "\n", "\t "]).join(words), "x"))
    rows = list({r[0]: r for r in rows}.values())
    rows += [(5000 + k, rows[k % 7][1], "x") for k in range(20)]  # copies of whole texts
    rows += [(-9001, None, None), (-9002, "", "x"), (None, rows[3][1], "x"), (9000, " ".join(["same"] * (5 * window)), "x"), (8999, " ".join(["same"] * (2 * window)), "x")]
    return [*rows, rows[1]]


@pytest.mark.parametrize(("window", "seed", "packed"), [(50, 1, 10**6), (50, 2, 500), (7, 3, 200), (6, 4, 10**6)])
def test_against_brute_force(spark, monkeypatch, window, seed, packed):
    monkeypatch.setattr(m, "PACKED_WORDS", packed)
    monkeypatch.setattr(m, "BUCKET_ENTRIES", 700)
    rows = corpus(random.Random(seed), window)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = m.remove_repeats(docs, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, window)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= window for a, b in r.spans)


def test_packing():
    rng = np.random.default_rng(1)
    keys, places = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64), np.sort(rng.choice(10**7, 500, replace=False))
    back, at = m._unpack(m._pack(keys, places), 2)
    assert np.array_equal(back, keys >> np.uint64(16)) and np.array_equal(at, places)


def test_empty_table(spark):
    assert m.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
