import math
import random

from pyspark.sql import functions as F

from plumbline.llm import op07_mix as m


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in cut]
        left = total - sum(cut.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: limit * sizes[s] for s in free if share[s] > limit * sizes[s]}
        if not over:
            return {**share, **cut}
        cut |= over


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies string")


def test_targets_and_rounding(spark):
    rng = random.Random(3)
    rows, doc_id = [], 0
    for source, n in (("a", 700), ("é", 150), ("b", 12), ("Z", 90), (None, 60), ("", 8), ("zz", 40)):
        for _ in range(n):
            rows.append((doc_id, " ".join(["w"] * rng.choice([1, 5, 40, 80])), source, "x", None))
            doc_id += 1
    rows += [(doc_id, None, "a", None, None), (doc_id + 1, " \t\n", "b", None, None), (7, rows[7][1], "a", "x", None)]
    got = m.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 5, source
    again = m.mix(table(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in got)


def test_newton_with_base_rates_and_a_limit(spark):
    mass = spark.createDataFrame([("a", 0.1, 1000), ("a", 2.0, 500), ("b", 1.0, 10), ("c", 1.0, 0), (None, 0.5, 40)], "source string, q double, tokens long")
    targets = spark.createDataFrame([("a", 2400.0), ("b", 30.0), ("c", 0.0), (None, 5.0)], "source string, target double")
    lam = {r.source: r["lambda"] for r in m.balance(mass, targets).collect()}
    assert abs(1000 * min(3, 0.1 * math.exp(lam["a"])) + 500 * min(3, 2 * math.exp(lam["a"])) - 2400) < 1e-4
    assert abs(10 * min(3, math.exp(lam["b"])) - 30) < 1e-6 and abs(40 * 0.5 * math.exp(lam[None]) - 5) < 1e-6


def test_newton_ends_next_to_a_kink(spark):
    """Lambda steps cut at one unit would go to and fro here; one step alone misses the targets."""
    mass = spark.createDataFrame([("a", 1.0, 10**6), ("a", 0.5, 10), ("b", 1.0, 900), ("b", 0.5, 100), ("b", 0.75, 300)], "source string, q double, tokens long")
    targets = spark.createDataFrame([("a", 3e6 + 20.0), ("b", 3900.0)], "source string, target double")

    def given(steps):
        lam = {r.source: r["lambda"] for r in m.balance(mass, targets, steps=steps).collect()}
        return {s: sum(r.tokens * min(3, r.q * math.exp(lam[s])) for r in mass.collect() if r.source == s) for s in lam}

    whole, first = given(60), given(1)
    assert abs(whole["a"] - 3e6 - 20) < 0.01 and abs(whole["b"] - 3900) < 1e-4
    assert abs(first["a"] - 3e6 - 20) > 1 and abs(first["b"] - 3900) > 10


def test_texts_of_symbols_are_taken_less_often(spark):
    rows = [(i, "ab cd ef gh" if i % 2 else "#1 $2 %3 &4", "s" if i < 4000 else "t", None, None) for i in range(5000)]
    got = m.mix(table(spark, rows)).collect()
    target = {r.source: r.target / r.source_size for r in got}
    for source in "st":
        part = [r for r in got if r.source == source]
        mean = [sum(r.copies for r in part if r.doc_id % 2 == k) / (len(part) / 2) for k in (1, 0)]
        # base rates: 1 for letters; 3 of 11 characters are blanks: 0.5 + 0.5 * 9 / 32 for symbols
        lam, low = 0.0, 0.5 + 0.5 * 9 / 32
        for _ in range(200):
            lam += 0.5 * (target[source] - (min(3, math.exp(lam)) + min(3, low * math.exp(lam))) / 2)
        assert abs(mean[0] - min(3, math.exp(lam))) < 0.02 and abs(mean[1] - min(3, low * math.exp(lam))) < 0.02, source


def test_rows_without_an_id_are_told_apart(spark):
    rows = [(None if i % 2 else 5, f"w{i} " * (i % 7), "s" if i % 3 else None, None, None) for i in range(600)]
    docs = table(spark, rows).withColumn("n", F.monotonically_increasing_id())
    got = m.mix(docs, row_col="n").collect()
    assert len({r.n for r in got}) == len(got) == 600
    for source in ("s", None):
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 6


def test_empty_tables(spark):
    assert m.mix(table(spark, [])).count() == 0
    one = m.mix(table(spark, [(1, None, None, None, None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in one] == [(0, 0, 0.0, 0)]
