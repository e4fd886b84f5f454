import random

import numpy as np
import xxhash

from plumbline.llm import op12_simhash as m

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - min(4, len(words)) + 1)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=4):
    prints = [(i, plain(t)) for i, t in rows]
    parent = {i: i for i, _ in prints if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if a is not None and b is not None and (x ^ y).bit_count() <= bits:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, f"{p:016x}", root(i) if i is not None else None) for i, p in prints), key=repr)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(12)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i, text in rows[:60]:  # near copies of real texts
        words = text.split(" ")
        for k in range(3):
            words[rng.randrange(len(words))] = "changed"
            rows.append((10_000 + 10 * i + k, " ".join(words)))
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "One two"), (-5, "ONE TWO"), (None, "one two"), (None, None), rows[5], (rows[7][0], "another text of the same id"), (-9, "another text of the same id"), (-10, "ÉTÉ été " * 70)]
    got = m.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int"))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == brute(rows)
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def linked(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def test_small_and_large_cells_find_every_link(spark):
    # few random fingerprints, dense groups around some of them, and pairs at exactly 4 and 5 bits in any split over the halves
    rng = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {rng.getrandbits(64) for _ in range(50)}
    for x in list(prints):
        prints |= {flip(x, n) for n in (1, 2, 3, 4, 5, 6)}
    for x in list(prints)[:3]:
        prints |= {flip(x, rng.randrange(1, 9)) for _ in range(50)}
    prints = np.array(sorted(prints), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    signed = prints.view(np.int64).tolist()
    every = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    for hot, block in ((m.HOT, m.BLOCK), (9, 8), (9, 1000)):
        got = [(r.a, r.b) for r in m.near_pairs(nodes, hot=hot, block=block).collect()]
        assert linked(got) == linked(every)


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(9)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6)))
        bound = sum(abs((x >> s & 3).bit_count() - (y >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert bound <= (x ^ y).bit_count()
    signed = np.array([0, 0xFFFFFFFFFFFFFFFF, 0x5555555555555555], dtype=np.uint64).view(np.int64).tolist()
    sizes = {r.fp: r.n for r in spark.createDataFrame([(x,) for x in signed], "fp long").selectExpr("fp").withColumn("n", m.F.size(m.cells(m.F.col("fp")))).collect()}
    assert [sizes[x] for x in signed] == [34, 34, 66]  # no step below 0 or above 2
