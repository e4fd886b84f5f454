import itertools
import random
import re
import zlib
from collections import Counter

from plumbline.llm import op11_variants as m


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, uses=5):
    counts = Counter()
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= uses}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def edited(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abcdéÿ")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word + c])


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "àéîõüÿ", "Ünlike"]
    uses = []
    for w in base:
        uses += [w] * rng.choice([5, 30, 200])
        for v in {edited(rng, w) for _ in range(6)}:
            uses += [v] * rng.choice([4, 5, 6, 29])
            uses += [edited(rng, v)] * 5
    rng.shuffle(uses)
    rows = [(k, " ".join(uses[i : i + 90]).title() + "_x2é3\n", "own") for k, i in enumerate(range(0, len(uses), 90))]
    rows += [(None, "without an id " * 3, "x"), (-1, None, None), (-2, "", "x"), rows[0], (-3, "aaaaaa·aaaaaa AAAAAA ÀÉÎÕÜŸ " * 40, "x")]
    got = m.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, word string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect()) == brute(rows)
    assert m.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randrange(3, 8)))
        costs = [rng.randrange(9) for _ in places]
        a, b = m.pivots(places, costs)
        price = dict(zip(places, costs, strict=True))
        assert b - a >= 2 and price[a] + price[b] == min(price[x] + price[y] for x, y in itertools.combinations(places, 2) if y - x >= 2)


def test_every_edit_meets_in_the_index():
    rng = random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 10)))
        other = edited(rng, word)
        if len(other) < 6 or other == word:
            continue
        frequency = {a + b: rng.randrange(1, 9) for a in "abcdéÿ" for b in "abcdéÿ"}
        (last, index, probes), (other_last, other_index, other_probes) = m.keys_of(word, frequency), m.keys_of(other, frequency)
        assert set(probes) & set(other_index) if last <= other_last else set(other_probes) & set(index)
