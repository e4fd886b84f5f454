import random

import numpy as np

from plumbline.llm import op03_language as lang
from plumbline.llm.common import held_out

PARTS = {"aa": ["ka", "lo", "mi", "tra"], "bb": ["eau", "tion", "ré", "ou"], "cc": ["ung", "sch", "ä", "ei"], "dd": ["ка", "ло", "ми"]}


def text(rng, name, n):
    return " ".join("".join(rng.choice(PARTS[name]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_filters_against_sets():
    rng = random.Random(1)
    grams = {name: np.unique(lang.ngrams(text(rng, name, 400))) for name in PARTS}
    filters = lang.LanguageFilters.build(grams)
    for i, name in enumerate(filters.languages):
        mask = filters.masks(grams[name])[0]
        assert np.all(mask & np.uint8(1 << i))  # nothing learned is missed
    other = lang.ngrams("".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(20000)))
    hit = filters.masks(other)[0]
    for i in range(len(filters.languages)):
        assert np.mean((hit >> np.uint8(i)) & 1) < 3 * filters.chance[i] + 0.002


def test_more_than_64_languages():
    grams = {f"l{i:03d}": lang.ngrams(chr(0x4E00 + 50 * i) + "".join(chr(0x4E00 + 50 * i + k % 50) for k in range(300))) for i in range(70)}
    filters = lang.LanguageFilters.build(grams)
    assert len(filters.slots) == 2
    assert filters.decide("".join(chr(0x4E00 + 50 * 66 + k % 50) for k in range(40)))[0] == "l066"


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, name := rng.choice(list(PARTS)), rng.randint(5, 60)), name, "s") for i in range(800)]
    odd = [(9000, None, "aa", None), (9001, "", None, None), (9002, "12 !? \n", "bb", None), (None, text(rng, "cc", 9), None, "s"), (9003, text(rng, "dd", 30000), None, "s"), (1, rows[1][1], rows[1][2], "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    filters = lang.learn(docs.filter(~held_out(docs.doc_id)))
    got = lang.predict(docs, filters)
    assert got.count() == len(rows) + len(odd)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    true = {r[0]: r[2] for r in rows}
    kept = [r.doc_id for r in docs.filter(held_out(docs.doc_id)).collect() if r.doc_id in true]
    assert len(kept) > 100 and np.mean([found[i][0] == true[i] for i in kept]) > 0.98
    assert found[9000] == found[9001] == found[9002] == ("und", 0.0)
    assert found[None][0] == "cc" and found[9003][0] == "dd" and all(0 <= s <= 1 for _, s in found.values())
    nothing = lang.learn(docs.limit(0))
    assert {r.lang_pred for r in lang.predict(docs, nothing).collect()} == {"und"}
    assert lang.predict(docs.limit(0), filters).count() == 0
