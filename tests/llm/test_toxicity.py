import random

import numpy as np

from plumbline.llm import op02_toxicity as m
from plumbline.llm.common import held_out

SOUNDS = ["ka", "lo", "mi", "tra", "en", "sol", "ri", "pa", "du", "ne"]
BAD = ["vilebeast", "wretchedly", "slimegoblin", "rottenhide"]


def sentence(rng, bad, n=60):
    words = ["".join(rng.choice(SOUNDS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(bad):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 3 if i % 5 == 0 else 0), "en", "s") for i in range(900)]
    odd = [(5000, None, None, None), (5001, "", "en", "s"), (5002, " \n", "en", "s"), (None, sentence(rng, 3), "en", "s"), (5003, sentence(rng, 60, 40_000), "en", "s"), (0, rows[0][1], "en", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(700)] + [(3, None), (5000, 1), (9999, 1)], "doc_id long, toxic int")
    model = m.learn(docs, m.training_labels(labels))
    got = m.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    found = {r.doc_id: r for r in got}
    ids = [r.doc_id for r in docs.filter(held_out(docs.doc_id)).collect() if r.doc_id < 900]
    assert np.mean([found[i].predicted == int(i % 5 == 0) for i in ids]) > 0.97
    assert found[5000].score == found[5001].score == found[5002].score < 0.3
    again = {r.doc_id: r.score for r in m.score(docs.repartition(3), m.learn(docs.repartition(7), m.training_labels(labels))).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-6 for i in found)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert m.score(docs, m.learn(docs, none)).first().score == 0.0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert m.score(docs, m.learn(docs, one)).first().score == 1.0
    assert m.score(docs.limit(0), m.learn(docs, one)).count() == 0


def test_gain_follows_the_dictionaries():
    rng = random.Random(5)
    common = [sentence(rng, 0, 30) for _ in range(600)]
    model = m.ToxicityModel(m._trained(common, 65_536, 400), m._wide(" " + " ".join(BAD) + " "), 0.1)
    assert min(model.gain(w) for w in BAD) > max(model.gain(w) for w in sentence(rng, 0, 50).split())
    assert m.windows("A b  c", 2) == ["a b", "c"] and m.windows(None, 1) == []


def test_short_words_can_be_learned(spark):
    rng = random.Random(23)
    plain = ["on", "at", "it", "the", "sea", "sun", "house", "garden", "walk", "stone", "by", "we"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 120))]
        if i % 2:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["zog", "vux", "qi"]))
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = m.learn(docs, spark.createDataFrame(labels[:450], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in m.score(docs, model).collect()}
    held = range(450, 600)
    assert all(got[i] < 0.3 for i in held if i % 2 == 0) and all(got[i] > 0.3 for i in held if i % 2)
