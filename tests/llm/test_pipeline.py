import random
from collections import Counter

import public_tokenizers

import corpus_pipeline as pipeline
from plumbline.llm import op02_toxicity, op05_bpe
from tests.llm import test_lines, test_minhash, test_mix, test_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        text = "\n".join(test_toxicity.sentence(rng, 3 if i % 6 == 0 else 0, 25) for _ in range(rng.randrange(1, 5)))
        rows.append((i, text, "en", f"s{min(i % 7, 3)}", len(text)))
    for k in range(60):  # exact copies and near copies, shared lines
        text = rows[rng.randrange(1, 400)][1]
        words = text.split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((600 + k, " ".join(words) + ("\nA line that many of these documents share here." if k % 3 == 0 else ""), "en", "s9", len(text)))
    rows += [(700, None, "en", "s1", 0), (701, "", None, None, 0), (702, "\n", "en", "s1", 1), (703, "word " * 20_000, "en", "s1", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(450)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage_on_its_input(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = make(spark, folder)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"] and pipeline.ORACLE_SQL is None
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        held.append([tuple(r) for r in docs.collect()])
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = {i for i, t, *_ in rows if any(w in (t or "") for w in test_toxicity.BAD)}
    left = {r[0] for r in held[1]}
    assert len(left & bad) <= 0.03 * len(bad) and len(left - bad) >= 0.98 * (len(rows) - len(bad))

    want = {i: (text, n, exact + close) for i, text, n, exact, close in test_lines.brute([(r[0], r[1]) for r in held[1]], 5)}
    stays = {i for i, (text, _, lost) in want.items() if not lost or (text or "").split()}
    assert {r[0]: r[1] for r in held[2]} == {i: want[i][0] for i in stays}
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in held[2])

    groups = test_minhash.brute([(r[0], r[1]) for r in held[2]], 5)
    assert sorted(r[0] for r in held[3]) == sorted(i for i, _, _, kept in groups if kept)

    sizes = {r[0]: len((r[1] or "").split()) for r in held[3]}
    of, taken, given = {r[0]: r[3] for r in held[3]}, Counter(), Counter()
    for r in held[3]:
        given[r[3]] += sizes[r[0]]
    copies = Counter(r[0] for r in held[4])
    for i, n in copies.items():
        assert n <= 3
        taken[of[i]] += n * sizes[i]
    for source, target in test_mix.brute_targets(dict(given)).items():
        assert abs(taken[source] - target) <= 2 * max(n for i, n in sizes.items() if of[i] == source)

    own = op05_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r[0]: r[1] for r in held[4]}
    assert sorted(r[0] for r in held[5]) == sorted(r[0] for r in held[4])
    assert all(own.base.encode_ordinary(texts[i] or "") == list(ids) and n == len(ids) for i, n, ids in held[5])
    assert sorted(pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()) == sorted((i, n) for i, n, _ in held[5])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_toxicity_stage_rejects_what_the_operator_predicts(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], SCHEMA)
    for score in (0.25, 0.35, 0.45):
        model = op02_toxicity.ToxicityModel(b"", b"", score)  # without weights every text has this score
        monkeypatch.setattr(op02_toxicity, "learn", lambda *_, own=model: own)
        assert pipeline.toxicity(spark, docs, folder).count() == 1 - op02_toxicity.score(docs, model).first().predicted
