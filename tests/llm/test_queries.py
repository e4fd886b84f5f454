"""The queries of this package against their SQL, and the contract's columns of those without."""

import pytest

import __spark_entry__ as entry
from plumbline.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, LLM_QUERIES[name], LLM_ORACLES[name]) == []


COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_merkle": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op12_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    got = LLM_QUERIES[name](spark, FOLDER)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    ids = [r[0] for r in got.collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *LLM_QUERIES} <= names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14))
