import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op05_bpe as bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = st.sampled_from(list("aab e'srtlmvd  \n\t09é中!?. 　🙂"))


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.integers(1, 9))
def test_any_tree_equals_the_whole(text, leaf):
    own = bpe.encoder(PATH, leaf)
    ids = own.encode(text)
    assert ids == own.base.encode_ordinary(text)
    assert own.decode(ids).decode() == text


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeinrst", "0123456789", "!?-=", " ", " \n", "\n", "aé中", " a", "'s"])
def test_long_matches_are_joined_inside(alphabet):
    rng = random.Random(alphabet)
    for n in (700, 3000, 9000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        own = bpe.encoder(PATH, 300)
        assert own.encode(text) == own.base.encode_ordinary(text)
        assert own.encode("x " + text + " 'll'") == own.base.encode_ordinary("x " + text + " 'll'")


def test_merge_equals_the_library():
    own = bpe.encoder(PATH)
    for word in ("", "a", "hello", "antidisestablishmentarianism", "Überstraße", "zzzzzzzzzzzzz"):
        assert own.merge(word.encode()) == own.base.encode_ordinary(word)


def test_table_with_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "It's  we'll\n\n  go", "x"), (None, "a", "x"), (3, "It's  we'll\n\n  go", "x"), (4, "word " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    own = bpe.encoder(PATH)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, PATH).collect()}
    want = set()
    for doc_id, text, _ in rows:
        ids = own.base.encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode_table(bpe.encode_table(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
