import random

import public_tokenizers
import pytest

from plumbline.llm import op06_fertility as m

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    space = " \t\n\v\f\r"
    words, now = [], ""
    for c in text + " ":
        if c in space:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines = text.split("\n")
    again = sum(any(c not in space for c in x) and x in lines[:i] for i, x in enumerate(lines))
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


@pytest.mark.parametrize("seed", range(8))
def test_base_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "c ", " ", "\n", "é", "# ", "a b c ", " ", "\x1c", "x\n", "\r"]) for _ in range(rng.randrange(0, 160)))
    assert m.base_counts(text) == brute(text)


def test_bands_reject_junk_and_keep_the_rest(spark):
    rng = random.Random(9)
    words = ["the", "of", "people", "water", "house", "and", "in", "small", "river", "work", "time", "garden", "year", "with", "light", "paper"]
    good = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "ing", "s", "er"]) for _ in range(rng.randrange(60, 300)))
    rows = [(i, good(), "en", None) for i in range(300)] + [(300 + i, good(), None, None) for i in range(60)]
    rows += [(900, " ".join("".join(chr(rng.randrange(0x2800, 0x2900)) for _ in range(6)) for _ in range(90)), "en", None)]
    rows += [(901, " ".join("".join(chr(rng.randrange(0x2800, 0x2900)) for _ in range(6)) for _ in range(90)), "xx", None)]
    rows += [(902, None, "en", None), (903, "", None, None), (904, "few words", "en", None), (905, "again and " * 60, "en", None), (None, good(), "en", None), (0, rows[0][1], "en", None), (906, good() * 300, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = m.quality(docs, PATH).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    for r, (i, text, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_words)), sorted(rows, key=lambda r: (r[0] is None, r[0], len((r[1] or "").split()))), strict=True):
        if r.n_words < 400:
            assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, *brute(text))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(found[i].kept for i in range(360) if not found[i].base_failed) and not found[900].kept and found[901].kept
    assert not any(found[i].kept for i in (902, 903, 904, 905))
    assert m.quality(docs.limit(0), PATH).count() == 0


def test_measures():
    n, per, share, entropy = m.fertility(["plain words in a row", "⠁⠂⠃", ""], PATH)[0]
    assert n > 0 and per > 2 and share == 0 and 0 < entropy <= 1
    assert m.fertility(["⠁⠂⠃"], PATH)[0][2] > 0.5 and m.fertility([""], PATH)[0] == (0, 0.0, 0.0, 0.0)
    assert m.script("Привет") == "Cyrillic" and m.script("12") == "none" and m.script(None) == "none"


def test_each_measure_rejects_what_only_it_can_tell(spark):
    rng = random.Random(6)
    own, _ = m._pieces(PATH)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    plain = [p[1:] for p in names if p[0] == "▁" and p[1:].isascii() and p[1:].isalpha() and p[1:].islower()]
    words = [w for w in plain if 4 <= len(w) <= 7][:3000]
    short, fours, fives = [w for w in plain if len(w) in (3, 4)], [w for w in words if len(w) == 4], [w for w in words if len(w) == 5]
    weights = [(k + 3) ** -1.1 for k in range(len(words))]
    drawn = lambda n: rng.choices(words, weights, k=n)
    bytes_in = [w for w in drawn(600) if len(w) > 4][:270]  # longer words make up for the short tokens
    bytes_in[::35] = ["⠁"] * len(bytes_in[::35])
    planted = {
        "chars_per_token": [" ".join(rng.choices(short, weights[: len(short)], k=400))],
        "byte_share": [" ".join(bytes_in)],
        "entropy": [" ".join(rng.choices(fours[:10] + fives[:15], k=200)), " ".join(rng.sample(fours[:160] + fives[:240], 400))],
    }
    rows = [(i, " ".join(drawn(rng.choice([60, 150, 400, 1500]))), "en") for i in range(400)]
    cases = {1000 + i: (name, text) for i, (name, text) in enumerate((n, t) for n, texts in planted.items() for t in texts)}
    docs = spark.createDataFrame(rows + [(i, text, "en") for i, (_, text) in cases.items()], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in m.quality(docs, PATH).collect()}
    assert sum(not found[i].kept for i in range(400)) <= 8
    for i, (name, _) in cases.items():
        assert not found[i].base_failed and not found[i].kept, name
        assert [k for k in m.MEASURES if not found[i][f"{k}_ok"]] == [name]
