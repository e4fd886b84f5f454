"""Spelling variants of words by pivotal grams.

The bigrams of all words are ordered from rare to frequent. A word's prefix are its three rarest bigrams (all of equal rank with the
third); two disjoint ones of them with the least total frequency, found by dynamic programming, are its pivots. One edit touches one
of two disjoint bigrams at most. So of two words at one edit, that with the lower last prefix rank has a pivot which stands whole in the
other's prefix, at the same place or one to the side as the lengths tell, and all code points on one side of it are equal. Pivots are looked up in
the index of prefixes by bigram, place, length and that side; what meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, query, table

#: A task's counts go out when so many words are held.
HELD = 200_000


def words_of(text: str | None, doc_id: int | None, least: int = 6, rare: int = 199) -> Counter:
    """Runs of letters with A-Z lower-cased, by number of uses. One code point is left out of a run if ``rare`` divides
    crc32("<doc_id>:<run>"): that at this crc modulo the run's length. Results of fewer than ``least`` code points are dropped."""
    low = (text or "").encode().lower().decode()
    found: Counter = Counter()
    who = "" if doc_id is None else str(doc_id)
    for run, n in Counter(re.findall(rf"[a-zÀ-ÿ]{{{least},}}", low)).items():  # a shorter run cannot become long enough
        h = zlib.crc32(f"{who}:{run}".encode())
        if h % rare == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= least:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, least: int = 6, uses: int = 5, rare: int = 199) -> DataFrame:
    """word, n of words with ``uses`` or more in columns id, text of ``docs``; counts are summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(words_of(text.as_py(), doc_id, least, rare))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= uses)


def pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Two of the ascending ``places`` that lie two or more apart, with the least sum of ``costs``: one pass that carries the best single place so far."""
    best, single = None, None  # the cheapest pair; the cheapest place two or more to the left
    waiting: list[int] = []
    for i, p in enumerate(places):
        while waiting and places[waiting[0]] <= p - 2:
            k = waiting.pop(0)
            if single is None or costs[k] < costs[single]:
                single = k
        if single is not None and (best is None or costs[single] + costs[i] < best[0]):
            best = (costs[single] + costs[i], places[single], p)
        waiting.append(i)
    return best[1], best[2]


def _key(gram: str, place: int, length: int, side: str, rest: str) -> int:
    h = xxhash.xxh64_intdigest(f"{gram}{place},{length}{side}{rest}".encode())
    return h - (1 << 64) if h >> 63 else h


def keys_of(word: str, frequency: dict[str, int]) -> tuple[tuple[int, str], list[int], list[int]]:
    """Order of the last prefix gram, keys under which the word is found, keys that its pivots look up."""
    order = sorted((frequency[word[p : p + 2]], word[p : p + 2], p) for p in range(len(word) - 1))
    last = order[2][:2]
    prefix = sorted((p, f) for f, g, p in order if (f, g) <= last)
    size, index, probes = len(word), set(), set()
    for p, _ in prefix:
        index |= {_key(word[p : p + 2], p, size, "<", word[:p]), _key(word[p : p + 2], p, size, ">", word[p + 2 :])}
    for p in pivots([p for p, _ in prefix], [f for _, f in prefix]):
        gram, left, right = word[p : p + 2], word[:p], word[p + 2 :]
        for longer in (-1, 0, 1):  # an edit to the right of the pivot leaves what is on its left, and the other way round
            probes |= {_key(gram, p, size + longer, "<", left), _key(gram, p + longer, size + longer, ">", right)}
    return last, sorted(index), sorted(probes)


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n of all pairs, both ways, of distinct words (word, n) of four code points or more at exactly one edit."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda p: F.substring("word", p, F.lit(2)))).alias("gram"))
    # no more rows than pairs of letters of the alphabet: a-z and À to ÿ are 90, so 8,100 at most
    frequency = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}

    def block(rows: dict[str, list]) -> dict[str, list]:
        found = [keys_of(w, frequency) for w in rows["word"]]
        return {
            "word": rows["word"],
            "n": rows["n"],
            "last": [f"{f:020d}{g}" for (f, g), _, _ in found],
            "index": [x for _, x, _ in found],
            "probes": [x for _, _, x in found],
        }

    keyed = cut_lineage(batch_map(words, block, "word string, n long, last string, index array<long>, probes array<long>"))
    index = keyed.select(F.explode("index").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    probes = keyed.select(F.explode("probes").alias("key"), "word", "n", "last")
    met = probes.join(index, "key").filter("last <= other_last AND word <> other").filter(F.levenshtein("word", "other", 1) == 1)
    pairs = met.select("word", "n", "other", "other_n")
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain word -> form, by pointer doubling; n grows along a chain, so there is no circle."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut_lineage(at.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least: int = 6, uses: int = 5, ratio: int = 5, rare: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with ``uses`` or more in ``docs``.

    Words are runs of Latin letters of ``least`` (4 or more) code points, with the rare deletions of ``words_of``. Near words differ by one edit. The form is
    the near word with most uses (ties: first in code-point order), if it has ``ratio`` times the word's or more; the root is the last form of the chain, or the
    word itself. NULL and empty texts have no words; a NULL id counts as one without digits; repeated rows count as often as they occur.
    """
    if least < 4 or ratio < 2:
        raise ValueError("two disjoint pivots among three bigrams need words of 4 letters; chains need a ratio of 2")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = cut_lineage(vocabulary(named, least, uses, rare))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("most"))
    told = words.join(near, "word", "left").withColumn("fits", -F.col("most.n") >= ratio * F.col("n"))
    formed = cut_lineage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("most.form")).alias("form"), F.when(F.col("fits"), -F.col("most.n")).alias("form_n")))
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS r
  FROM documents) x WHERE length(r) >= 6 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || r)) AS x FROM runs),
summed AS (SELECT r, n, xor(list_reduce(list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h FROM hexed, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM summed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS d FROM w, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS u(i)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.d = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.d = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -other_n, form := other)) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.n >= 5 * w.n THEN m.form END AS form, CASE WHEN -m.n >= 5 * w.n THEN -m.n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS node, 0 AS steps FROM f UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.node WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(node, steps) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""


@query("op11_variants", SQL)
def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))
