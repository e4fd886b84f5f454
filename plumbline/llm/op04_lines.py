"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions alone.

Two lines are near if one word put in, left out or exchanged turns one into the other (words are cut at ASCII white space).
Every line emits its variants, itself and itself without each word, as hashed keys. Equal lines meet on themselves; lines that
differ by an exchange meet on the variant without the same word; a line and one with a word more meet on the former. Among
the lines of one key and place all are near each other, so the earliest one stands for them and no pairs are formed.

Variants are emitted only by lines that can have a partner: one edit leaves the first or the last half of a line whole, so
two near lines share the hash of a half, for one of two half lengths. What meets is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, lookup_join, query, table

HEAVY = 1000


def _cut(docs: DataFrame) -> DataFrame:
    """id, at, line of every line, of rows with an id and a text."""
    return docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))


def _words(line: Column) -> Column:
    """Words of a line: a plain blank is the cheapest to cut at, so the other white space becomes one first."""
    return F.array_remove(F.split(F.regexp_replace(line, r"[\x09-\x0D]", " "), " "), "")


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and last m words for m = n / 2 and (n - 1) / 2."""
    lengths = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(lengths, lambda m: F.array(F.xxhash64(F.lit(1), m, F.slice(words, 1, m)), F.xxhash64(F.lit(2), m, F.slice(words, n - m + 1, m)))))


def near_lines(docs: DataFrame, min_words: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines with a word (id, at, raw, lid, lid2; raw is a hash of the whole line), distinct ones (lid, lid2, id, at, n_lines: first place and number) and near ones
    (lid, lid2, other_id, other_at); lid and lid2 are two hashes of a line's words.

    ``docs`` has id and text. A near line has an earlier line, by (id, line number) of first places, within one edit; both have ``min_words`` words or
    more. The earlier line counts whether or not it is near a still earlier one.
    """
    lines, n = _cut(docs), F.size("words")
    # whether a line has a word is asked of the text: a filter on its words would cut them twice
    hashed = lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "at", F.hash("line").alias("raw"), _words(F.col("line")).alias("words"))
    told = cut_lineage(hashed.select("id", "at", "raw", F.xxhash64("words").alias("lid"), F.xxhash64(F.lit(7), "words").alias("lid2"), F.when(n >= min_words, _halves(F.col("words"), n)).alias("halves")))
    distinct = cut_lineage(told.groupBy("lid", "lid2").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n_lines"), F.first("halves").alias("halves")))
    halves = distinct.select("lid", "lid2", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    able = cut_lineage(halves.join(shared, "half").select("lid", "lid2", "first.id", "first.at").distinct())

    # the words of those lines, under a short number of their own
    found = lookup_join(lines, able, ["id", "at"], "inner").withColumn("words", _words(F.col("line"))).filter((F.xxhash64("words") == F.col("lid")) & (F.xxhash64(F.lit(7), "words") == F.col("lid2")))
    known = cut_lineage(found.drop("line").distinct().withColumn("sid", F.monotonically_increasing_id()))

    # a word counts with its place, so the variant without word p is: words before p, and words after p one place to the left
    each = known.select("sid", F.size("words").alias("n"), F.posexplode(F.transform("words", lambda w: F.xxhash64(w))).alias("p", "w"))
    run = Window.partitionBy("sid").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sid")
    here, left = F.xxhash64("w", "p"), F.xxhash64("w", F.col("p") - 1)
    summed = each.select("sid", "n", "p", here.alias("here"), left.alias("left")).select(
        "sid", "n", "p", F.bit_xor("here").over(run).bitwiseXOR(F.col("here")).alias("before"), F.bit_xor("left").over(run).alias("upto"), F.bit_xor("left").over(whole).alias("all_left"), F.bit_xor("here").over(whole).alias("all")
    )
    without = F.struct(F.xxhash64(F.col("before").bitwiseXOR(F.col("upto")).bitwiseXOR(F.col("all_left")), F.col("n") - 1).alias("key"), F.col("p").alias("p"))
    itself = F.struct(F.xxhash64("all", "n").alias("key"), F.lit(-1).alias("p"))
    variants = cut_lineage(summed.select("sid", F.explode(F.when(F.col("p") == 0, F.array(without, itself)).otherwise(F.array(without))).alias("v")).select("sid", "v.key", "v.p"))

    meeting = cut_lineage(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    placed = lookup_join(variants, meeting, "key", "left_semi").join(known.select("sid", F.struct("id", "at", "sid").alias("line")), "sid")
    groups = placed.groupBy("key", "p").agg(F.min("line").alias("least"), F.count(F.lit(1)).alias("n"))
    by_key = Window.partitionBy("key")  # a row for each place at most
    shorter = F.min(F.when(F.col("p") < 0, F.struct(F.col("least"), F.lit(-1).alias("q")))).over(by_key)
    longer = F.min(F.when(F.col("p") >= 0, F.struct(F.col("least"), F.col("p").alias("q")))).over(by_key)
    best = groups.select("key", "p", "n", F.when(F.col("p") < 0, longer).otherwise(F.least(F.struct(F.col("least"), F.col("p").alias("q")), F.coalesce(shorter, F.struct(F.col("least"), F.col("p").alias("q"))))).alias("best"), "least")
    useful = best.filter("best IS NOT NULL AND (n > 1 OR best.least <> least)").select("key", "p", "best")
    pairs = placed.join(useful, ["key", "p"]).filter(F.col("best.least") < F.col("line")).select("sid", "p", F.col("best.least.sid").alias("other"), F.col("best.q").alias("q")).distinct()

    mine = known.select("sid", "lid", "lid2", F.col("words").alias("a"))
    theirs = known.select(F.col("sid").alias("other"), F.col("id").alias("other_id"), F.col("at").alias("other_at"), F.col("words").alias("b"))

    def less(words: str, p: str) -> Column:
        return F.when(F.col(p) < 0, F.col(words)).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(F.col(p), F.lit(0))), F.slice(words, F.greatest(F.col(p), F.lit(0)) + 2, F.size(words))))

    verified = pairs.join(mine, "sid").join(theirs, "other").filter(less("a", "p") == less("b", "q"))
    near = verified.groupBy("lid", "lid2").agg(F.min(F.struct("other_id", "other_at")).alias("o")).select("lid", "lid2", "o.other_id", "o.other_at")
    return told.select("id", "at", "raw", "lid", "lid2"), distinct.select("lid", "lid2", "first.id", "first.at", "n_lines"), cut_lineage(near)


def removed_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """id, at, raw, near of every line that goes: equal to an earlier line (near false) or near one (true, for all its places)."""
    lines, distinct, near = near_lines(docs, min_words)
    marked = distinct.join(near.withColumn("near", F.lit(True)), ["lid", "lid2"], "left").filter("n_lines > 1 OR near")
    first = cut_lineage(marked.select("lid", "lid2", "n_lines", F.struct("id", "at").alias("first"), F.coalesce("near", F.lit(False)).alias("near")))
    # lines with more than a HEAVY-th of all rows each, so fewer than HEAVY of them, are sent to the rows; the others meet in a shuffle
    total = first.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
    heavy = F.col("n_lines") * HEAVY > total
    some, most = first.filter(heavy).drop("n_lines"), first.filter(~heavy).drop("n_lines")
    keys = ["lid", "lid2"]
    met = lines.join(F.broadcast(some), keys).unionByName(lines.join(F.broadcast(some.select(*keys)), keys, "left_anti").join(most, keys))
    return met.filter(F.col("near") | (F.struct("id", "at") > F.col("first"))).select("id", "at", "raw", "near").distinct()


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str, str] = ("n_lines", "n_exact", "n_near")) -> DataFrame:
    """``docs`` with its text less the lines that go, and three ``counts``: lines, lines equal to an earlier one, near lines. Other columns, whatever
    their names, stay; a count whose name is taken is left out.

    A line without a word always stays. A NULL text stays NULL; rows without an id neither lose lines nor make others lose them. Rows of equal id are one
    document: equal lines at the same place of them do not count as earlier than each other.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a line's code holds its number and a hash; sets of codes are hashed, so a text of many lines is no burden
    lost = removed_lines(named, min_words).select("id", "near", _code(F.col("at"), F.col("raw")).alias("code"))
    codes = lambda test: F.coalesce(F.collect_list(F.when(test, F.col("code"))), F.array())
    gone = lost.groupBy("id").agg(codes(~F.col("near")).alias("exact"), codes(F.col("near")).alias("close"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    joined = lookup_join(packed, cut_lineage(gone), "id")
    text = F.col("row").getField(text_col)
    parts = joined.withColumn("parts", F.split(text, "\n", -1))
    own = F.transform("parts", lambda line, at: _code(at, F.hash(line)))
    coded = parts.withColumn("own", F.when(F.col("exact").isNotNull(), own))
    left = coded.withColumn("kept", F.array_except("own", F.concat("exact", "close")))
    kept = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda c: F.get("parts", F.shiftright(c, 32).cast("int"))), "\n"))
    columns = [(kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    n = dict(zip(counts, (F.size("parts"), F.size(F.array_intersect("own", "exact")), F.size(F.array_intersect("own", "close"))), strict=True))
    return left.select(*columns, *[F.coalesce(F.greatest(v, F.lit(0)), F.lit(0)).cast("long").alias(k) for k, v in n.items() if k not in docs.columns])


def _code(at: Column, raw: Column) -> Column:
    return F.shiftleft(at.cast("long"), 32).bitwiseOR(raw.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


SQL = """
WITH l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS r(i)),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM l),
k AS (SELECT *, array_to_string(ws, ' ') AS words, len(ws) AS n, doc_id * 1000000 + pos AS ord FROM w),
d AS (SELECT words, any_value(ws) AS ws, any_value(n) AS n, min(ord) AS ord FROM k WHERE n > 0 GROUP BY words),
v AS (SELECT words, ord, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') AS variant FROM d, unnest(range(1, n + 1)) AS r(p) WHERE n >= 5),
exchanged AS (SELECT words FROM (SELECT words, ord, min(ord) OVER (PARTITION BY variant, p) AS least FROM v) WHERE least < ord),
other AS (SELECT v.words AS longer, v.ord AS longer_ord, d.words AS shorter, d.ord AS shorter_ord FROM v JOIN d ON v.variant = d.words AND d.n >= 5),
near AS (SELECT words FROM exchanged UNION SELECT longer FROM other WHERE shorter_ord < longer_ord UNION SELECT shorter FROM other WHERE longer_ord < shorter_ord),
f AS (SELECT k.doc_id, k.pos, k.line, CASE WHEN k.n = 0 THEN 0 WHEN k.words IN (SELECT words FROM near) THEN 2 WHEN k.ord > d.ord THEN 1 ELSE 0 END AS fate FROM k LEFT JOIN d ON d.words = k.words)
SELECT documents.doc_id, count(f.pos) AS n_lines, count(*) FILTER (fate = 1) AS n_exact, count(*) FILTER (fate = 2) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (fate = 0), '')) AS kept_sha256
FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


@query("op4_lines", SQL)
def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
