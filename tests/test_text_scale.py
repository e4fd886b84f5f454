"""Places and cells of large tables: what is looked up, spelt out and counted stays small, and the results whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import geo
from plumbline.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_count_longer_runs_only_where_they_can_reach_the_top(spark, monkeypatch):
    rng = random.Random(5)
    words = ["ALPHA", "BETA", "GAMMA", "DELTA1", "STOP", "low", "Mixed", "AB", "123", "4TH"]
    texts = [" ".join(rng.choices(words, weights=[9, 7, 5, 3, 2, 1, 1, 1, 1, 1], k=rng.randrange(0, 30))) for _ in range(60)] + ["", "ALPHA", None, "ÉALPHA-BETA,,GAMMA"]
    wanted = Counter()
    for text in texts:
        run = []
        for w in [*"".join(c if c.isascii() and c.isalnum() else " " for c in text or "").split(), "STOP"]:
            if w == "STOP":
                wanted.update(" ".join(run[i : i + k]) for k in range(2, 6) for i in range(len(run) - k + 1))
                run = []
            elif len(w) >= 3 and w == w.upper() and not w.isdigit():
                run.append(w)
    sizes, cut = [], geo.cut_lineage
    monkeypatch.setattr(geo, "sized", lambda df: [out := cut(df), sizes.append(out.count())][0])
    df = spark.createDataFrame([(t,) for t in texts], "project_name string")
    for top in (1, 7, 10_000):
        got = [(r.ngram, r.n) for r in geo.ngram_inventory(df, top=top, stop=("STOP",)).collect()]
        assert got == sorted(wanted.items(), key=lambda x: (-x[1], x[0]))[:top]
    assert sizes[0] == 1 < sizes[2]


@pytest.mark.parametrize("stop", [(), ("BETA",)])
def test_ngrams_with_and_without_stop_words(spark, stop):
    df = spark.createDataFrame([("ALPHA BETA GAMMA DELTA",), ("ALPHA BETA",)], "project_name string")
    got = {r.ngram: r.n for r in geo.ngram_inventory(df, stop=stop).collect()}
    assert got == ({"GAMMA DELTA": 1} if stop else {"ALPHA BETA": 2, "BETA GAMMA": 1, "GAMMA DELTA": 1, "ALPHA BETA GAMMA": 1, "BETA GAMMA DELTA": 1, "ALPHA BETA GAMMA DELTA": 1})


def test_gazetteer_spells_out_runs_only_where_a_place_begins(spark):
    places = spark.createDataFrame([("NEW-TOWN", 1.0, 2.0), ("Old Port Bay", 3.0, 4.0), ("TOWN", 5.0, 6.0), ("--", 7.0, 8.0), (None, 9.0, 9.0)], "place string, lat double, lon double")
    rows = [(1, "THE NEW TOWN"), (2, "AT OLD PO-RT BAY, TOWN"), (3, "NEWT-OWN TOWN"), (4, "nothing"), (5, None), (5, "TOWN"), (None, "TOWN")]
    out = geo.gazetteer_geocode(spark.createDataFrame(rows, "id long, project_name string"), places, "id")
    got = Counter((r.id, r.project_name, r.matched, r.geo_latitude) for r in out.collect())
    assert got == Counter(
        [(1, "THE NEW TOWN", "NEW-TOWN", 1.0), (2, "AT OLD PO-RT BAY, TOWN", "Old Port Bay", 3.0), (3, "NEWT-OWN TOWN", "NEW-TOWN", 1.0), (4, "nothing", None, None),
         (5, None, "TOWN", 5.0), (5, "TOWN", "TOWN", 5.0), (None, "TOWN", None, None)]
    )
    assert "LeftSemi" in plan_of(out)


def test_only_names_without_a_known_tail_are_searched(spark, monkeypatch):
    searched, search = [], geo._named_in
    monkeypatch.setattr(geo, "_named_in", lambda texts, *rest: [searched.append(texts.count()), search(texts, *rest)][1])
    tails = [(i, f"Work {i} [7]ORG,NORTH LA") for i in range(50)]
    rows = [*tails, (90, "Bridge in South Land, near"), (91, "Bridge in South Land, near"), (92, None), (93, "[1]ORG,XX NORTH LAND"), (94, "none")]
    names = spark.createDataFrame([("North Land",), ("South Land",), (None,)], "name string")
    got = {r.id: r.state for r in geo.extract_state(spark.createDataFrame(rows, "id long, project_name string"), names=names, codes={}).collect()}
    assert all(got[i] == "North Land" for i, _ in tails)
    assert [got[i] for i in range(90, 95)] == ["SOUTH LAND", "SOUTH LAND", None, "NORTH LAND", None] and len(got) == 55
    assert len(searched) == 2 and max(searched) == 3


@pytest.mark.parametrize("name", ["section_slice", "label_by_section", "snapshot_rows_from_cells"])
def test_cells_are_spelt_out_once(spark, name, tmp_path):
    """The cells are written; what reads them for headers, section marks and rows does not format them again."""
    text = "\n".join(["HEADER ONE", "that is a line of some length to be a project row", "whom it may concern, a line of some length too", "short"] * 4)
    spark.createDataFrame([(1, text), (2, text.lower()), (3, None), (2, text)], "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() > 0
    assert "format_number" not in plan_of(out)
