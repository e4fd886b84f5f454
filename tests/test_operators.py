"""Hand-computed fixtures and properties."""

import math
import os
import random
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import assembly, evaluate, features, geo, linear, models, quality, survival
from plumbline.plans import ordered
from plumbline.sources import sinks, tables
from plumbline.streaming import reports


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("1,234.50", 1234.5), ("762.75\n-", 762.75), ("12,320.00 - ", 12320.0), ("-5", None), ("N.A.", None), ("", None), (None, None), ("nan", None), ("1.0d", None)],
)
def test_clean_number_cell(spark, value, want):
    assert one(spark, value, text.clean_number_cell) == want


def test_number_variants(spark):
    assert one(spark, "-5", text.clean_number_na) == -5.0
    assert one(spark, "--", text.clean_number_na) is None
    assert one(spark, "12-3 x", text.clean_number_default) == 12.0
    assert one(spark, "x", text.clean_number_default) == 0.0
    assert tuple(one(spark, "2,146.86\n2,413.00", text.split_original_revised)) == (2146.86, 2413.0)
    assert tuple(one(spark, "762.75\n ", text.split_original_revised)) == (762.75, None)


def test_dates(spark):
    assert tuple(one(spark, "03/2019", text.parse_month_year)) == (2019, 3, 2019 * 12 + 3)
    assert tuple(one(spark, "x (Mar 2020) y", text.parse_month_year)) == (2020, 3, 2020 * 12 + 3)
    assert one(spark, "March", text.parse_month_year) is None
    assert one(spark, "n/a 04/2018\n05/2019", text.parse_year_token) == 2018
    d = one(spark, "03/2019 (04/2020) {05/2021}", text.bracket_date_fields)
    assert (d["original"]["year"], d["revised"]["year"], d["anticipated"]["year"]) == (2019, 2020, 2021)
    c = one(spark, "1,200.5 (1,300) {N.A.}", text.bracket_cost_fields)
    assert tuple(c) == (1200.5, 1300.0, None)
    assert tuple(one(spark, "range -3 - 120", text.parse_int_range)) == (-3, 120)


def test_labels(spark):
    assert one(spark, "ROAD TRANSPORT", text.snap_label) == "ROAD TRANSPORT AND HIGHWAYS"
    assert one(spark, "coal", text.snap_label) == "COAL"
    assert one(spark, "SOMETHING ELSE", text.snap_label) == "SOMETHING ELSE"
    assert one(spark, "Tripur", text.alias_label) == "TRIPURA"
    assert one(spark, "DAM - [02]BHAVNI,TAMIL NADU", text.extract_agency) == "BHAVNI"
    assert one(spark, "no tail", text.extract_agency) is None
    assert one(spark, "Big dam (phase 2) [3]", text.extract_base_name) == "BIG DAM"
    assert one(spark, "ab [x]", text.extract_base_name) is None


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("A - [1]AAI,TAMIL NADU", "TAMIL NADU"),
        ("A - [1]AAI,MAHARASHTR A", "MAHARASHTRA"),
        ("A - [1]AAI,UTTAR PRAD", "UTTAR PRADESH"),
        ("Road in Bihar, phase 2", "BIHAR"),
        ("A ]NPCIL,KA end", "KARNATAKA"),
        ("nothing here", None),
        (None, None),
    ],
)
def test_extract_state(spark, name, want):
    df = spark.createDataFrame([(name,)], "project_name string")
    assert geo.extract_state(df).first()["state"] == want


def test_org_area_matches_whole_words(spark):
    assert one(spark, "MINE [1]SECL,CG", geo.org_area) == "BILASPUR"
    assert one(spark, "MINE [1]ECL,WB", geo.org_area) == "ASANSOL"
    assert one(spark, "RECLAIM", geo.org_area) is None


def test_fill_down_crosses_chunks(spark):
    blank = [""] * 8
    rows = [(1, 0, 0, ["", "COAL", *blank]), (1, 0, 1, ["1", "a", *blank]), (1, 200, 0, ["2", "b", *blank]), (2, 0, 0, ["1", "c", *blank])]
    df = spark.createDataFrame(rows, "doc_id long, page int, row int, cells array<string>")
    got = {r["cells"][1]: r["sector"] for r in assembly.fill_down_header(df).collect()}
    assert got == {"COAL": "COAL", "a": "COAL", "b": "COAL", "c": "Unknown"}


def test_upsert_keeps_untouched_duplicates_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2), ("b", "x", 3), ("c", "y", 4)], "k string, l string, v int")
    new = spark.createDataFrame([("a", "", 9), ("c", "y", 8), ("d", "z", 7)], "k string, l string, v int")
    once = assembly.upsert(old, new, ["k", "l"])
    assert sorted(r["v"] for r in once.collect()) == [2, 3, 7, 8, 9]
    again = assembly.upsert(once, new, ["k", "l"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_attach_policies(spark):
    left = spark.createDataFrame([("a",), ("z",)], "k string")
    right = spark.createDataFrame([("a", 1, 2001), ("a", 2, 2002)], "k string, o int, y int")
    get = lambda policy: sorted((r["k"], r["y"]) for r in assembly.attach_by_key(left, right, ["k"], ["y"], policy, ["o"]).collect() if r["k"] == "a")
    assert get("last") == [("a", 2002)]
    assert get("first") == [("a", 2001)]
    assert get("fan_out") == [("a", 2001), ("a", 2002)]
    filled = spark.createDataFrame([("a", 1990), ("z", None)], "k string, y int")
    out = assembly.attach_by_key(filled, right, ["k"], ["y"], "last", ["o"])
    assert {r["k"]: r["y"] for r in out.collect()} == {"a": 1990, "z": None}
    with pytest.raises(ValueError):
        assembly.attach_by_key(left, right, ["k"], ["y"], "any")


def test_percentiles_and_rank_cut_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.choice([1, 2, 2, 2, 5]) if i % 3 else rng.random() * 10)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double")
    values = sorted(v for _, v in rows)
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        h = p * (len(values) - 1)
        want = values[math.floor(h)] + (h - math.floor(h)) * (values[math.ceil(h)] - values[math.floor(h)])
        got = ordered.exact_percentiles(df, ["v"], (p,)).first()["value"]
        assert got == pytest.approx(want)
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:400]]
    got = [r["id"] for r in ordered.rank_cut(df, "v", "id", lambda n: F.lit(400)).collect()]
    assert sorted(got) == sorted(want)


def test_auc_properties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    wins = sum((p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b) / 9
    assert evaluate.auc(df, "s", "y").first()["auc"] == pytest.approx(wins)
    assert evaluate.auc(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"] == pytest.approx(1 - wins)
    assert evaluate.auc(df.filter("y = 1"), "s", "y").first()["auc"] is None


def test_oof_rate_ignores_own_fold(spark):
    rows = [(i, "ab"[i % 2], i % 3, (i * 7) % 5 % 2) for i in range(30)] + [(99, "only", 0, 1), (98, None, 1, 1)]
    df = spark.createDataFrame(rows, "id int, g string, fold int, y int")
    first = {r["id"]: r["g_rate"] for r in features.oof_target_rate(df, "g", "y").collect()}
    flipped = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    second = {r["id"]: (r["fold"], r["g_rate"]) for r in features.oof_target_rate(flipped, "g", "y").collect()}
    assert all(first[i] == pytest.approx(rate) for i, (fold, rate) in second.items() if fold == 0)
    others = [y for _, _, f, y in rows if f != 0]
    assert first[99] == pytest.approx(sum(others) / len(others))
    mine = [y for i, g, f, y in rows if g == "a" and f != 1]
    rest = [y for _, _, f, y in rows if f != 1]
    want = (sum(mine) + 20 * sum(rest) / len(rest)) / (len(mine) + 20)
    assert first[next(i for i, g, f, _ in rows if g == "a" and f == 1)] == pytest.approx(want)


def test_group_folds_do_not_leak(spark):
    df = spark.createDataFrame([(i, f"s{i % 11}") for i in range(300)], "id int, state string")
    for kind in ("group", "group_balanced"):
        report = evaluate.fold_leak_report(evaluate.fold_assign(df, kind, 4, group="state"), "state")
        assert {r["shared_groups"] for r in report.collect()} == {0}


def test_rolling_rate_without_recent_rows_uses_all(spark):
    df = spark.createDataFrame([("a", 1, 1990), ("b", 0, 1991)], "g string, y int, approval_year int")
    rows = {r["g"]: r for r in features.train_rate(df, "g", "y", 2010, "rolling").collect()}
    assert rows["a"]["overall"] == 0.5
    assert rows["a"]["rate"] == pytest.approx((1 + 20 * 0.5) / 21)


def test_pace_uses_completion_year_only_when_durations_are_all_missing(spark):
    schema = "approval_year int, planned_duration_years double, planned_doc_year int, original_cost_cr double, expenditure_cum_cr double"
    empty = spark.createDataFrame([(2020, None, 2024, 100.0, 50.0)], schema)
    mixed = empty.unionByName(spark.createDataFrame([(2020, 2.0, 2024, 100.0, 50.0)], schema))
    assert features.pace_features(empty, 2022.0).first()["elapsed_share"] == 0.5
    assert sorted(str(r["elapsed_share"]) for r in features.pace_features(mixed, 2022.0).collect()) == ["1.0", "None"]


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"token{c}{c}x" for c in "abcdefghijklmnop"]
    make = lambda n: " ".join(rng.choices(words, [30] * 4 + [1] * 12, k=n))
    left = [(i, make(8)) for i in range(60)]
    right = [(i, make(8)) for i in range(80)]
    schema = "id long, project_name string"
    prints = lambda s: {w[:6] for w in s.split()}
    want = {}
    for i, a in left:
        scored = [(-len(prints(a) & prints(b)), j) for j, b in right]
        best = min(scored)
        if -best[0] >= 3:
            want[i] = (best[1], -best[0])
    # prefixes of six characters keep the letter, so names stay distinguishable
    assert len({w[:6] for w in words}) == len(words)
    got = geo.fuzzy_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "id", "id")
    assert {r["id"]: (r["matched_id"], r["shared"]) for r in got.collect()} == want


def test_c_index_equals_pairwise_definition(spark):
    rng = random.Random(11)
    rows = [(float(rng.randint(1, 12)), rng.randint(0, 1), rng.randint(0, 6) / 10) for _ in range(120)]
    concord = usable = 0.0
    for i, (ta, da, ra) in enumerate(rows):
        for tb, db, rb in rows[i + 1 :]:
            if ta == tb:
                if da and db and ra != rb:
                    concord, usable = concord + 0.5, usable + 1
                continue
            early, late = ((da, ra), (db, rb)) if ta < tb else ((db, rb), (da, ra))
            if early[0]:
                usable += 1
                concord += 1.0 if early[1] > late[1] else 0.5 if early[1] == late[1] else 0.0
    got = survival.c_index(spark.createDataFrame(rows, "months double, event int, risk double")).first()
    assert got["usable_pairs"] == usable
    assert got["c_index"] == pytest.approx(concord / usable)


def test_life_table_agrees_with_person_period(spark):
    df = spark.createDataFrame([(5.0, 1), (13.0, 0), (30.0, 1), (30.0, 0)], "months double, event int")
    long = survival.person_period(df).groupBy("period").agg(F.count("*").alias("n"), F.sum("y").alias("d"))
    want = {r["period"]: (r["n"], r["d"]) for r in long.collect()}
    assert {r["period"]: (r["at_risk"], r["events"]) for r in survival.life_table(df).collect()} == want


def test_hazard_recovers_planted_signal(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        x = rng.random()
        t = next((p for p in range(1, 10) if rng.random() < 0.05 + 0.5 * x), None)
        rows.append((float(12 * (t or 9)), int(t is not None), x))
    df = spark.createDataFrame(rows, "months double, event int, x double")
    scored = survival.bucket_hazards(df, survival.fit_hazard(df, ["x"])).withColumn("risk", survival.survival_risk(F.col("hazards"), F.lit(60.0)))
    assert survival.c_index(scored).first()["c_index"] > 0.65


def test_classifier_finds_planted_signal(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.gauss(0, 1), rng.gauss(0, 1), int(x + rng.gauss(0, 0.5) > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    model = models.fit_logistic(df, ["x", "z"], "y")
    assert evaluate.auc(models.predict_probability(model, df), "p", "y").first()["auc"] > 0.9
    ranking = [r["feature"] for r in models.driver_analysis(model, df).collect()]
    assert ranking == ["x", "z"]
    shuffled = models.shuffle_column(df, "x", "id")
    assert sorted(r["x"] for r in shuffled.collect()) == sorted(r["x"] for r in df.collect())


def test_schema_violations_are_loud(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    with pytest.raises(quality.SchemaViolation, match="null k: 1"):
        quality.validate_schema(df, ["k", "v"], ["k"])
    with pytest.raises(quality.SchemaViolation, match="duplicate_key k: 1"):
        quality.validate_schema(df, ["k", "v"], [], ["k"])
    assert quality.validate_schema(df, ["k", "v"], ["v"]) is df


def test_versions_and_replayed_batches(spark, tmp_path):
    table = str(tmp_path / uuid.uuid4().hex)
    merge = reports.upsert_batch(table, ["k"], ["o"], "stream")
    schema = "k string, o int, v int"
    merge(spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], schema), 0)
    merge(spark.createDataFrame([("a", 3, 3), ("b", 1, 4)], schema), 1)
    merge(spark.createDataFrame([("a", 9, 9)], schema), 1)
    assert sorted((r["k"], r["v"]) for r in sinks.read_table(spark, table).collect()) == [("a", 3), ("b", 4)]
    assert sinks.latest_version(spark, table)[0] == 2
    # a plain write keeps the streams' ids, so a replay after it changes nothing
    sinks.write_table(sinks.read_table(spark, table).filter("k = 'a'"), table)
    merge(spark.createDataFrame([("a", 9, 9)], schema), 1)
    # a new checkpoint counts from 0 again, and its rows arrive
    again = reports.upsert_batch(table, ["k"], ["o"], "restarted")
    again(spark.createDataFrame([("c", 1, 7)], schema), 0)
    again(spark.createDataFrame([("c", 1, 8)], schema), 0)
    assert sorted((r["k"], r["v"]) for r in sinks.read_table(spark, table).collect()) == [("a", 3), ("c", 7)]
    assert sinks.latest_version(spark, table)[2] == {"stream": 1, "restarted": 0}


def test_two_writers(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    one = spark.range(3)
    base = sinks.write_table(one, table)
    assert sinks.write_table(spark.range(5), table, base=base) == base + 1
    with pytest.raises(sinks.ConcurrentWrite):
        sinks.write_table(spark.range(7), table, base=base)
    assert sinks.read_table(spark, table).count() == 5
    # a writer that was lost before its pointer got its name blocks nobody
    (tmp_path / "t" / "_pointer" / "_lost").write_text('{"number": 3')
    assert sinks.read_table(spark, table).count() == 5
    assert sinks.write_table(spark.range(9), table) == base + 2 and sinks.read_table(spark, table).count() == 9


def test_a_pointer_finished_late_does_not_take_the_number_of_another_writer(spark, tmp_path, monkeypatch):
    table, claim, order = str(tmp_path / "t"), sinks._claim, []
    base = sinks.write_table(spark.range(3), table)

    def late(session, aside, pointer):
        if not order:  # writer A has its pointer ready and has not named it; writer B starts and commits
            order.append("A")
            order.append(sinks.write_table(spark.range(5), table, ("b", 0), base=base))
        return claim(session, aside, pointer)

    monkeypatch.setattr(sinks, "_claim", late)
    with pytest.raises(sinks.ConcurrentWrite):
        sinks.write_table(spark.range(7), table, ("a", 0), base=base)
    assert order == ["A", base + 1] and sinks.read_table(spark, table).count() == 5 and sinks.latest_version(spark, table)[2] == {"b": 0}
    order.clear()  # without a base, A takes the number after B's and both batches are remembered
    base += 1
    assert sinks.write_table(spark.range(7), table, ("a", 0)) == base + 2
    assert sinks.latest_version(spark, table)[2] == {"a": 0, "b": 0} and sinks.read_table(spark, table).count() == 7


def files(folder):
    return {p: p.stat().st_size for p in folder.rglob("*.parquet")}


def test_an_upsert_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table, schema = tmp_path / "t", "k string, o int, v int"
    merge = reports.upsert_batch(str(table), ["k"], ["o"], "s", buckets=64)
    merge(spark.createDataFrame([(f"k{i}", 1, i) for i in range(20_000)], schema), 0)
    first = files(table)
    merge(spark.createDataFrame([("k5", 2, -5), ("new", 1, 7)], schema), 1)
    second = files(table)
    added = sum(size for p, size in second.items() if p not in first)
    assert 0 < added < sum(first.values()) / 16
    merge(spark.createDataFrame([], schema), 2)
    assert files(table) == second and sinks.latest_version(spark, str(table))[2] == {"s": 2}
    rows = {r.k: r.v for r in sinks.read_table(spark, str(table)).collect()}
    assert rows == {f"k{i}": i for i in range(20_000)} | {"k5": -5, "new": 7}
    # a plain version is dealt into buckets again; duplicates of untouched keys and NULL keys stay
    sinks.write_table(spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 1, 3)], schema), str(table))
    merge(spark.createDataFrame([("", 5, 4), ("b", 1, 6)], schema), 3)
    assert sorted((r.k, r.v) for r in sinks.read_table(spark, str(table)).collect()) == [("", 4), ("a", 1), ("a", 2), ("b", 6)]
    empty = reports.upsert_batch(str(tmp_path / "e"), ["k"], ["o"], "s")
    empty(spark.createDataFrame([], schema), 0)
    assert sinks.read_table(spark, str(tmp_path / "e")).count() == 0


def test_two_streams_on_one_table_and_a_restart(spark, tmp_path):
    table, schema = str(tmp_path / "t"), "k string, o int, v int"
    for n in range(2):
        (tmp_path / f"in{n}").mkdir()

    def run(n):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / f"in{n}"))
        return reports.stream_upsert(stream, table, ["k"], ["o"], str(tmp_path / f"c{n}"), buckets=8)

    want = {}
    for turn in range(2):  # the second turn restarts both streams from their checkpoints
        for n in range(2):
            for f in range(3):
                rows = [{"k": f"{n}-{i}", "o": turn, "v": 100 * turn + 10 * f + i} for i in range(f, f + 4)]
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in{n}"))
        both = [run(0), run(1)]
        for q in both:
            q.awaitTermination()
        got = {r.k: r.v for r in sinks.read_table(spark, table).collect()}
        assert set(got) == {f"{n}-{i}" for n in range(2) for i in range(6)}
        assert all(v // 100 == turn for v in got.values())
        want = got
    assert len(want) == 12 and sum(sinks.latest_version(spark, table)[2].values()) == 10


def test_a_session_without_a_shared_folder_runs(tmp_path):
    code = (
        "from plumbline.session import build_session, shared_folder\n"
        "from plumbline.operators.features import oof_target_rate\n"
        "s = build_session('bare', 'local[2]', 2)\n"
        "df = s.createDataFrame([('a', 1, 0), ('a', 0, 1), ('b', 1, 1)], 'g string, y int, fold int')\n"
        "assert s.sparkContext.getConf().get('spark.checkpoint.dir') is None\n"
        "assert oof_target_rate(df, 'g', 'y').count() == 3 and shared_folder(s) == shared_folder(s)\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_batch_merges_anew_after_another_commit(spark, tmp_path, monkeypatch):
    table, schema = f"file://{tmp_path}/t", "k string, o int, v int"
    merge = reports.upsert_batch(table, ["k"], ["o"], "s")
    merge(spark.createDataFrame([("a", 1, 1)], schema), 0)
    real, raced = reports.upsert_table, []

    def write(*args):
        if not raced:
            raced.append(sinks.write_table(spark.createDataFrame([("a", 1, 1), ("z", 1, 5)], schema), table))
        return real(*args)

    monkeypatch.setattr(reports, "upsert_table", write)
    merge(spark.createDataFrame([("b", 1, 2)], schema), 1)
    assert sorted((r["k"], r["v"]) for r in sinks.read_table(spark, table).collect()) == [("a", 1), ("b", 2), ("z", 5)]


def test_retraining_one_task_keeps_the_other_model(spark, tmp_path):
    from plumbline.operators import models

    root = f"file://{tmp_path}/registry"
    make = lambda task: models.Estimator(task, models.FrameParams(medians={"x": 1.0}, overall={"sector": 0.5}), {"blind_auc": 0.6}, {"aware": ["x"], "blind": ["x"]}, 0.0)
    assert models.save_version(spark, {"time": make("time"), "cost": make("cost")}, root) == 1
    changed = make("time")
    changed.metrics["blind_auc"] = 0.7
    assert models.save_version(spark, {"time": changed}, root) == 2
    version, found = models.load_latest(spark, root)
    assert version == 2 and set(found) == {"time", "cost"}
    assert found["time"].metrics["blind_auc"] == 0.7 and found["cost"].metrics["blind_auc"] == 0.6


def test_running_totals_keep_every_row_and_follow_the_data(spark):
    from plumbline.plans import ordered

    rows = [(0.0, 0), (1.0, 3)]
    got = ordered.running_totals(spark.createDataFrame(rows, "v double, n long"), "v", ["n"]).collect()
    assert sorted((r.v, r.n_before, r.n_total) for r in got) == [(0.0, 0, 3), (1.0, 0, 3)]
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for ranges in ("true", "false"):  # one range, or as many as there are shuffle partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", ranges)
        df = spark.range(1, 501).selectExpr("CAST(id * id % 1009 AS DOUBLE) AS v", "id AS n").groupBy("v").agg({"n": "sum"}).toDF("v", "n")
        for down in (False, True):
            found = sorted(((r.v, r.n, r.n_before, r.n_total) for r in ordered.running_totals(df, "v", ["n"], descending=down).collect()), reverse=down)
            total = 0
            for v, n, before, whole in found:
                assert before == total and whole == 125_250
                total += n
        by = df.selectExpr("IF(v % 3 = 0, NULL, v % 3) AS g", "v", "n")
        for g in (None, 1.0, 2.0):
            found = sorted((r.v, r.n, r.n_before, r.n_total) for r in ordered.running_totals(by, "v", ["n"], ["g"]).collect() if r.g == g)
            assert [f[2] for f in found] == [sum(f[1] for f in found[:i]) for i in range(len(found))] and {f[3] for f in found} == {sum(f[1] for f in found)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_rank_cut_with_ties_and_nulls(spark):
    from plumbline.plans import ordered

    rows = [(i, None if i % 11 == 0 else float(i * 7 % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, s double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for k in (1, 30, 81, 185, 200, 999):
        got = ordered.rank_cut(df, "s", "i", lambda n, k=k: F.lit(k))
        assert sorted(r.i for r in got.collect()) == sorted(i for i, _ in order[:k])
    assert ordered.rank_cut(df.limit(0), "s", "i", lambda n: F.lit(3)).count() == 0


def test_portal_export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('"Report"\n\n"Sr.\nNo.","Sector","M","ID","N","O","L","E"\n"1","POWER","M","P1","Name\ntwo","1,200.50","-","3"\n')
    rows = tables.read_portal_export(spark, str(path)).collect()
    assert [(r["serial"], r["project_name"], r["original_cost_cr"], r["revised_cost_cr"]) for r in rows] == [(1, "Name\ntwo", 1200.5, None)]


def test_year_covariates_fill_both_ways(spark):
    df = spark.createDataFrame([(y,) for y in (2014, 2015, 2016, 2018)], "approval_year int")
    yearly = spark.createDataFrame([(2015, 1.0), (2017, 3.0)], "year int, x double")
    got = {r["approval_year"]: r["x"] for r in assembly.attach_year_covariates(df, yearly, ["x"]).collect()}
    assert got == {2014: 1.0, 2015: 1.0, 2016: 3.0, 2018: 3.0}


def test_impute_takes_both_coordinates(spark):
    rows = [("a", 10.0, 20.0), ("a", 12.0, 22.0), ("a", 99.0, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "sector string, geo_latitude double, geo_longitude double")
    got = sorted((r["sector"], r["geo_latitude"], r["geo_longitude"]) for r in geo.impute_group_mean(df).collect())
    assert got == [("a", 10.0, 20.0), ("a", 11.0, 21.0), ("a", 12.0, 22.0), ("b", 11.0, 21.0)]


def test_linear_models_of_many_groups_equal_single_fits(spark):
    import numpy as np

    from plumbline.operators import linear

    rng = np.random.default_rng(8)
    rows = []
    for g in range(4):
        for _ in range(150 + 40 * g):
            a, b = rng.normal(), rng.normal() * 50 + 300
            z = (g - 1) * a + 0.02 * (b - 300) + 0.3
            rows.append((g, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-z))), float(z + rng.normal())))
    df = spark.createDataFrame(rows, "g int, a double, b double, y int, v double")
    fits, lines = linear.fit_logistic_models(df, ["g"], ["a", "b"], "y"), linear.fit_linear_models(df, ["g"], ["a", "b"], "v")
    for g in range(4):
        part = np.array([r[1:] for r in rows if r[0] == g])
        x, w = np.column_stack([part[:, :2], np.ones(len(part))]), np.zeros(3)
        for _ in range(60):  # plain Newton on one group
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1, 1, 0.0]), x.T @ (p - part[:, 2]) + np.diag([1, 1, 0.0]) @ w)
        assert np.allclose([*fits[g,].coefficients, fits[g,].intercept], w, rtol=1e-6, atol=1e-8)
        assert np.allclose([*lines[g,].coefficients, lines[g,].intercept], np.linalg.lstsq(x, part[:, 3], rcond=None)[0], rtol=1e-6)
    alone = models.fit_logistic(df.filter("g = 2"), ["a", "b"], "y").stages[-1]
    assert np.allclose(alone.coefficients.toArray(), fits[2,].coefficients, rtol=2e-2, atol=2e-3)
    scored = linear.predict_models(df, ["g"], fits, "p")
    one = scored.filter("g = 1").withColumn("same", F.abs(F.col("p") - fits[1,].predict()) < 1e-12)
    assert one.filter("NOT same").isEmpty()
    by = {r.g: (r.recall_at_top, r.lift) for r in evaluate.recall_at_top_by(scored.withColumn("p", F.round("p", 1)).withColumn("i", F.monotonically_increasing_id()).transform(cut), "p", "y", "i", ["g"]).collect()}
    assert set(by) == {0, 1, 2, 3}


def cut(df):
    from plumbline.session import cut_lineage

    return cut_lineage(df)


def test_recall_by_group_equals_that_of_each_group(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, float(rng.randrange(6)), rng.randrange(2)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g int, s double, y int")
    got = {r.g: (r.recall_at_top, r.lift) for r in evaluate.recall_at_top_by(df, "s", "y", "i", ["g"]).collect()}
    for g in range(3):
        one = evaluate.recall_at_top(df.filter(f"g = {g}"), "s", "y", "i").first()
        assert got[g] == (one["recall_at_top"], one["lift"])


def test_holdouts_in_shared_scans_equal_the_loop(spark):
    from plumbline.operators import experiments as ex

    rng = random.Random(4)
    rows = []
    for i in range(1500):
        year, cost, ratio = rng.randrange(2008, 2020), rng.choice([None, 100.0, 900.0, 2500.0]), rng.random()
        late = int(rng.random() < 0.2 + 0.5 * ratio)
        rows.append((i, rng.choice("AB"), rng.choice(["x", "y", None]), f"p{i}", year, float(rng.choice([0, 3, 5])), cost or 50.0, ratio * (cost or 50.0), late, float(late * rng.randrange(1, 60)), None if i % 7 == 0 else 20.0, 70.0, 2024.42))
    names = "project_id, sector, agency, project_name, approval_year, planned_duration_years, original_cost_cr, expenditure_cum_cr, delayed, tor_months, geo_latitude, geo_longitude, snap_year"
    df = spark.createDataFrame(rows, names.split(", "))
    spec = models.Learners(names=("linear",))
    task = ex.TIME_TASK
    together = {(r.experiment, r.cutoff, r.metric): r.value for r in ex.temporal_holdout(df, task, (2014, 2016, 2030), ("full", "decay", "rolling"), spec).collect()}
    clean = assembly.clean_for_eval(df, task.label)
    for mode in ("full", "rolling"):
        alone = ex.evaluate_split(*assembly.temporal_split(clean, 2016), task, 2016, mode, spec)
        for metric, value in alone.items():
            exact = metric in ("n_train", "n_test", "test_base_rate", "naive_mae")
            assert together[f"temporal_{mode}", 2016, metric] == pytest.approx(value, abs=1e-9 if exact else 0.02, rel=1e-9 if exact else 0.03), metric
    assert together["temporal_full", 2030, "n_test"] == 0 and ("temporal_full", 2030, "auc") not in together
    found = {(r.experiment, r.metric): r.value for r in ex.ablation(df.withColumn("state", F.col("project_id") % 9), task, {"none": ["log_original_cost"], "all": [*task.inputs, "sector_rate"]}, k=3, spec=spec).collect()}
    assert found["ablation_all", "auc_gain"] > 0.05


def test_nearest_place_equals_brute_force(spark):
    rng = random.Random(21)
    places = [(f"p{i:03}", rng.uniform(-90, 90), rng.choice([-180.0, 180.0, rng.uniform(-180, 180), rng.uniform(10, 11)])) for i in range(300)] + [("twin", 5.0, 10.5), ("also", 5.0, 10.5), ("MULTI STATE", 0.0, 0.0)]
    points = [(i, rng.choice([-90.0, 90.0, rng.uniform(-90, 90)]), rng.choice([-180.0, 180.0, rng.uniform(-180, 180), 10.5, 5000.0])) for i in range(400)] + [(900, 5.0, 10.5), (901, None, 1.0), (902, 5.0, 10.5)]
    df = spark.createDataFrame(points, "id int, geo_latitude double, geo_longitude double")
    table = spark.createDataFrame(places, "state string, lat double, lon double")
    got = {r.id: r.state for r in geo.nearest_place(df, table).collect()}
    for i, y, x in points:
        want = "UNKNOWN" if y is None else min(((y - b) * (y - b) + (x - c) * (x - c), n) for n, b, c in places if n != "MULTI STATE")[1]
        assert got[i] == want
    for few in ([], [("one", 1.0, 2.0)], [("a", 1.0, 1.0), ("b", 1.0, 1.0)]):
        near = geo.nearest_place(df, spark.createDataFrame(few, table.schema))
        assert {r.state for r in near.filter("geo_latitude IS NOT NULL").collect()} == {min((n for n, *_ in few), default="UNKNOWN")}


def test_fuzzy_match_with_a_token_in_a_third_of_all_rows(spark):
    rng = random.Random(17)
    vocabulary = [f"token{i:03}x" for i in range(60)]

    def names(n, at):
        return [(at + i, " ".join([*rng.sample(vocabulary, rng.randrange(2, 7)), *(["commonword"] if i % 3 == 0 else []), *(["another1"] if i % 4 == 0 else [])])) for i in range(n)]

    left, right = names(150, 0), names(200, 1000)
    prints = lambda t: {w[:6] if len(w) >= 5 else None for w in t.split()} - {None}
    df = [spark.createDataFrame(x, "id long, project_name string") for x in (left, right)]
    fp = {r.id: set(r.fp) for x in df for r in x.select("id", geo.fingerprint(F.col("project_name")).alias("fp")).collect()}
    want = {}
    for i, _ in left:
        best = min(((-len(fp[i] & fp[j]), j) for j, _ in right), default=None)
        if best and -best[0] >= 3:
            want[i] = (best[1], -best[0])
    assert {r.id: (r.matched_id, r.shared) for r in geo.fuzzy_match(*df, "id", "id").collect()} == want and want and prints


def test_states_from_a_table_of_names(spark):
    names = spark.createDataFrame([("NORTH ABC",), ("NORTH",), ("ABC & DEF",), ("GHI",), (None,)], "n string")
    rows = ["x [1]ORG,NORTHA", "x [1]ORG,no rth", "road in abc & def to ghi", "northern road", "ghi-north abc", "x [1]ORG,of GHI", None, "", "x [1]ORG,XY"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate([*rows, rows[0]])], "project_name string, i int")
    got = {r.i: r.state for r in geo.extract_state(df, names=names, codes={"XY": "CODE"}).collect()}
    assert got == {0: "NORTH ABC", 1: "NORTH ABC", 2: "ABC & DEF", 3: None, 4: "GHI", 5: "GHI", 6: None, 7: None, 8: "CODE", 9: "NORTH ABC"}


def test_a_model_saved_while_a_stream_runs_scores_the_next_batch(spark, tmp_path):
    registry, source = str(tmp_path / "r"), tmp_path / "in"
    source.mkdir()
    schema = "project_id long, sector string, agency string, approval_year int, planned_duration_years double, original_cost_cr double, expenditure_cum_cr double, geo_latitude double, geo_longitude double, snap_year double"
    rows = [(i, "AB"[i % 2], "x", 2015, 3.0, 100.0 + i, 50.0, 20.0, 70.0, 2024.42) for i in range(40)]

    def estimator(label):
        train = spark.createDataFrame(rows, schema).withColumn("delayed", F.expr(label).cast("int"))
        raw = models.raw_features(train)
        params = models.fit_params(raw, "delayed", ["log_original_cost"], ("sector", "agency"))
        return models.Estimator("time", params, {}, {"aware": ["log_original_cost"]}, 0.0, {"aware": models.fit_logistic(models.apply_params(raw, params), ["log_original_cost"], "delayed")})

    models.save_version(spark, {"time": estimator("project_id > 20")}, registry)
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    real, seen = reports.score_batches(registry, "time", str(tmp_path / "out")), []

    def batch(df, number):
        real(df, number)
        seen.append(number)
        if number == 0:  # between two batches of one running stream
            models.save_version(spark, {"time": estimator("project_id <= 20")}, registry)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert seen == [0, 1, 2] and out.count() == 40
    assert {(r.batch, r.model_version) for r in out.select("batch", "model_version").distinct().collect()} == {(0, 1), (1, 2), (2, 2)}
    slope = {v: out.filter(f"model_version = {v}").stat.corr("delay_prob", "original_cost_cr") for v in (1, 2)}
    assert slope[1] > 0.5 and slope[2] < -0.5
    before = out.count()
    real(spark.createDataFrame(rows[:5], schema), 2)  # a batch replayed replaces its own rows
    assert spark.read.parquet(str(tmp_path / "out")).count() == before - len(rows[2::3]) + 5 or before == 40


def test_hazard_fit_equals_that_of_the_person_period_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i % 2, float(rng.normal()), float(rng.integers(0, 5)), float(rng.integers(1, 260)), int(rng.random() < 0.4)) for i in range(400)]
    rows += [(0, None, 1.0, 30.0, 1), (1, 0.5, 1.0, 5000.0, 1)]
    df = spark.createDataFrame(rows, "g int, x double, z double, months double, event int")
    fits = survival.fit_hazards(df, ["g"], ["x", "z"], cap=6)
    inputs = ["x", "z", *[f"__b{b}" for b in range(1, 7)]]
    exploded = survival.person_period(df.filter("x is not null"), 6)
    exploded = exploded.withColumns({f"__b{b}": (F.col("period_bucket") == b).cast("double") for b in range(1, 7)})
    plain = linear.fit_logistic_models(exploded, ["g"], inputs, "y")
    for g in (0, 1):
        assert fits[g,].inputs == tuple(inputs)
        assert np.allclose(fits[g,].coefficients, plain[g,].coefficients, atol=1e-6)
        assert abs(fits[g,].intercept - plain[g,].intercept) < 1e-6


def test_snapshot_and_state_rows(spark):
    schema = "id long, sector string, name string, approval string, doc string, cost string, spent string, progress string"
    rows = [
        (1, "Power", "Dam one (KERALA)", "01/2010", "03/2015 (04/2016) {06/2017}", "1,200.5 (1,500) {N.A.}", "900", "40.5"),
        (2, None, "Road", "in (Mar 2011) or so", "05/2014 {02/2013}", "100 (-) {150}", "-", None),
        (3, "Rail", "abc (x)", "01/2010", "03/2015", "10", "1", "1"),
        (4, "Rail", "Long enough", None, None, None, None, None),
    ]
    got = {r.id: r for r in assembly.snapshot_rows(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert sorted(got) == [1, 2, 4]
    a, b, c = got[1], got[2], got[4]
    assert (a.sector, a.project_name, a.revised_cost_cr, a.anticipated_cost_cr) == ("POWER", "DAM ONE", 1500.0, None)
    assert (a.cost_overrun_pct, a.overrun_flag, a.delayed, a.tor_months, a.planned_duration_years) == (24.9479, 1, 1, 27.0, 5.0)
    assert (b.sector, b.approval_year, b.original_doc_year, b.revised_cost_cr, b.cost_overrun_pct) == ("", 2011, 2014, None, 50.0)
    assert (b.delayed, b.tor_months, b.planned_duration_years, b.expenditure_cum_cr) == (0, 0.0, 3.0, None)
    assert (c.cost_overrun_pct, c.overrun_flag, c.delayed, c.tor_months) == (0.0, 0, None, None)

    def cells(name, n, pct, span):
        return ["1", name, n, "", "", pct, "", "", "", span]

    table = [
        (2, cells("TRIPUR", "7", "9", "1 - 2")),
        (1, cells(" tripura\n", "1,205.9", "12.5-x y", "-3\n- 150")),
        (3, cells("Goa", "x", "", "Nil")),
        (4, cells("Total", "9", "9", "9 - 9")),
        (5, cells(None, "9", "9", "9 - 9")),
        (6, ["1", "GOA"]),
        (7, None),
    ]
    labels = spark.createDataFrame([("TRIPURA", "TRIPURA"), ("TRIPUR", "TRIPURA"), ("GOA", "GOA"), ("GOA", "GOA")], "name string, state string")
    got = assembly.state_rows_from_cells(spark.createDataFrame(table, "page int, cells array<string>"), labels, ["page"])
    assert sorted(map(tuple, got.collect())) == [("GOA", 0, None, None, None), ("TRIPURA", 1205, 12.5, -3, 150)]
