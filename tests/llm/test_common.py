import pytest

from plumbline.llm import common as m


def broadcasts(joined):
    return "strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    ("kind", "value", "small"),
    [("array<bigint>", [1] * 2000, False), ("array<bigint>", [1] * 20, True), ("array<bigint>", None, True), ("array<binary>", [bytes(9000), None], False), ("array<string>", ["x", None], True), ("string", "x" * 9000, False), ("struct<a:bigint>", (1,), False)],
)
def test_lookups_are_sized_by_what_they_hold(spark, monkeypatch, kind, value, small):
    monkeypatch.setattr(m, "BROADCAST_BYTES", 8000)
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    right = spark.createDataFrame([(1, value)], f"id long, held {kind}")
    joined = m.lookup_join(left, right, "id")
    assert broadcasts(joined) == small
    assert [(r.id, r.held is not None) for r in sorted(joined.collect())] == [(1, value is not None), (2, False)]
