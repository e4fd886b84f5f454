"""Queries do the whole job that their names promise."""

from pyspark.sql import functions as F

from plumbline.operators import linear, models
from plumbline.queries import QUERIES, learning


def test_classifiers_query_fits_full_size_learners(spark, monkeypatch):
    i = F.col("id")
    frame = spark.range(0, 200, 1, 2).select(
        i.alias("project_id"), (1996 + i % 8).cast("int").alias("approval_year"), (i % 3 == 0).cast("int").alias("delayed"),
        F.col("id").cast("double").alias("tor_months"), *[((i * (7 + k)) % 13).cast("double").alias(c) for k, c in enumerate(learning.INPUTS)],
    )
    asked, real = [], models.classifiers

    def told(n, spec=models.Learners()):
        asked.append(real(n, spec))
        return {name: linear.Linear("classify", n) for name in asked[-1]}

    monkeypatch.setattr(learning, "time_frame", lambda spark, d: frame)
    monkeypatch.setattr(models, "classifiers", told)
    got = QUERIES["classifiers"](spark, "").collect()
    assert [r.learner for r in got] == ["linear", "forest", "boosted"]
    assert asked[0]["forest"].getNumTrees() == 400 and asked[0]["boosted"].rounds == 400
