"""Files of many rows alike are small; that is no reason to bring their rows to the driver."""

import pytest
from pyspark.sql import functions as F

from doclake.sources import scratch


def joined(spark):
    many = scratch.stored(spark.range(200_000).select(F.lit("x" * 100).alias("text"), "id"))
    return many, spark.range(0, 200_000, 2).join(many, "id")


def test_small_files_of_many_rows_are_not_broadcast(spark, monkeypatch):
    plans = []
    many, both = joined(spark)
    assert "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()  # by the size of files
    tidied = scratch.tidied
    monkeypatch.setattr(scratch, "tidied", lambda s: plans.append(s.conf.get("spark.sql.autoBroadcastJoinThreshold")) or tidied(s))
    with scratch.measured_joins(spark):
        assert "BroadcastHashJoin" not in both.select("*")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert scratch.stored(both).count() == 100_000
    assert plans == [before] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_thresholds_come_back_after_an_error(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    with pytest.raises(ZeroDivisionError), scratch.measured_joins(spark):
        assert spark.conf.get(keys[0]) == "-1" and spark.conf.get(keys[1]) not in (None, "-1")
        1 / 0
    assert [spark.conf.get(k, None) for k in keys] == before
