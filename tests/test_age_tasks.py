"""Features at ages: tasks grow in number with the events, not in size."""

from pyspark.sql import functions as F

from hosttrace.operators import features


def test_ages_are_dealt_by_events(spark, monkeypatch):
    k = F.col("id")
    text = lambda c: F.when(k % 3 == 0, c.cast("string"))
    events = spark.range(400).select(
        F.lit("linux").alias("platform"), F.lit("r").alias("run_id"), F.format_string("{%d}", k % 50).alias("ProcessGuid"), k.alias("record_id"),
        F.timestamp_seconds(k * 2).alias("UtcTime"), F.element_at(F.array(*map(F.lit, (1, 11, 3, 23))), (k % 4 + 1).cast("int")).alias("EventID"),
        F.format_string("{%d}", k % 7).alias("ParentProcessGuid"), text(k).alias("CommandLine"), text(k).alias("ParentCommandLine"),
        F.format_string("/tmp/%d.sh", k % 9).alias("TargetFilename"), text(k).alias("TargetObject"), text(k % 5).alias("DestinationIp"),
        text(k % 4).alias("DestinationPort"), text(k % 2).alias("Device"), F.lit(0).alias("label"))
    want = features.prefix_features(events)
    monkeypatch.setattr(features, "PER_TASK", 20)
    rows = features.prefix_features(events)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "20), REPARTITION_BY_NUM" in plan
    # Commands are gone from what is shuffled to their processes.
    assert not [line for line in plan.splitlines() if "Exchange" in line and "CommandLine" in line]
    assert want.count() == 450 and not want.exceptAll(rows).count()
