from pyspark.sql import functions as F

from loomgraph.operators import checks, merge
from loomgraph.streaming import watch


def test_drift_stream(spark, tmp_path):
    files = spark.createDataFrame([("a", "1\n2\n3\n"), ("b", "x\ny\n")], "path string, content string")
    cited = spark.createDataFrame([("r1", "a", "1-2"), ("r2", "b", "1-1"), ("r3", "a", "1-1"), ("r3", "b", "1-1")], "rule_id string, path string, lines string")
    stored = checks.digests(cited, files)
    changed = tmp_path / "in"
    spark.createDataFrame([("a", "1\n2!\n3\n")], "path string, content string").write.parquet(str(changed))
    got = []
    q = watch.drift_stream(spark.readStream.schema("path string, content string").parquet(str(changed)), stored, cited, lambda df, epoch: got.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert got == [("r1", "stale")]


def test_event_counts(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-02-20 00:00:00", "a"), ("2024-01-01 12:00:00", "a")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, k string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "e"))
    q = watch.event_counts(stream, "ts", "k").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.window_start)[:10], r.k, r.n) for r in spark.table("counted").collect()} == {("2024-01-01", "a", 3), ("2024-01-02", "b", 1)}


def test_replaced_kind(spark):
    cols = "kind string, id string"
    facts = spark.createDataFrame([("route", "a"), ("table", "b")], cols)
    assert {r.id for r in merge.replace_kind(facts, "route", spark.createDataFrame([("route", "c")], cols)).collect()} == {"b", "c"}
    assert {r.id for r in merge.replace_kind(facts, "route", facts.limit(0)).collect()} == {"a", "b"}
