"""The streaming forms, run to completion over files."""

import datetime

from quern.streaming import flags

SCHEMA = "transaction_id string, channel string, txn_timestamp timestamp, is_near_duplicate boolean"


def rows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10)
    data = [("a", "POS", t, False), ("b", "POS", t + datetime.timedelta(minutes=5), True), ("a", "POS", t + datetime.timedelta(seconds=30), False), ("c", "ATM", t + datetime.timedelta(hours=5), False)]
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_health_by_hour(spark, tmp_path):
    got = run(spark, flags.health_by_hour(rows(spark, tmp_path)), "health")
    assert [(r.channel, r.n, round(r.near_share, 3)) for r in got] == [("POS", 3, 0.333)]


def test_repeats_are_dropped(spark, tmp_path):
    assert sorted(r.transaction_id for r in run(spark, flags.drop_repeats(rows(spark, tmp_path), ["transaction_id"]), "firsts")) == ["a", "b", "c"]
