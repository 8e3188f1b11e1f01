"""Texts are dealt out where a task of the scan has too many rows, also if all cores have tasks."""

from pyspark.sql import functions as F

from shelfmark import session


def test_large_tasks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 50, raising=False)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 2000, numPartitions=cores)  # every core has a task, of 500 rows
    dealt = session.deal(rows)
    largest = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt.rdd.getNumPartitions() == 40 and largest <= 100
    assert sorted(r.id for r in dealt.collect()) == list(range(2000))
    assert session.deal(dealt) is dealt
    assert session.deal(rows.limit(0)).count() == 0
