"""Where staged tables go, and the layout of the joins that feed them."""

import pytest
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.operators.filters import ENTRY, unique_filters


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Stub:
    def __init__(self, master, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app"})


def test_shared_folder_comes_from_the_session():
    assert session.shared_folder(Stub("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_folder(Stub("yarn", spark_shelfmark_sharedDir="s3a://b")) == "s3a://b"
    for master in ("yarn", "local[2]"):
        with pytest.raises(ValueError):
            session.shared_folder(Stub(master))


def test_release_removes_what_a_flow_wrote(spark):
    session.stage(spark.range(3), "gone")
    path = session._written[spark.sparkContext.applicationId][-1]
    assert spark.read.parquet(path).count() == 3
    session.release(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_stage_keeps_rows_and_schema(spark):
    rows = spark.range(5).withColumn("a", F.array(F.col("id")))
    staged = session.stage(rows, "t")
    assert staged.schema.simpleString() == rows.schema.simpleString()
    assert sorted(r.id for r in staged.collect()) == [0, 1, 2, 3, 4]


def test_unique_filters_need_one_shuffle(spark):
    rows = spark.range(10).select(
        F.col("id").alias("product_id"), F.struct(F.lit(1).alias("col_ord")).alias("seq"),
        *[F.lit(1).alias(c) for c in ENTRY])
    plan = unique_filters(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
