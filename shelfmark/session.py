"""Session helpers: the local test session and the shared folder for staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session it provides."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SHARED_SETTING = "spark.shelfmark.sharedDir"  # settable on a running session

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else SHARED_SETTING."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_SETTING, None)
    if not folder:
        raise ValueError(f"set spark.checkpoint.dir or {SHARED_SETTING} to a folder that all "
                         "executors share")
    return folder.rstrip("/")


def name_shared_folder(spark: SparkSession, folder: str) -> None:
    """Name the shared folder of a local session that has none (entry points, tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_SETTING, None)
    if not named and spark.sparkContext.master.startswith("local["):
        spark.conf.set(SHARED_SETTING, folder)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/shelfmark/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables: the given ones, or all that this session has written.

    For the end of a flow, once its result is written. Results that still read a staged table
    are lost with it.
    """
    mine = _written.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or list(mine):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
        if path in mine:
            mine.remove(path)


#: Rows of a task that texts are dealt to.
DEALT_ROWS = 8192


def deal(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out, if fewer tasks than cores have any or if one has far more than
    DEALT_ROWS. There are as many tasks as shuffle partitions, and more for large tables.

    For steps whose work per byte is far above that of moving the bytes once. The number of rows of
    a task does not grow with the table, whatever splits its files have. Counting the rows reads no
    column.
    """
    spark = df.sparkSession
    rows = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    tasks, total, largest = rows.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0)),
                                     F.coalesce(F.max("n"), F.lit(0))).first()
    if tasks >= spark.sparkContext.defaultParallelism and largest <= 2 * DEALT_ROWS:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              -(-total // DEALT_ROWS)))


def by_merge(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: the join sorts and merges, nothing is broadcast.

    The engine takes a side's size from its files. Columns that repeat few values fill a hundredth
    of what their rows need in memory, so by its own choice it would collect millions of rows on
    the driver.
    """
    return df.hint("merge")


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None,
          compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps read the same costly intermediate, and where row numbers taken
    during a scan must not change when a lost task runs again.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
