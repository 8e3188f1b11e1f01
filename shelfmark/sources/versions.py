"""A table in versions (W1): data files never change, and a commit names the files of a version.

``root/data`` holds the files of all versions, ``root/commits`` one small text per version: the
schema, then a file per line. A commit is written under another name and renamed; the rename fails if
that number is taken. So readers see a version as a whole or not at all, a job that dies leaves the
version before as it was, and of two writers that started from the same version one is refused. An
update rewrites only the files that hold a row it changes.

One path per file passes through the driver, as it does in every scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfmark.session import by_merge


class Conflict(RuntimeError):
    """Another writer has committed the version first; run again on top of it."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/commits/{number:012d}"


def history(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    folder = f"{root.rstrip('/')}/commits"
    store = _store(spark, folder)
    if not store.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in store.listStatus(_path(spark, folder))]
    return sorted(int(n) for n in names if n.isdigit())


def _publish(spark: SparkSession, root: str, number: int, schema: T.StructType,
             files: list[str]) -> None:
    """Write the commit beside its place and rename it there."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    place = _commit_path(root, number)
    draft = f"{root.rstrip('/')}/commits/draft-{uuid.uuid4().hex}"
    out = _store(spark, draft).create(_path(spark, draft), False)
    out.write(bytearray("\n".join([schema.json(), *files]), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _store(spark, place).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, draft), _path(spark, place), no_options)
    except Py4JJavaError as e:
        _store(spark, draft).delete(_path(spark, draft), False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"{root}: version {number} is there already") from e
        raise


def _files(spark: SparkSession, root: str, number: int) -> tuple[T.StructType, list[str]]:
    lines = spark.read.text(_commit_path(root, number), wholetext=True).first()[0].split("\n")
    return T.StructType.fromJson(json.loads(lines[0])), lines[1:]


def _table(spark: SparkSession, schema: T.StructType, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as of a version, by default the last one committed."""
    known = history(spark, root)
    if not known or (number is not None and number not in known):
        raise ValueError(f"{root}: no such version")
    return _table(spark, *_files(spark, root, known[-1] if number is None else number))


def _write(spark: SparkSession, root: str, rows: DataFrame) -> list[str]:
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).inputFiles()


def create_table(rows: DataFrame, root: str, key: str, files: int | None = None) -> DataFrame:
    """Version 1, in files of key ranges, so that an update of near keys touches few of them.
    ``files`` gives their number, otherwise it follows the size."""
    spark = rows.sparkSession
    if history(spark, root):
        raise Conflict(f"{root}: the table is there already")
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    ranged = ranged.sortWithinPartitions(key)
    _publish(spark, root, 1, rows.schema, _write(spark, root, ranged))
    return read_version(spark, root)


def update_table(spark: SparkSession, root: str, keys: DataFrame, key: str,
                 change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next version: ``change`` applied to the files that hold one of ``keys``.

    ``change`` gets all rows of those files and returns rows of the same columns. Nothing is
    committed if no file holds a key.
    """
    number = history(spark, root)[-1]
    schema, files = _files(spark, root, number)
    named = {f.rsplit("/", 1)[1]: f for f in files}  # names hold the id of the job that wrote them
    hit = (_table(spark, schema, files).select(key, F.col("_metadata.file_name").alias("file"))
           .join(by_merge(keys.select(key)), key, "left_semi").select("file").distinct()) if files else None
    touched = {named[r.file] for r in hit.collect()} if files else set()
    if not touched:
        return read_version(spark, root, number)
    changed = change(_table(spark, schema, sorted(touched)))
    written = _write(spark, root, changed.select(*schema.names))
    _publish(spark, root, number + 1, schema, [f for f in files if f not in touched] + written)
    return read_version(spark, root, number + 1)
