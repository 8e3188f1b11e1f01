"""Loading a filter document into the product table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.update import filter_updates, rejected_updates, set_filters
from shelfmark.session import by_merge, stage
from shelfmark.sources.filters import read_filter_document
from shelfmark.sources.tables import read_table, write_table
from shelfmark.sources.versions import read_version, update_table


@dataclass
class Loaded:
    table: DataFrame    # the products as written to the new path or version
    updated: int        # products that got new filters
    unknown: int        # usable entries, one per id, without a product
    rejected: int       # entries without filters or without a whole-number id


def load_filters(spark: SparkSession, document: str, table: str, out: str,
                 lines: bool = False) -> Loaded:
    """Read the document, update the products of ``table`` and write them to ``out``.

    The old table stays as it is, so a lost job changes nothing: point readers to ``out`` once it
    is complete. Loading the same document again gives the same table.
    """
    if out.rstrip("/") == table.rstrip("/"):
        raise ValueError("the updated table needs a path of its own")
    entries = stage(read_filter_document(spark, document, lines), "entries")
    updates = stage(filter_updates(entries), "updates")
    products = read_table(spark, table)
    written = write_table(set_filters(products, updates), out)
    ids = products.select("product_id")
    return Loaded(written, ids.join(by_merge(updates), "product_id", "left_semi").count(),
                  updates.join(by_merge(ids), "product_id", "left_anti").count(),
                  rejected_updates(entries).count())


def load_version(spark: SparkSession, document: str, root: str, lines: bool = False) -> Loaded:
    """Read the document and commit the next version of the product table below ``root``.

    Only the files that hold an updated product are rewritten. Readers of ``root`` see the new
    version once it is whole; a job that dies before leaves the last one.
    """
    entries = stage(read_filter_document(spark, document, lines), "entries")
    updates = stage(filter_updates(entries), "updates")
    ids = read_version(spark, root).select("product_id")
    unknown = updates.join(by_merge(ids), "product_id", "left_anti").count()
    updated = ids.join(by_merge(updates), "product_id", "left_semi").count()
    table = update_table(spark, root, updates, "product_id", lambda rows: set_filters(rows, updates))
    return Loaded(table, updated, unknown, rejected_updates(entries).count())
