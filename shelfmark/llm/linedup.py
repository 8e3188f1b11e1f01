"""Removal of repeated runs of lines by winnowing over line hashes.

A window is the shortest run of whole lines, from a line on or up to a line, that holds ``min_words``
words. Its least line hash is its fingerprint: the line of that hash is a selected position. Equal
runs of so many words hold an equal window and so select the same fingerprint, wherever they stand;
this guarantee makes the selection complete. Only selected positions are kept, fewer than lines,
each with the windows that chose it and the lines of these to its left and right.

Positions whose fingerprint occurs nowhere else are dropped. The others are joined: each with the
earliest position (smaller id, or earlier in the same text) at which the fingerprint stands in the
same window. The hashes of a pair's lines are then compared outwards from the position, to the left
and to the right, up to the first difference; what is equal is the repeated run. A repeat within one
text is taken window by window instead, since it may overlap its own source. A longer run is the
union of the runs at its positions.

Column expressions and window functions only. A window function works within one document and looks
at the lines of one window. Across documents there are grouped minima and joins with one row per key
on the right, so a passage of any frequency meets as partial minima and never as pairs of its copies.

Words are runs of characters other than blanks; lines are compared without outer blanks; lines
without words are neither counted nor removed unless every line of a text goes. Defined results:
NULL text has no lines and stays NULL; texts with fewer words than a window stay as they are; of
equal rows (same id and text) all are treated as one place, so none is removed for the other; rows
of one id with different texts are ordered by text; NULL ids come first; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import stage

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text), line, words, hash, start (words before); one row a line."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))
    rows = (docs.select("doc_id", F.xxhash64("text").alias("body"),
                        F.posexplode(trimmed).alias("line", "content"))
            .withColumn("words", F.regexp_count("content", F.lit("[^ \\t-\\r]+")))
            .filter(F.col("words") > 0)
            .select("doc_id", "body", "line", "words", F.xxhash64("content").alias("hash")))
    # one place for equal rows; the shuffle by document serves this and all windows below
    rows = rows.repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "line"])
    before = (Window.partitionBy("doc_id", "body").orderBy("line")
              .rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))


def _positions(lines: DataFrame, min_words: int) -> DataFrame:
    """Selected positions: doc_id, body, line, mark (hash), words, windows, left and right.

    ``windows`` are those that chose the line, ``left`` and ``right`` their lines on either side,
    nearest first. A window is a frame over word positions: the lines whose first word is less than
    ``min_words`` words behind the first word of a line, and the same from the end.
    """
    doc = Window.partitionBy("doc_id", "body")
    ahead = doc.orderBy("start").rangeBetween(Window.currentRow, min_words - 1)
    behind = doc.orderBy("stop").rangeBetween(-(min_words - 1), Window.currentRow)
    rows = lines.withColumn("stop", F.col("start") + F.col("words"))
    held, least = F.collect_list(F.struct("line", "hash", "words")), F.struct("hash", "line", "words")
    rows = rows.withColumns({
        "fw": held.over(ahead), "fw_min": F.min(least).over(ahead), "fw_end": F.max("stop").over(ahead),
        "bw": held.over(behind), "bw_min": F.min(least).over(behind),
        "bw_start": F.min("start").over(behind)})

    def window(way, run, mark):
        return F.struct(F.lit(way).alias("way"), F.col(run).alias("lines"), F.col(mark).alias("mark"))

    both = F.array_compact(F.array(
        F.when(F.col("fw_end") - F.col("start") >= min_words, window(0, "fw", "fw_min")),
        F.when(F.col("stop") - F.col("bw_start") >= min_words, window(1, "bw", "bw_min"))))
    first, last = F.col("w.lines")[0]["line"], F.element_at("w.lines", -1)["line"]
    run = F.xxhash64(F.transform("w.lines", lambda x: x["hash"]))
    # the windows of a text are in one task, so this grouping shuffles nothing
    chosen = (rows.select("doc_id", "body", F.explode(both).alias("w"))
              .groupBy("doc_id", "body", F.col("w.mark.line").alias("line"),
                       F.col("w.mark.hash").alias("mark"), F.col("w.mark.words").alias("words"))
              .agg(F.collect_list(F.struct("w.way", run.alias("run"), first.alias("first"),
                                           last.alias("last"))).alias("windows"),
                   F.min_by("w.lines", first).alias("from"), F.max_by("w.lines", last).alias("to")))
    left = F.reverse(F.filter("from", lambda x: x["line"] < F.col("line")))
    right = F.filter("to", lambda x: x["line"] > F.col("line"))
    return chosen.select("doc_id", "body", "line", "mark", "words", "windows",
                         left.alias("left"), right.alias("right"))


def _equal_lines(here: Column, there: Column) -> Column:
    """The lines of ``here`` up to the first whose hash differs from that in ``there``."""
    same = F.zip_with(here, there, lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, F.slice(here, F.lit(1), (stop - 1).cast("int"))).otherwise(here)


def _extended(pairs: DataFrame, positions: DataFrame, min_words: int) -> DataFrame:
    """The lines, left and right of each pair of positions, that are equal at both: doc_id, body,
    first, last, source_doc. Fewer words than ``min_words`` are no run (unequal windows of one
    hash)."""
    def at(names: tuple[str, ...], prefix: str) -> tuple[DataFrame, Column]:
        found = positions.select(*[F.col(c).alias(f"{prefix}_{c}") for c in
                                   ("doc_id", "body", "line", "words", "left", "right")])
        same = [F.col(n).eqNullSafe(F.col(f"{prefix}_{c}"))
                for n, c in zip(names, ("doc_id", "body", "line"))]
        return found, same[0] & same[1] & same[2]

    here, on_here = at(("doc_id", "body", "line"), "here")
    there, on_there = at(("source_doc", "source_body", "source_line"), "there")
    both = pairs.join(here, on_here).join(there, on_there)
    both = both.select("doc_id", "body", "line", "source_doc", F.col("here_words").alias("words"),
                       _equal_lines(F.col("here_left"), F.col("there_left")).alias("left"),
                       _equal_lines(F.col("here_right"), F.col("there_right")).alias("right"))
    words = F.aggregate(F.concat("left", "right"), F.col("words").cast("bigint"),
                        lambda acc, x: acc + x["words"])
    return both.filter(words >= min_words).select(
        "doc_id", "body", F.coalesce(F.get("left", F.size("left") - 1)["line"], "line").alias("first"),
        F.coalesce(F.get("right", F.size("right") - 1)["line"], "line").alias("last"), "source_doc")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, body, first, last (lines), source_doc: runs that occurred at an earlier place.

    Where a run overlaps its own earlier occurrence, only the lines behind that are reported.
    """
    positions = stage(_positions(_lines(docs), min_words), "positions")
    spot = F.xxhash64("doc_id", "body", "line")
    shared = (positions.groupBy("mark").agg(F.min(spot).alias("a"), F.max(spot).alias("b"))
              .filter(F.col("a") != F.col("b")).select("mark"))
    positions = stage(positions.join(shared, "mark", "left_semi"), "shared")
    windows = positions.select("doc_id", "body", "line", "mark", F.explode("windows").alias("w")) \
        .select("doc_id", "body", "line", "mark", "w.*")
    place = F.struct("doc_id", "body", "first", "last", "line")
    earliest = windows.groupBy("mark", "way", "run").agg(F.min(place).alias("source"))
    joined = windows.join(earliest, ["mark", "way", "run"])
    own = F.struct("doc_id", "body").eqNullSafe(F.struct("source.doc_id", "source.body"))
    pairs = joined.filter(~own).select(
        "doc_id", "body", "line", F.col("source.doc_id").alias("source_doc"),
        F.col("source.body").alias("source_body"), F.col("source.line").alias("source_line")).distinct()
    within = joined.filter(own).select(
        "doc_id", "body", F.greatest("first", F.col("source.last") + 1).alias("first"), "last",
        F.col("source.doc_id").alias("source_doc")).filter(F.col("first") <= F.col("last"))
    return _extended(pairs, positions, min_words).unionByName(within)


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), text without later repeats, and the counts
    n_lines, n_removed (lines) and emptied (every line with words is gone)."""
    runs = repeated_runs(docs.filter(F.col("text").isNotNull()), min_words)
    gone = (runs.select("doc_id", "body", F.explode(F.sequence("first", "last")).alias("line"))
            .groupBy("doc_id", "body").agg(F.collect_set("line").alias("gone"))
            .select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body"), "gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    # The lines travel through the join instead of the text, which is put together again after it.
    cut = docs.select(*[c for c in own if c != "text"], F.split("text", "\n", -1).alias("__lines"),
                      F.xxhash64("text").alias("__body"))
    found = cut.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id"))
                     & (F.col("__body") == F.col("gone_body")), "left")
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get("__lines", i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("__lines")).otherwise(kept), "\n")
    out = found.select(*[text.alias(c) if c == "text" else F.col(c) for c in own],
                       F.greatest(F.size("__lines"), F.lit(0)).alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    blank = ~F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    return out.withColumn("emptied", (F.col("n_removed") > 0) & blank)
