"""The stages of the training-text pipeline on small planted tables."""

import corpus_pipeline
from tests.llm.helpers import DOC
from tests.llm.test_native import block


def rows(spark, *found):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t))
                                  for i, t in found], DOC)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_go_by_row_where_ids_repeat_or_lack(spark):
    a, b, c = block(60, 1), block(60, 2), block(60, 3)
    near = a + " more"
    kept = [(1, a), (7, b), (None, c), (9, None), (None, None), (None, None), (4, "one"), (8, "")]
    gone = [(7, near), (7, b), (3, b.upper()) , (None, near), (None, c + " x"), (None, c), (9, None)]
    kept[1], gone[2] = gone[2], kept[1]  # 3 is the smaller id of the copies
    out = corpus_pipeline.drop_near_duplicates(spark, rows(spark, *kept, *gone), "")
    got = left(out)
    assert out.columns == rows(spark).columns
    c_left = [x for x in got if x[0] is None and x[1]]
    assert len(c_left) == 1 and c_left[0][1] in (c, c + " x")  # one of the group without ids
    assert [x for x in got if x not in c_left] == sorted((x for x in kept if x != (None, c)), key=repr)


def test_near_duplicates_keep_the_clean_text_of_a_repeated_id(spark):
    a, b = block(60, 1), block(60, 2)
    out = corpus_pipeline.drop_near_duplicates(spark, rows(spark, (1, a), (2, a + " x"), (2, b)), "")
    assert left(out) == [(1, a), (2, b)]


def test_lines_and_benchmark_stages_on_planted_and_empty_tables(spark, tmp_path):
    a, b, item = block(60, 1), block(60, 2), block(20, 3)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = rows(spark, (1, a), (2, a), (3, a + "\nown"), (4, b), (5, None), (5, ""), (None, b + " " + item))
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert left(lines) == sorted([(1, a), (3, "own"), (4, b), (5, None), (5, ""),
                                  (None, b + " " + item)], key=repr)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left(clean) == sorted([(1, a), (2, a), (3, a + "\nown"), (4, b), (5, ""), (5, None)],
                                 key=repr)
    for step in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_contaminated):
        assert left(step(spark, rows(spark), str(tmp_path))) == []
