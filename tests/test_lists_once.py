"""Lists are sorted once, however many levels they have."""

import contextlib
import io

from doclake.operators import lists


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_counters_sort_a_list_once(spark):
    items = spark.createDataFrame([(1, 1, "n", 0, "decimal", 1)], "doc_id int, blk int, num_id string, ilvl int, fmt string, start int")
    assert plan(lists.list_counters(items)).count("+- Sort") == 1


def test_bullets_neither_count_nor_reset_and_gaps_show_one(spark):
    levels = spark.createDataFrame([("n", 0, "decimal", "%1.", 4), ("n", 1, "bullet", "o", 1), ("n", 2, "lowerLetter", "%1-%2-%3", 2), ("n", 8, "decimal", "%9", None)], "num_id string, ilvl int, fmt string, text string, start int")
    order = [2, 0, 2, 1, 2, 0, 2, 5, 8, 2, 0, 8]
    items = spark.createDataFrame([(1, i, "n", k) for i, k in enumerate(order)] + [(1, 99, None, None), (1, 100, "gone", 0)], "doc_id int, blk int, num_id string, ilvl int")
    got = [r["label"] for r in lists.list_labels(items, levels).orderBy("blk").collect()]
    assert got == ["1-1-b ", "4. ", "4-1-b ", "○ ", "4-1-c ", "5. ", "5-1-b ", "", "1 ", "5-1-c ", "6. ", "1 ", "", ""]
