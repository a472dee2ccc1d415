"""The spans of records are found in one order."""

import contextlib
import io

from doclake.operators import records


def test_spans_sort_a_stream_once(spark):
    rows = spark.createDataFrame([(1, "s", 0, 77, 0, "head")], "doc_id int, stream string, rec int, tag int, level int, ctrl string")
    for of in (records.table_of_record, records.route_header_footer):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            of(rows).explain()
        assert out.getvalue().count("+- Sort") == 1


def test_a_closed_table_has_no_cells_and_the_next_one_its_own(spark):
    told = [(77, 2), (72, 2), (67, 3), (66, 1), (72, 2), (77, 2), (67, 3), (72, 2), (66, 0), (77, 0), (72, 0)]
    rows = spark.createDataFrame([(1, "s", i, tag, level) for i, (tag, level) in enumerate(told)], "doc_id int, stream string, rec int, tag int, level int")
    got = [(r["tbl"], r["cell"]) for r in records.table_of_record(rows).orderBy("rec").collect()]
    assert got == [(0, None), (0, 1), (0, 1), (None, None), (None, None), (5, None), (5, None), (5, 7), (None, None), (9, None), (9, 10)]
