"""Queries of lists and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.jobs.fixtures import CELL_KEYS, NUMBERED_ITEMS, built, cells, duck, html_docs, list_items
from doclake.operators import lists, tables

LEVELS = [
    ("n0", 0, "decimal", "%1.", 1), ("n0", 1, "lowerLetter", "%1.%2.", 3), ("n0", 2, "lowerRoman", "%3)", 1),
    ("n1", 0, "ganada", "%1.", 1), ("n1", 1, "bullet", "o", 1), ("n1", 2, "upperRoman", "%1-%3", 1),
]


def levels(spark):
    return spark.createDataFrame(LEVELS, "num_id string, ilvl long, fmt string, text string, start int")


def list_counters(spark, sf_dir):
    items = built(spark, sf_dir, list_items).join(F.broadcast(levels(spark)), ["num_id", "ilvl"])
    return lists.list_counters(items).select("doc_id", "blk", "num_id", "ilvl", "counter")


def list_labels(spark, sf_dir):
    return lists.list_labels(built(spark, sf_dir, list_items), levels(spark))


def list_levels(spark, sf_dir):
    paragraphs = built(spark, sf_dir, list_items).selectExpr("doc_id", "blk", "ilvl", "CASE WHEN blk % 5 = 0 THEN '0' ELSE num_id END AS num_id")
    nums = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, concat('n', o_custkey % 2) AS num_id, o_custkey % 3 AS abstract_id FROM {orders}")
    level = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, o_custkey % 3 AS abstract_id, o_orderkey % 3 AS ilvl, o_custkey AS `left`, o_custkey % 100 AS hanging FROM {orders}")
    return lists.list_levels(paragraphs, nums, level)


def html_cells(spark, sf_dir):
    return tables.html_table_cells(built(spark, sf_dir, html_docs))


def col_addr(spark, sf_dir):
    placed = tables.place_cells(tables.html_table_cells(built(spark, sf_dir, html_docs)), "doc_id")
    return placed.select("doc_id", "row", "text", "col_addr")


def nested(spark, sf_dir):
    """Tables in tables, as deep as the customer's number tells, and one beside them."""
    docs = built(spark, sf_dir, "SELECT c_custkey AS doc_id, concat('<p>a</p>', repeat('<table><tr><td>', CAST(c_custkey % 7 + 1 AS INT)), c_name, repeat('</td></tr></table>', CAST(c_custkey % 7 + 1 AS INT)), '<table>b</table>') AS html FROM {customer}")
    return tables.extract_tables(docs)


def widths(spark, sf_dir):
    rows = built(spark, sf_dir, f"SELECT l_orderkey AS doc_id, rn - 1 AS col, CASE WHEN l_orderkey % 3 > 0 THEN 10 + l_partkey % 200 END AS px FROM ({NUMBERED_ITEMS}) q")
    return tables.normalise_widths(rows, "doc_id")


K = ("doc_id", "tbl")
grid = lambda s, d: tables.grid_columns(built(s, d, cells), *K)
spans = lambda s, d: tables.row_spans(grid(s, d), *K)


def spanned(spark, sf_dir):
    """Cells with both spans, merged-away ones gone."""
    own = grid(spark, sf_dir)
    return own.join(tables.row_spans(own, *K), [*K, "r", "col"]).where("row_span > 0").withColumnsRenamed({"r": "row", "span": "col_span"})


def merges(spark, sf_dir):
    cells_ = spanned(spark, sf_dir)
    one, two = tables.materialise_merges(cells_, *K), tables.materialise_merges(cells_, *K, by_column=True)
    return one.withColumn("mode", F.lit("row")).unionByName(two.withColumn("mode", F.lit("column"))).groupBy(*K, "mode").agg(F.count("*").alias("n"), F.sum("col_span").alias("wide"), F.sum(F.col("row") * F.col("col")).alias("sum_"))


def padded(spark, sf_dir):
    return tables.pad_grid(grid(spark, sf_dir).withColumnsRenamed({"r": "row", "span": "col_span"}), *K)


def borders(spark, sf_dir):
    own = "CASE WHEN l_partkey % 3 = 0 THEN 'own' END"
    rows = built(spark, sf_dir, f"""SELECT l_orderkey, rn, l_partkey % 3 AS row, l_suppkey % 4 AS col, 1 AS row_span, 1 + l_partkey % 2 AS col_span, 3 AS rows, 4 AS cols,
        {own} AS own_left, NULL AS own_right, NULL AS own_top, {own} AS own_bottom, 'L' AS table_left, 'R' AS table_right, 'T' AS table_top, 'B' AS table_bottom, 'h' AS inside_h, 'v' AS inside_v FROM ({NUMBERED_ITEMS}) q""")
    return tables.cell_borders(rows).select("l_orderkey", "rn", "left", "right", "top", "bottom")


def line_widths(spark, sf_dir):
    return built(spark, sf_dir, "SELECT p_partkey, p_size FROM {part}").select("p_partkey", tables.nearest_width_mm(F.col("p_size") * 2).alias("mm"))


def span_widths(spark, sf_dir):
    wide = built(spark, sf_dir, f"SELECT DISTINCT {CELL_KEYS}, l_linenumber - 1 AS w_col, 100 * l_linenumber AS w FROM {{lineitem}}")
    return tables.cell_widths(grid(spark, sf_dir).withColumnsRenamed({"r": "row", "span": "col_span"}), wide, *K)


def column_widths(spark, sf_dir):
    return tables.column_widths(grid(spark, sf_dir).withColumnsRenamed({"r": "row", "span": "col_span"}), *K)


def heights(spark, sf_dir):
    own = grid(spark, sf_dir)
    rows = own.join(tables.row_spans(own, *K), [*K, "r", "col"]).where("row_span > 0")
    return tables.table_heights(tables.row_heights(rows, *K), *K)


LEVELS_SQL = "(VALUES " + ", ".join(f"('{n}', {i}, '{f}', '{t}', {s})" for n, i, f, t, s in LEVELS) + ") v(num_id, ilvl, fmt, text, start)"
COUNTED = f"""
WITH items AS MATERIALIZED (SELECT * FROM {duck(list_items)}), lv AS (SELECT * FROM {LEVELS_SQL}),
own AS MATERIALIZED (SELECT i.*, fmt, text, start FROM items i JOIN lv USING (num_id, ilvl)),
barrier AS (SELECT a.doc_id, a.blk, a.num_id, g.j, coalesce(max(b.blk), -1) AS at_ FROM own a CROSS JOIN (VALUES (0), (1), (2)) g(j)
  LEFT JOIN own b ON b.doc_id = a.doc_id AND b.num_id = a.num_id AND b.blk <= a.blk AND b.ilvl < g.j AND b.fmt <> 'bullet' GROUP BY ALL),
val AS MATERIALIZED (SELECT r.doc_id, r.blk, r.num_id, r.j, count(b.blk) AS n FROM barrier r
  LEFT JOIN own b ON b.doc_id = r.doc_id AND b.num_id = r.num_id AND b.blk <= r.blk AND b.blk > r.at_ AND b.ilvl = r.j AND b.fmt <> 'bullet' GROUP BY ALL)"""
# by runs of `continue` cells: their row less their number along the column is constant
GRID = f"""
WITH g AS MATERIALIZED (SELECT *, CAST(coalesce(sum(span) OVER (PARTITION BY doc_id, tbl, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col FROM {duck(cells)}),
x AS MATERIALIZED (SELECT doc_id, tbl, r, col AS head, unnest(generate_series(col, col + span - 1)) AS col, vm FROM g),
m AS MATERIALIZED (SELECT *, coalesce(CASE WHEN col = head THEN vm END, '') = 'continue' AS cont FROM x),
runs AS MATERIALIZED (SELECT *, r - row_number() OVER (PARTITION BY doc_id, tbl, col ORDER BY r) AS run FROM m WHERE cont),
len AS MATERIALIZED (SELECT doc_id, tbl, col, min(r) AS first_, count(*) AS n FROM runs GROUP BY doc_id, tbl, col, run),
heads AS MATERIALIZED (SELECT doc_id, tbl, col, r FROM m WHERE NOT cont),
s AS MATERIALIZED (SELECT m.doc_id, m.tbl, m.r, m.col,
  CASE WHEN NOT m.cont THEN 1 + coalesce(l.n, 0) WHEN h.r IS NULL THEN 1 ELSE 0 END AS row_span FROM m
  LEFT JOIN len l ON NOT m.cont AND l.doc_id = m.doc_id AND l.tbl = m.tbl AND l.col = m.col AND l.first_ = m.r + 1
  LEFT JOIN runs q ON m.cont AND q.doc_id = m.doc_id AND q.tbl = m.tbl AND q.col = m.col AND q.r = m.r
  LEFT JOIN (SELECT doc_id, tbl, col, run, min(r) AS r0 FROM runs GROUP BY ALL) f ON f.doc_id = q.doc_id AND f.tbl = q.tbl AND f.col = q.col AND f.run = q.run
  LEFT JOIN heads h ON h.doc_id = f.doc_id AND h.tbl = f.tbl AND h.col = f.col AND h.r = f.r0 - 1
  WHERE m.col = m.head),
cs AS MATERIALIZED (SELECT g.*, s.row_span FROM g JOIN s USING (doc_id, tbl, r, col) WHERE s.row_span > 0)"""
ITEMS = "WITH q AS (" + NUMBERED_ITEMS.replace("{lineitem}", "lineitem") + ")"
QUERIES = {
    "list_counters": (list_counters, COUNTED + " SELECT doc_id, blk, num_id, ilvl, CASE WHEN fmt <> 'bullet' THEN n + start - 1 END AS counter FROM own JOIN val USING (doc_id, blk, num_id) WHERE j = ilvl"),
    "list_labels": (list_labels, COUNTED + """,
v AS (SELECT doc_id, blk, num_id, max(CASE WHEN j = 0 THEN n END) AS v0, max(CASE WHEN j = 1 THEN n END) AS v1, max(CASE WHEN j = 2 THEN n END) AS v2 FROM val GROUP BY ALL),
w AS (SELECT doc_id, blk, num_id, CASE WHEN v0 = 0 THEN 1 ELSE v0 END AS v0, CASE WHEN v1 = 0 THEN 1 ELSE v1 + 2 END AS v1, CASE WHEN v2 = 0 THEN 1 ELSE v2 END AS v2 FROM v)
SELECT doc_id, blk, num_id, ilvl, CASE WHEN num_id = 'n0' THEN CASE ilvl WHEN 0 THEN concat(v0, '. ') WHEN 1 THEN concat(v0, '.', chr(CAST(96 + v1 AS INT)), '. ') ELSE concat(['i','ii','iii','iv','v','vi','vii','viii','ix','x'][v2], ') ') END
  ELSE CASE ilvl WHEN 0 THEN concat(['가','각','갂','갃','간','갅','갆','갇','갈','갉'][v0], '. ') WHEN 1 THEN '○ ' ELSE concat(['가','각','갂','갃','간','갅','갆','갇','갈','갉'][v0], '-', ['I','II','III','IV','V','VI','VII','VIII','IX','X'][v2], ' ') END END AS label
FROM own JOIN w USING (doc_id, blk, num_id)"""),
    "list_levels": (list_levels, f"""SELECT i.doc_id, blk, CASE WHEN n = num_id AND lv = ilvl THEN o_custkey ELSE (ilvl + 1) * 4000 END AS "left", CASE WHEN n = num_id AND lv = ilvl THEN -(o_custkey % 100) ELSE -2000 END AS "first"
FROM {duck(list_items)} i JOIN (SELECT *, concat('n', o_custkey % 2) AS n, o_orderkey % 3 AS lv FROM orders) o ON o_orderkey = doc_id WHERE blk % 5 <> 0"""),
    "html_cells": (html_cells, ITEMS + """
SELECT l_orderkey AS doc_id, 0 AS row, 0 AS nth, 'th' AS tag, concat('Order ', l_orderkey) AS text, 2 AS colspan, 1 AS rowspan, '' AS style FROM q WHERE rn = 1
UNION ALL SELECT l_orderkey, rn, CASE WHEN rn = 1 THEN 1 ELSE 0 END, 'td', CAST(l_partkey AS VARCHAR), 1, 1, 'border:1px solid #0000ff' FROM q
UNION ALL SELECT l_orderkey, 1, 0, 'td', CAST(l_orderkey AS VARCHAR), 1, n, '' FROM q WHERE rn = 1"""),
    "html_col_addr": (col_addr, ITEMS + """
SELECT l_orderkey AS doc_id, 0 AS row, concat('Order ', l_orderkey) AS text, 0 AS col_addr FROM q WHERE rn = 1
UNION ALL SELECT l_orderkey, rn, CAST(l_partkey AS VARCHAR), 1 FROM q
UNION ALL SELECT l_orderkey, 1, CAST(l_orderkey AS VARCHAR), 0 FROM q WHERE rn = 1"""),
    "html_nested_tables": (nested, """
WITH c AS (SELECT c_custkey, c_name, unnest(generate_series(0, c_custkey % 7)) AS level FROM customer)
SELECT c_custkey AS doc_id, CAST(level AS INT) AS level, 0 AS nth, concat('<table><tr><td>', CASE WHEN level = 0 THEN c_name ELSE concat('[[table:', level - 1, ':0]]') END, '</td></tr></table>') AS html FROM c
UNION ALL SELECT c_custkey, 0, 1, '<table>b</table>' FROM customer"""),
    "table_widths": (widths, ITEMS + """,
c AS (SELECT l_orderkey AS doc_id, rn - 1 AS col, CASE WHEN l_orderkey % 3 > 0 THEN 10 + l_partkey % 200 END AS px FROM q),
w AS (SELECT *, CAST(CASE WHEN px IS NULL THEN floor(41954.0 / count(*) OVER (PARTITION BY doc_id)) ELSE floor(CAST(px AS DOUBLE) / sum(px) OVER (PARTITION BY doc_id) * 41954) END AS INT) AS w0, max(col) OVER (PARTITION BY doc_id) AS last_ FROM c)
SELECT doc_id, col, w0 + CASE WHEN col = last_ THEN 41954 - sum(w0) OVER (PARTITION BY doc_id) ELSE 0 END AS width FROM w"""),
    "grid_columns": (lambda s, d: grid(s, d).select(*K, "r", "c", "col"), f"SELECT a.doc_id, a.tbl, a.r, a.c, coalesce(sum(b.span), 0) AS col FROM {duck(cells)} a LEFT JOIN {duck(cells)} b ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.r = b.r AND b.c < a.c GROUP BY ALL"),
    "row_spans": (spans, GRID + " SELECT doc_id, tbl, r, col, row_span, row_span = 0 AS merged FROM s"),
    "materialise_merges": (merges, GRID + """,
d AS (SELECT doc_id, tbl, r, col, span, unnest(generate_series(1, row_span - 1)) AS down FROM cs WHERE row_span > 1),
e AS (SELECT *, unnest(generate_series(0, span - 1)) AS rt FROM d)
SELECT doc_id, tbl, 'row' AS mode, count(*) AS n, CAST(sum(span) AS BIGINT) AS wide, CAST(sum((r + down) * col) AS BIGINT) AS sum_ FROM d GROUP BY ALL
UNION ALL SELECT doc_id, tbl, 'column', count(*), count(*), CAST(sum((r + down) * (col + rt)) AS BIGINT) FROM e GROUP BY ALL"""),
    "pad_grid": (padded, GRID + """,
z AS (SELECT doc_id, tbl, max(r) AS lr, max(col) AS lc FROM x GROUP BY ALL), zr AS (SELECT doc_id, tbl, lc, unnest(generate_series(0, lr)) AS row FROM z), zc AS (SELECT doc_id, tbl, row, unnest(generate_series(0, lc)) AS col FROM zr)
SELECT doc_id, tbl, row, col FROM zc EXCEPT SELECT doc_id, tbl, r, col FROM x"""),
    "cell_borders": (borders, ITEMS + """
SELECT l_orderkey, rn, CASE WHEN l_partkey % 3 = 0 THEN 'own' WHEN l_suppkey % 4 = 0 THEN 'L' ELSE 'v' END AS "left", CASE WHEN l_suppkey % 4 + 1 + l_partkey % 2 >= 4 THEN 'R' ELSE 'v' END AS "right",
  CASE WHEN l_partkey % 3 = 0 THEN 'T' ELSE 'h' END AS top, CASE WHEN l_partkey % 3 = 0 THEN 'own' WHEN l_partkey % 3 = 2 THEN 'B' ELSE 'h' END AS bottom FROM q"""),
    "line_widths": (line_widths, "WITH w AS (SELECT unnest([" + ", ".join(map(str, tables.WIDTHS_MM)) + """]) AS p), x AS (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) / 8 * CAST(0.3528 AS DOUBLE) AS mm FROM part)
SELECT p_partkey, CAST(CASE WHEN mm > 5 THEN 5.0 ELSE min(p) END AS DOUBLE) AS mm FROM (SELECT *, rank() OVER (PARTITION BY p_partkey ORDER BY abs(CAST(p AS DOUBLE) - mm)) AS k FROM x, w) q WHERE k = 1 GROUP BY p_partkey, q.mm"""),
    "cell_widths": (span_widths, GRID + """,
w AS (SELECT DISTINCT """ + CELL_KEYS + """, l_linenumber - 1 AS w_col, 100 * l_linenumber AS w FROM lineitem)
SELECT g.doc_id, g.tbl, g.r AS row, g.col, CAST(sum(w) AS BIGINT) AS width FROM g JOIN w ON w.doc_id = g.doc_id AND w.tbl = g.tbl AND w_col BETWEEN g.col AND g.col + g.span - 1 GROUP BY ALL"""),
    "table_heights": (heights, GRID + """,
h AS (SELECT doc_id, tbl, r, coalesce(max(CASE WHEN row_span = 1 THEN height END), arg_min(CAST(floor(height / row_span) AS BIGINT), col) FILTER (WHERE height IS NOT NULL)) AS height FROM cs GROUP BY ALL)
SELECT doc_id, tbl, CAST(sum(coalesce(height, 1500)) AS BIGINT) AS height FROM h GROUP BY ALL"""),
    "column_widths": (column_widths, None),
}
