"""Document tables derived from the driver's tables, by SQL that gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


#: The items of each order with their number and how many there are.
NUMBERED_ITEMS = f"""SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {{lineitem}}"""


def joined(engine: str, value: str, order: str, sep: str = "chr(10)") -> str:
    """An ordered string aggregate: the one thing that the two engines write differently."""
    if engine == "spark":
        return f"listagg({value}, {sep}) WITHIN GROUP (ORDER BY {order})"
    return f"string_agg({value}, {sep} ORDER BY {order})"


def md_docs(engine: str) -> str:
    """doc_id, md: a Markdown document for each order, with a line for each of its items in a table, a list and code."""
    table = joined(engine, "concat('| ', rn, ' | ', l_partkey, ' | **', q, '** |')", "rn")
    items = joined(engine, "concat(repeat('  ', CAST(rn % 3 AS INT)), CASE WHEN l_returnflag = 'R' THEN '1. ' ELSE '- ' END, 'item ', l_partkey)", "rn")
    code = joined(engine, "concat('# code ', q)", "rn")
    return f"""
WITH li AS (
  SELECT l_orderkey, l_partkey, CAST(l_quantity AS INT) AS q, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS rn FROM {{lineitem}}),
t AS (SELECT l_orderkey, {table} AS tbl, {items} AS lst, {code} AS code FROM li GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id,
 concat('---', chr(10), 'title: "Order ', o_orderkey, '"', chr(10), 'author: "Customer ', o_custkey, '"', chr(10), '---', chr(10),
  '# Order ', o_orderkey, chr(10), chr(10),
  'Status **', o_orderstatus, '** and *', o_orderpriority, '* see [order](http://x/', o_orderkey, ')', chr(10), 'second line', chr(10), chr(10),
  '| n | part | qty |', chr(10), '| --- | --- | --- |', chr(10), coalesce(tbl, '| 0 | 0 | 0 |'), chr(10),
  coalesce(lst, '- none'), chr(10), chr(10),
  '```', chr(10), coalesce(code, '# none'), chr(10), '```', chr(10), '***', chr(10), 'end ~~x~~ ', o_custkey) AS md
FROM {{orders}} LEFT JOIN t ON l_orderkey = o_orderkey"""


def page_docs(engine: str) -> str:
    """doc_id, md: front matter with some page measures."""
    return """
SELECT o_orderkey AS doc_id,
  concat('---', chr(10), 'title: t', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat('pageWidth: ', o_custkey, chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 5 = 0 THEN concat('marginTop: ', o_custkey % 100, chr(10)) ELSE '' END, 'x: y', chr(10), '---', chr(10), 'body') AS md
FROM {orders}"""


def media_docs(engine: str) -> str:
    """doc_id, md: a line of text with links, images, a task box and a quote."""
    return """
SELECT p_partkey AS doc_id,
  concat('> see [', p_type, '](http://x/', p_partkey, ') and ![', p_brand, '](img/', p_size, '.', CASE WHEN p_size % 3 = 0 THEN 'jpeg' WHEN p_size % 3 = 1 THEN 'PNG' ELSE 'tiff' END,
         ')', chr(10), '[ ] open ![d](data:image/gif;base64,R0lG) [x] done [b](u)', chr(13), chr(10), '> end') AS md
FROM {part}"""


def html_docs(engine: str) -> str:
    """doc_id, html: a table for each order with items, with a header over two columns and a first cell over all rows."""
    rows = joined(engine, "y", "rn", "''")
    return f"""
SELECT l_orderkey AS doc_id, concat('<table><tr><th colspan="2">Order ', l_orderkey, '</th></tr>', {rows}, '</table>') AS html FROM (
 SELECT l_orderkey, rn, concat('<tr>', CASE WHEN rn = 1 THEN concat('<td rowspan="', n, '">', l_orderkey, '</td>') ELSE '' END,
        '<td style="border:1px solid #0000ff">', l_partkey, '</td></tr>') AS y FROM ({NUMBERED_ITEMS}) q) q2
GROUP BY l_orderkey"""


def styles(engine: str) -> str:
    """doc_id, style_id, based_on, sz, align, ind_left, ind_right: chains of styles."""
    return """
SELECT p_partkey % 7 AS doc_id, concat('S', p_partkey) AS style_id,
 CASE WHEN p_partkey % 140 < 7 THEN NULL
      ELSE concat('S', p_partkey - 7 * (1 + p_partkey % 2 * CAST(p_partkey % 140 >= 14 AS INT))) END AS based_on,
 CASE WHEN p_size % 3 = 0 THEN p_size END AS sz, CASE WHEN p_size % 5 = 0 THEN 'center' END AS align,
 CASE WHEN p_size % 4 = 0 THEN p_size * 10 END AS ind_left, CASE WHEN p_size % 8 = 0 THEN p_size END AS ind_right
FROM {part}"""


def list_items(engine: str) -> str:
    """doc_id, blk, num_id, ilvl."""
    return f"""
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS blk,
       concat('n', l_suppkey % 2) AS num_id, l_partkey % 3 AS ilvl FROM {{lineitem}}"""


#: Documents of sixty orders with three tables each, so that more input means more tables and not larger ones.
CELL_KEYS = "CAST(floor(l_orderkey / 60.0) AS BIGINT) AS doc_id, l_orderkey % 3 AS tbl"


def cells(engine: str) -> str:
    """doc_id, tbl, r, c, span, vm, width, height: grids of merged cells, c counting cells of the row."""
    return f"""
SELECT doc_id, tbl, r, c, span, vm, width, height FROM (
 SELECT {CELL_KEYS},
  dense_rank() OVER (PARTITION BY CAST(floor(l_orderkey / 60.0) AS BIGINT), l_orderkey % 3 ORDER BY l_orderkey) - 1 AS r,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS c,
  1 + l_partkey % 2 AS span,
  CASE WHEN l_suppkey % 3 = 0 THEN 'restart' WHEN l_suppkey % 3 = 1 THEN 'continue' END AS vm,
  CAST(l_quantity AS INT) * 100 AS width, CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_quantity AS INT) * 10 END AS height
 FROM {{lineitem}}) q"""


TABLES = ("lineitem", "orders", "region", "nation", "part", "supplier", "customer", "documents", "conversations")


def built(spark: SparkSession, sf_dir: str, fixture) -> DataFrame:
    """The fixture (a function of the engine, or Spark SQL with {table} in it) over the tables of `sf_dir`."""
    sql = fixture if isinstance(fixture, str) else fixture("spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all cores, before packages or record streams are made of them: a small file of short rows is read by
    one task, whatever is made of each row."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def duck(fixture) -> str:
    """The fixture as a DuckDB subquery."""
    sql = fixture("duckdb")
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"
