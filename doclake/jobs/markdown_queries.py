"""Queries of the Markdown reader, held against SQL that knows the documents' structure and needs no parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.jobs.fixtures import ORDER, built, duck, md_docs, media_docs, page_docs
from doclake.operators import markdown as m

#: What a document of md_docs holds: `k` lines of items (1 if it has none), and where its groups begin.
KNOWN = f"""
WITH li AS (SELECT l_orderkey, l_partkey, l_returnflag, CAST(l_quantity AS INT) AS q,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS rn FROM lineitem),
full_ AS (SELECT o.*, li.*, count(rn) OVER (PARTITION BY o_orderkey) AS n FROM orders o LEFT JOIN li ON l_orderkey = o_orderkey),
k AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, greatest(max(n), 1) AS k, max(n) AS n FROM full_ GROUP BY ALL)
"""

lines = lambda s, d: m.classify_lines(m.explode_lines(m.split_front_matter(built(s, d, md_docs))))
blocks = lambda s, d: m.markdown_blocks(built(s, d, md_docs))
with_rows = lambda s, d: m.exploded(m.document_blocks(m.split_front_matter(built(s, d, md_docs))))


def md_block_counts(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def md_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id", "kind", "depth").agg(F.count("*").alias("n"), F.min("ln").alias("first_ln"))


def md_groups(spark, sf_dir):
    return m.group_lines(m.split_front_matter(built(spark, sf_dir, md_docs))).drop("grp")


def md_inline(spark, sf_dir):
    texts = blocks(spark, sf_dir).where("kind = 'paragraph' AND heading IS NULL AND list_level IS NULL AND font IS NULL")
    return m.inline_runs(texts, "doc_id", "blk")


def md_inline_documents(spark, sf_dir):
    docs = built(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    runs = m.inline_runs(docs, "doc_id")
    return runs.groupBy("doc_id").agg(F.count(F.when(F.col("bold"), 1)).alias("n_bold"), F.count(F.when(F.col("url").isNotNull(), 1)).alias("n_links"), F.sum(F.length("text")).alias("chars"))


def md_front(spark, sf_dir):
    return m.front_matter_entries(m.split_front_matter(built(spark, sf_dir, md_docs)))


def md_front_map(spark, sf_dir):
    meta = m.front_matter_map(m.split_front_matter(built(spark, sf_dir, md_docs)))
    return meta.select("doc_id", F.size("meta").alias("n"), F.col("meta")["title"].alias("title"), F.col("meta")["author"].alias("author"))


def md_page(spark, sf_dir):
    return m.front_matter_page(m.split_front_matter(built(spark, sf_dir, page_docs)))


def md_cells_padded(spark, sf_dir):
    return m.pipe_table_cells_padded(with_rows(spark, sf_dir)).withColumn("lines", F.array_join("lines", "/"))


def md_links(spark, sf_dir):
    return m.links(built(spark, sf_dir, media_docs))


def md_images(spark, sf_dir):
    return m.images(built(spark, sf_dir, media_docs))


def md_text(spark, sf_dir):
    return built(spark, sf_dir, media_docs).select("doc_id", m.md_to_text(F.col("md")).alias("text"))


def md_list_shape(spark, sf_dir):
    return m.list_shape(lines(spark, sf_dir)).groupBy("doc_id", "depth", "shape").agg(F.count("*").alias("n"))


RE_DUCK = m.INLINE.replace("'", "''")
QUERIES = {
    "md_block_counts": (md_block_counts, KNOWN + """
SELECT o_orderkey AS doc_id, 'paragraph' AS kind, 4 + k AS n FROM k
UNION ALL SELECT o_orderkey, 'table', 1 FROM k UNION ALL SELECT o_orderkey, 'pageBreak', 1 FROM k"""),
    "md_lines": (md_lines, f"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(md, '(?s)^---\\n.*?\\n---\\n', ''), chr(10)) AS l FROM {duck(md_docs)}),
r AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS ln FROM d),
c AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'blank' WHEN regexp_matches(raw, '^#{{1,6}}\\s+.*') THEN 'heading' WHEN starts_with(raw, '```') THEN 'fence'
  WHEN regexp_matches(raw, '^[-*_]{{3,}}\\s*$') THEN 'hrule' WHEN regexp_matches(raw, '^\\s*\\|[\\s|:-]+\\|') THEN 'table_sep'
  WHEN regexp_matches(raw, '^\\s*\\|.+\\|') THEN 'table_row' WHEN regexp_matches(raw, '^\\s*[-*+]\\s+.+') THEN 'bullet'
  WHEN regexp_matches(raw, '^\\s*\\d+[.)]\\s+.+') THEN 'ordered' ELSE 'text' END AS kind FROM r)
SELECT doc_id, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(raw, '^#+')) WHEN kind IN ('bullet', 'ordered') THEN length(regexp_extract(raw, '^\\s*')) // 2 END AS depth,
       count(*) AS n, min(ln) AS first_ln FROM c GROUP BY ALL"""),
    "md_groups": (md_groups, KNOWN + """
SELECT o_orderkey AS doc_id, 'heading' AS gkind, 0 AS first_ln, 0 AS last_ln FROM k
UNION ALL SELECT o_orderkey, 'text', 2, 3 FROM k UNION ALL SELECT o_orderkey, 'table', 5, 6 + k FROM k
UNION ALL SELECT o_orderkey, 'list', 7 + k, 6 + 2 * k FROM k UNION ALL SELECT o_orderkey, 'code', 8 + 2 * k, 9 + 3 * k FROM k
UNION ALL SELECT o_orderkey, 'hrule', 10 + 3 * k, 10 + 3 * k FROM k UNION ALL SELECT o_orderkey, 'text', 11 + 3 * k, 11 + 3 * k FROM k"""),
    "md_blocks": (blocks, KNOWN + """
SELECT o_orderkey AS doc_id, 0 AS blk, 'paragraph' AS kind, 1 AS heading, NULL::INT AS list_level, NULL::BOOLEAN AS list_ordered, NULL AS font, concat('Order ', o_orderkey) AS text FROM k
UNION ALL SELECT o_orderkey, 2, 'paragraph', NULL, NULL, NULL, NULL, concat('Status **', o_orderstatus, '** and *', o_orderpriority, '* see [order](http://x/', o_orderkey, ')', chr(10), 'second line') FROM k
UNION ALL SELECT o_orderkey, 5, 'table', NULL, NULL, NULL, NULL, NULL FROM k
UNION ALL SELECT o_orderkey, 6 + greatest(n, 1) + coalesce(rn, 1), 'paragraph', NULL, CASE WHEN rn IS NULL THEN 0 ELSE rn % 3 END, coalesce(l_returnflag = 'R', false), NULL, coalesce(concat('item ', l_partkey), 'none') FROM (
  SELECT o_orderkey, n, rn, l_returnflag, CASE WHEN rn IS NOT NULL THEN l_partkey END AS l_partkey FROM full_) q WHERE rn IS NOT NULL
UNION ALL SELECT o_orderkey, 8, 'paragraph', NULL, 0, false, NULL, 'none' FROM k WHERE n = 0
UNION ALL SELECT o_orderkey, 8 + 2 * greatest(max(n), 1), 'paragraph', NULL, NULL, NULL, 'Courier New', coalesce(string_agg(concat('# code ', q), chr(10) ORDER BY rn) FILTER (WHERE rn IS NOT NULL), '# none') FROM full_ GROUP BY o_orderkey
UNION ALL SELECT o_orderkey, 10 + 3 * k, 'pageBreak', NULL, NULL, NULL, NULL, NULL FROM k
UNION ALL SELECT o_orderkey, 11 + 3 * k, 'paragraph', NULL, NULL, NULL, NULL, concat('end ~~x~~ ', o_custkey) FROM k"""),
    "md_cells": (lambda s, d: m.pipe_table_cells(with_rows(s, d)), KNOWN + """
SELECT o_orderkey AS doc_id, 5 AS blk, 0 AS row, c AS col, t AS text FROM k, (VALUES (0, 'n'), (1, 'part'), (2, 'qty')) v(c, t)
UNION ALL SELECT o_orderkey, 5, rn, c, CASE c WHEN 0 THEN CAST(rn AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE concat('**', q, '**') END FROM full_, (VALUES (0), (1), (2)) v(c) WHERE rn IS NOT NULL
UNION ALL SELECT o_orderkey, 5, 1, c, '0' FROM k, (VALUES (0), (1), (2)) v(c) WHERE n = 0"""),
    "md_cells_padded": (md_cells_padded, KNOWN + """
SELECT o_orderkey AS doc_id, 5 AS blk, 0 AS row, c AS col, 13984 AS width, t AS lines FROM k, (VALUES (0, 'n'), (1, 'part'), (2, 'qty')) v(c, t)
UNION ALL SELECT o_orderkey, 5, rn, c, 13984, CASE c WHEN 0 THEN CAST(rn AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE concat('**', q, '**') END FROM full_, (VALUES (0), (1), (2)) v(c) WHERE rn IS NOT NULL
UNION ALL SELECT o_orderkey, 5, 1, c, 13984, '0' FROM k, (VALUES (0), (1), (2)) v(c) WHERE n = 0"""),
    "md_inline": (md_inline, KNOWN + """
SELECT o_orderkey AS doc_id, CASE WHEN p < 7 THEN 2 ELSE 11 + 3 * k END AS blk, p % 7 AS pos,
  CASE p WHEN 0 THEN 'Status ' WHEN 1 THEN o_orderstatus WHEN 2 THEN ' and ' WHEN 3 THEN o_orderpriority WHEN 4 THEN ' see ' WHEN 5 THEN 'order' WHEN 6 THEN concat(chr(10), 'second line')
         WHEN 7 THEN 'end ' WHEN 8 THEN 'x' ELSE concat(' ', o_custkey) END AS text,
  CASE WHEN p = 1 THEN true END AS bold, CASE WHEN p = 3 THEN true END AS italic, CASE WHEN p = 5 THEN true END AS underline, CASE WHEN p = 8 THEN true END AS strike,
  NULL::BOOLEAN AS sup, NULL::BOOLEAN AS sub, NULL::VARCHAR AS font, CASE WHEN p = 5 THEN '0563C1' END AS color, CASE WHEN p = 5 THEN concat('http://x/', o_orderkey) END AS url
FROM k, (SELECT unnest(generate_series(0, 9)) AS p) g"""),
    "md_inline_documents": (md_inline_documents, f"""
WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '{RE_DUCK}') AS marks FROM documents WHERE text <> ''),
u AS (SELECT doc_id, text, unnest(marks) AS t FROM r),
w AS (SELECT doc_id, t, CASE WHEN length(t) > 6 AND starts_with(t, '***') AND ends_with(t, '***') THEN 6 WHEN length(t) > 4 AND (starts_with(t, '**') AND ends_with(t, '**') OR starts_with(t, '~~')) THEN 4 WHEN starts_with(t, '*') OR starts_with(t, '`') THEN 2
  WHEN starts_with(t, '<u>') THEN 7 WHEN starts_with(t, '<s') THEN 11 ELSE length(t) - length(regexp_extract(t, '^\\[([^\\]]+)\\]', 1)) END AS lost FROM u),
a AS (SELECT doc_id, count(*) FILTER (WHERE length(t) > 4 AND starts_with(t, '**') AND ends_with(t, '**')) AS n_bold, count(*) FILTER (WHERE starts_with(t, '[')) AS n_links, sum(lost) AS lost FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_bold, 0) AS n_bold, coalesce(n_links, 0) AS n_links, CAST(length(text) - coalesce(lost, 0) AS BIGINT) AS chars FROM r LEFT JOIN a USING (doc_id)"""),
    "md_front": (md_front, """
SELECT o_orderkey AS doc_id, 'title' AS key, concat('Order ', o_orderkey) AS value FROM orders
UNION ALL SELECT o_orderkey, 'author', concat('Customer ', o_custkey) FROM orders"""),
    "md_front_map": (md_front_map, "SELECT o_orderkey AS doc_id, 2 AS n, concat('Order ', o_orderkey) AS title, concat('Customer ', o_custkey) AS author FROM orders"),
    "md_page": (md_page, """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 5 ELSE 59528 END AS "pageWidth", 84188 AS "pageHeight", 8504 AS "marginLeft", 8504 AS "marginRight",
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 100 * 5 ELSE 5668 END AS "marginTop", 4252 AS "marginBottom", 4252 AS "marginHeader", 4252 AS "marginFooter"
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0"""),
    "md_links": (md_links, """
SELECT p_partkey AS doc_id, 0 AS nth, p_type AS label, concat('http://x/', p_partkey) AS url FROM part
UNION ALL SELECT p_partkey, 1, 'b', 'u' FROM part"""),
    "md_images": (md_images, """
SELECT p_partkey AS doc_id, 0 AS nth, p_brand AS alt, concat('img/', p_size, CASE p_size % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.PNG' ELSE '.tiff' END) AS path FROM part
UNION ALL SELECT p_partkey, 1, 'd', 'data:image/gif;base64,R0lG' FROM part"""),
    "md_text": (md_text, """
SELECT p_partkey AS doc_id, concat('see ', p_type, ' (http://x/', p_partkey, ') and !', p_brand, ' (img/', p_size, CASE p_size % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.PNG' ELSE '.tiff' END, ')',
  chr(10), '☐ open !d (data:image/gif;base64,R0lG) ☑ done b (u)', chr(10), 'end') AS text FROM part"""),
    "md_list_shape": (md_list_shape, KNOWN + """
SELECT doc_id, depth, CASE WHEN ord AND depth = 0 THEN 25 ELSE 21 + depth END AS shape, count(*) AS n FROM (
  SELECT o_orderkey AS doc_id, CASE WHEN rn % 3 = 2 THEN 1 ELSE 0 END AS depth, l_returnflag = 'R' AS ord FROM full_ WHERE rn IS NOT NULL
  UNION ALL SELECT o_orderkey, 0, false FROM k WHERE n = 0) GROUP BY ALL"""),
}
