"""Queries over the driver's tables, one or more for every operator, with DuckDB SQL.

Some take tables as positioned items; the others write documents from table
rows, read these back and are held against SQL over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom import synth
from docloom.functions import cells as C
from docloom.functions import text as T
from docloom.operators import blocks, headings, images, layout, paragraphs, render, repetition, sheets, stats
from docloom.plans import docx as docx_plan
from docloom.plans import pdf as pdf_plan
from docloom.sources import batches, docx, files, pdf, xlsx
from docloom.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Spark SQL over the tables that ``text`` names."""
    return spark.sql(text, **{t: _t(spark, d, t) for t in TABLES if "{" + t + "}" in text})


# --- positioned items --------------------------------------------------------

#: Line items as text on pages: the same text for both engines, but for the table's name.
_ITEMS = """
select l_orderkey as doc_id, cast((seq - 1 - (seq - 1) % 3) / 3 as int) as page_idx, seq, height, font, x, y, text from (
  select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as int) as seq,
    cast(8 + l_quantity % 20 as int) as height, l_returnflag as font, cast(l_partkey % 500 as double) as x, cast((l_suppkey * 7) % 700 as double) as y,
    case when l_linestatus = 'O' then lower(concat('n', l_returnflag)) else l_linestatus end as text
  from {lineitem}) i
"""
_I = "WITH i AS (" + _ITEMS.replace("{lineitem}", "lineitem") + ")"
_MODES = _I + """, mh AS (
  SELECT doc_id, height AS mode_h FROM (SELECT doc_id, height, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, height) AS r FROM i WHERE height <> 0 GROUP BY doc_id, height) WHERE r = 1
), mf AS (
  SELECT doc_id, font AS mode_font FROM (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, font) AS r FROM i GROUP BY doc_id, font) WHERE r = 1
), mx AS (SELECT doc_id, max(height) AS max_h, arg_min(font, {'a': -height, 'b': page_idx, 'c': seq}) AS max_font FROM i GROUP BY doc_id)"""
_DISTANCE = _MODES + """, st AS (
  SELECT i.doc_id, trunc(lag(y) OVER w - y)::INT AS step, height = mode_h AS usual, lag(height = mode_h) OVER w AS before
  FROM i JOIN mh USING (doc_id) WINDOW w AS (PARTITION BY i.doc_id, page_idx ORDER BY seq)
), sc AS (SELECT doc_id, step, count(*) AS n FROM st WHERE usual AND before AND step > 0 GROUP BY ALL),
ds AS (SELECT d.doc_id, coalesce((SELECT step FROM sc WHERE sc.doc_id = d.doc_id ORDER BY n DESC, step LIMIT 1), 12) AS distance FROM (SELECT DISTINCT doc_id FROM i) d)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _ITEMS)


@query(_MODES + " SELECT * FROM mh")
def modal_height(spark, d):
    return stats.modal_height(_items(spark, d))


@query(_MODES + " SELECT * FROM mf")
def modal_font(spark, d):
    return stats.modal_font(_items(spark, d))


@query(_MODES + " SELECT * FROM mx")
def tallest_font(spark, d):
    return stats.tallest(_items(spark, d))


@query(_DISTANCE + " SELECT * FROM ds")
def line_distance(spark, d):
    return stats.line_distance(_items(spark, d))


_THRESHOLD = "greatest(floor(mode_h * 1.5)::INT, mode_h + 4)"


@query(_MODES + f", t AS (SELECT DISTINCT doc_id, height AS h FROM i JOIN mh USING (doc_id) WHERE height >= {_THRESHOLD}) SELECT * FROM (SELECT doc_id, h, (dense_rank() OVER (PARTITION BY doc_id ORDER BY h DESC) + 1)::INT AS level FROM t) WHERE level <= 6")
def heading_levels(spark, d):
    items = _items(spark, d)
    return headings.levels_by_height(items.join(stats.modal_height(items), "doc_id").withColumnRenamed("height", "h"))


_TITLE = _DISTANCE + f""", k AS (SELECT i.*, height AS h, mode_h, mode_font, max_h, distance FROM i JOIN mh USING (doc_id) JOIN mf USING (doc_id) JOIN mx USING (doc_id) JOIN ds USING (doc_id)),
p1 AS (
  SELECT *, CASE WHEN bool_or(h = max_h) OVER (PARTITION BY doc_id, page_idx) AND mode_h >= 8 AND h >= {_THRESHOLD} AND h > greatest(mode_h + floor((max_h - mode_h) / 4)::INT, {_THRESHOLD})
    THEN CASE WHEN h = max_h THEN 'H1' ELSE 'H2' END END AS t1 FROM k
)"""


@query(_TITLE + " SELECT doc_id, seq, t1 AS type FROM p1 WHERE t1 IS NOT NULL")
def title_page_headings(spark, d):
    items = _items(spark, d)
    known = items.join(stats.usual(items), "doc_id").withColumnRenamed("height", "h")
    return headings.title_lines(known).where("type is not null").select("doc_id", "seq", "type")


@query(_TITLE + f""", p2 AS (SELECT *, CASE WHEN t1 IS NULL AND h >= {_THRESHOLD} THEN h END AS rh FROM p1),
p3 AS (SELECT *, CASE WHEN rh IS NOT NULL THEN dense_rank() OVER (PARTITION BY doc_id ORDER BY rh DESC NULLS LAST) + 1 END AS lv FROM p2),
p4 AS (SELECT *, coalesce(t1, CASE WHEN lv <= 6 THEN 'H' || lv END) AS t2 FROM p3),
p5 AS (SELECT *, lag(y) OVER w AS py, lag(t2) OVER w AS pt, greatest(1, coalesce(max(substr(t2, 2, 1)::INT) OVER (PARTITION BY doc_id), 1)) AS deepest FROM p4 WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY seq))
SELECT doc_id, seq, CASE WHEN t2 IS NULL AND h = mode_h AND font <> mode_font AND text = upper(text) AND text <> '' AND (py IS NULL OR py < y OR pt IS NOT NULL OR py - y > 2 * distance) AND deepest < 6
  THEN 'H' || (deepest + 1) ELSE t2 END AS type FROM p5""")
def heading_types(spark, d):
    items = _items(spark, d)
    known = stats.usual(items)
    known = known.join(stats.line_distance(items, known.select("doc_id", "mode_h")), "doc_id")
    return headings.detect(items.withColumnRenamed("height", "h").withColumn("line_no", F.col("seq")), known).select("doc_id", "seq", "type")


@query(_I + " SELECT doc_id, seq, CASE WHEN y BETWEEN 0 - 10 AND 100 + 10 THEN 0 WHEN y BETWEEN 90 - 10 AND 200 + 10 THEN 1 WHEN y BETWEEN 400 - 10 AND 450 + 10 THEN 2 END::INT AS region FROM i")
def region_membership(spark, d):
    return layout.regions_at(_items(spark, d), [(0, 100), (90, 200), (400, 450)]).select("doc_id", "seq", "region")


@query(_I + " SELECT doc_id, seq, CASE WHEN x >= 285 THEN 3 WHEN x >= 135 THEN 2 WHEN x >= 57 THEN 1 ELSE 0 END::INT AS col FROM i")
def column_assignment(spark, d):
    return layout.columns_at(_items(spark, d), [0.0, 72.0, 150.0, 300.0]).select("doc_id", "seq", "col")


@query("WITH RECURSIVE i AS (" + _ITEMS.replace("{lineitem}", "lineitem") + """), o AS (SELECT doc_id, seq, y, row_number() OVER (PARTITION BY doc_id ORDER BY y, seq) AS n FROM i),
g AS (
  SELECT doc_id, seq, n, y AS anchor, 0 AS line_no FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.seq, o.n, CASE WHEN abs(g.anchor - o.y) >= 30 THEN o.y ELSE g.anchor END, g.line_no + CASE WHEN abs(g.anchor - o.y) >= 30 THEN 1 ELSE 0 END
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1
) SELECT doc_id, seq, line_no::INT AS line_no FROM g""")
def greedy_lines(spark, d):
    return layout.line_numbers(_items(spark, d), 60)


@query("WITH RECURSIVE i AS (" + _ITEMS.replace("{lineitem}", "lineitem") + """), o AS (
  SELECT doc_id, seq, y, CASE WHEN x >= 285 THEN 2 WHEN x >= 135 THEN 1 ELSE 0 END AS col, row_number() OVER (PARTITION BY doc_id ORDER BY y, seq) AS n FROM i
), g AS (
  SELECT doc_id, seq, n, 0::BIGINT AS row_no, [{'lo': y, 'hi': y, 'cols': [col]}] AS rows FROM o WHERE n = 1
  UNION ALL SELECT doc_id, seq, n, coalesce(k, len(rows) + 1) - 1, CASE WHEN k IS NULL THEN list_append(rows, {'lo': y, 'hi': y, 'cols': [col]})
    ELSE list_transform(rows, lambda r, i: CASE WHEN i = k THEN {'lo': least(r.lo, y), 'hi': greatest(r.hi, y), 'cols': list_append(r.cols, col)} ELSE r END) END
  FROM (
    SELECT o.*, g.rows, list_filter(range(1, len(g.rows) + 1), lambda i: g.rows[i].lo - 36 <= o.y AND o.y <= g.rows[i].hi + 36 AND (list_contains(g.rows[i].cols, o.col) OR g.rows[i].hi - g.rows[i].lo < 43.2))[1] AS k
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1
  )
) SELECT doc_id, seq, row_no::INT AS row_no FROM g""")
def table_rows(spark, d):
    return layout.table_rows(_items(spark, d), [0.0, 150.0, 300.0], 12)


_SIDES = "select l_suppkey as doc_id, cast((l_partkey % 2) * 300 + l_partkey % 97 as double) as x, cast(l_orderkey * 10 + l_linenumber as double) as y, case when l_returnflag = 'N' then concat('n', l_linestatus) else l_linestatus end as text from {lineitem}"


@query("WITH i AS (" + _SIDES.replace("{lineitem}", "lineitem") + """), e AS (SELECT doc_id, count(*) AS n, min(x) AS lo, max(x) AS hi FROM i GROUP BY doc_id),
s AS (SELECT i.*, x >= lo + (hi - lo) / 2 AS r, n, lo, hi FROM i JOIN e USING (doc_id)),
c AS (SELECT doc_id, any_value(n) AS n, any_value(hi - lo) AS w, count(*) FILTER (NOT r) AS ln, count(*) FILTER (r) AS rn, count(*) FILTER (r AND regexp_matches(text, '^[a-z.,;:–-]')) AS f FROM s GROUP BY doc_id),
k AS (SELECT doc_id, avg(CASE WHEN b THEN 1 ELSE 0 END) AS sp FROM (SELECT doc_id, trunc(y * 10)::INT AS k, bool_or(r) AND NOT bool_and(r) AS b FROM s GROUP BY 1, 2) GROUP BY doc_id)
SELECT doc_id, n >= 10 AND w >= 200 AND ln >= 5 AND rn >= 5 AND sp <= 0.3 AND f / rn >= 0.3 AS two_columns FROM c JOIN k USING (doc_id)""")
def two_column_pages(spark, d):
    return layout.pages_of_two_columns(_sql(spark, d, _SIDES).withColumn("seq", F.monotonically_increasing_id()))


# --- repeated lines and blank pages ------------------------------------------

def _turn_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_idx"), F.posexplode(F.split(F.regexp_replace("text", r"[.!?] ", "\n"), "\n")).alias("line_no", "text"))
    return rows.withColumn("y", F.col("line_no").cast("double"))


_TURNS = "WITH l AS (SELECT conv_id AS doc_id, turn::INT AS page_idx, unnest(range(len(s)))::INT AS line_no, unnest(s) AS text FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '[.!?] ', chr(10), 'g'), chr(10)) AS s FROM conversations))"


_HEADED = """
select c_nationkey as doc_id, page_idx, y, case when y = 0 then concat('Report of ', c_nationkey) when y = 9 then concat('- ', page_idx + 1, ' -') else c_name end as text from (
  select c_nationkey, c_name, cast((n - n % 3) / 3 as int) as page_idx, explode(array(0, 1 + cast(n % 3 as int), 9)) as y from (
    select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) - 1 as n from {customer}))
"""


@query("""WITH c AS (SELECT c_nationkey AS doc_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 3 AS page_idx FROM customer),
g AS (SELECT doc_id, count(DISTINCT page_idx) AS pages FROM c GROUP BY doc_id)
SELECT DISTINCT doc_id, page_idx::INT AS page_idx, unnest([0, 9])::DOUBLE AS y FROM c JOIN g USING (doc_id) WHERE pages >= 3""")
def header_footer_repeats(spark, d):
    lines = _sql(spark, d, _HEADED).distinct().select("doc_id", "page_idx", F.col("y").cast("double").alias("y"), F.col("y").alias("line_no"), "text")
    return repetition.repeated(lines, lines.groupBy("doc_id").agg(F.countDistinct("page_idx").alias("pages")))


@query(_TURNS + " SELECT doc_id, page_idx FROM l GROUP BY ALL HAVING count(*) < 2")
def blank_pages(spark, d):
    lines = _turn_lines(spark, d)
    return repetition.blank_pages(lines, lines.select("doc_id", "page_idx").distinct().withColumn("is_scanned", F.lit(False)))


@query(_TURNS + " SELECT doc_id, page_idx, line_no FROM l WHERE NOT (regexp_matches(lower(text), '^[-– ]*(page|seite|página)?\\s*[0-9]{1,5}(\\s*(/|of|von|de)\\s*[0-9]{1,5})?[-– ]*$') AND (line_no = 0 OR line_no = (SELECT max(line_no) FROM l m WHERE m.doc_id = l.doc_id AND m.page_idx = l.page_idx)))")
def page_number_lines(spark, d):
    return repetition.without_page_numbers(_turn_lines(spark, d)).select("doc_id", "page_idx", "line_no")


@query("SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(range(1, strlen(n_name) + 1), lambda i: NOT regexp_matches(n_name[i], '[0-9 ]')), lambda i: ord(n_name[i])::BIGINT)), lambda a, c: (a * 31 + c) % 2147483648) AS hash FROM nation")
def line_hash(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", T.line_hash(F.col("n_name")).alias("hash"))


# --- text --------------------------------------------------------------------

_LISTED = "select p_partkey, case when p_size % 5 = 0 then concat(cast(p_size as string), '. ', p_name) when p_size % 5 = 1 then concat('iv) ', p_name) when p_size % 5 = 2 then concat(' - ', p_name) when p_size % 5 = 3 then concat('B. ', p_name) else p_name end as line from {part}"
_L = "WITH p AS (" + _LISTED.replace("{part}", "part").replace(" as string", " as varchar") + ")"


@query(_L + r" SELECT p_partkey, regexp_matches(line, '^([0-9]+[.)]\s|[a-z][.)]\s|[A-Z][.)]\s|(x{0,3}(ix|iv|v?i{0,3}))[.)]\s|(X{0,3}(IX|IV|V?I{0,3}))[.)]\s)') AS is_item FROM p")
def ordered_list_lines(spark, d):
    return _sql(spark, d, _LISTED).select("p_partkey", T.is_ordered_item(F.col("line")).alias("is_item"))


@query(_L + r" SELECT p_partkey, regexp_matches(line, '^\s*[-•–]\s') AS is_bullet FROM p")
def bullet_lines(spark, d):
    return _sql(spark, d, _LISTED).select("p_partkey", T.is_bullet_line(F.col("line")).alias("is_bullet"))


@query("SELECT p_partkey, greatest(0, least(6, floor((p_size * 5 - 40) / 20)))::INT AS level FROM part")
def list_levels(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.list_level(F.col("p_size") * 5, F.lit(40)).alias("level"))


@query("SELECT page_id, CASE WHEN w LIKE 'www.%' THEN 'http://' || w ELSE w END AS s, CASE WHEN regexp_matches(w, '^(https?:|www\\.)') THEN 'LINK' END AS type FROM (SELECT page_id, regexp_replace(url, '^https://', 'www.') AS w FROM pages)")
def link_words(spark, d):
    word = F.get(layout.words(F.regexp_replace("url", "^https://", "www.")), F.lit(0))
    return _t(spark, d, "pages").select("page_id", word.alias("w")).select("page_id", "w.s", "w.type")


@query(r"SELECT p_partkey, p_size, CASE WHEN regexp_extract(w, '^(.+)\(([0-9]{1,2})\)$', 2) <> '' THEN regexp_extract(w, '^(.+)\(([0-9]{1,2})\)$', 1) || '[^' || p_size || ']' ELSE w END AS marked FROM (SELECT p_partkey, p_size, replace(p_name, ' ', '_') || '(' || p_size || ')' AS w FROM part)")
def footnote_marks(spark, d):
    word = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    return _t(spark, d, "part").select("p_partkey", "p_size", F.get(layout.words(word), F.lit(0))["s"].alias("marked"))


@query("SELECT p_partkey, strlen(t) >= 100 AND len(string_split(trim(t), ' ')) >= 6 AS repeats FROM (SELECT p_partkey, repeat(p_brand || ' ', p_size) AS t FROM (SELECT p_partkey, replace(p_brand, ' ', '') AS p_brand, p_size FROM part))")
def repetitive_text(spark, d):
    text = F.expr("repeat(concat(replace(p_brand, ' ', ''), ' '), p_size)")
    return _t(spark, d, "part").select("p_partkey", layout.repetitive(text).alias("repeats"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '. ', '.' || repeat(chr(10), 4)), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS markdown FROM documents")
def compact_markdown(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.compact(F.replace("text", F.lit(". "), F.lit(".\n\n\n\n"))).alias("markdown"))


@query("SELECT doc_id, replace(replace(text, 'ing ', 'ing- '), '- ', '') AS text FROM documents")
def dehyphenate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.join_hyphens(F.replace("text", F.lit("ing "), F.lit("ing- "))).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\r\n|\n|\r', ' ', 'g') AS text FROM documents")
def flatten_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("text"))


@query("SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|'))) >= 2 AS is_table FROM (SELECT doc_id, '| ' || replace(text, ', ', ' |' || chr(10) || '| ') AS t FROM documents)")
def table_content(spark, d):
    text = F.concat(F.lit("| "), F.replace("text", F.lit(", "), F.lit(" |\n| ")))
    return _t(spark, d, "documents").select("doc_id", T.is_table(text).alias("is_table"))


@query("""WITH b AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block_no, c_mktsegment AS seg, c_custkey FROM customer)
SELECT doc_id, block_no::INT AS block_no, CASE WHEN row_number() OVER (PARTITION BY doc_id, seg ORDER BY block_no) = 1 THEN '| Key | ' || seg || ' |' || chr(10) || '| --- | --- |' || chr(10) ELSE '' END || '| ' || c_custkey || ' | x |' || chr(10) || '| y | z |' || chr(10) AS text FROM b""")
def header_dedup(spark, d):
    rows = _sql(spark, d, "select c_nationkey as doc_id, 0 as page_idx, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as block_no, concat('| Key | ', c_mktsegment, ' |\\n| --- | --- |\\n| ', cast(c_custkey as string), ' | x |\\n| y | z |\\n') as text from {customer}")
    return render.without_repeated_headers(rows, ["doc_id", "page_idx"]).select("doc_id", "block_no", "text")


@query("SELECT p_partkey, '| a | b |' || chr(10) || CASE WHEN p_size > 25 THEN '' ELSE chr(10) END || CASE WHEN p_size > 25 THEN '| ' || p_name || ' |' ELSE p_name END AS text FROM part")
def table_merge(spark, d):
    text = F.concat(F.lit("| a | b |\n\n"), F.when(F.col("p_size") > 25, F.concat(F.lit("\n| "), "p_name", F.lit(" |"))).otherwise(F.col("p_name")))
    return _t(spark, d, "part").select("p_partkey", render.joined_tables(text).alias("text"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey AS doc_id, string_agg('**' || n_name || '** and', chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM n GROUP BY n_regionkey""")
def render_words(spark, d):
    word = lambda s, style: F.struct(s.alias("s"), F.lit(None).cast("string").alias("type"), F.lit(style).cast("string").alias("format"))
    rows = _t(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("block_no"), F.col("n_nationkey").alias("n"), F.lit(None).cast("string").alias("block_type"), F.lit(None).cast("string").alias("type"), F.lit(0).alias("list_level"), F.lit(False).alias("is_table_row"), F.lit(False).alias("is_table_header"), F.lit(None).cast("array<string>").alias("table_columns"), F.array(word(F.col("n_name"), "BOLD"), word(F.lit("and"), None)).alias("words"))
    return render.blocks(rows, ["doc_id"], "n").select("doc_id", "text")


@query("SELECT p_partkey, repeat('#', least(6, greatest(1, p_size))) || ' ' || p_name || chr(10) AS text FROM part")
def block_text(spark, d):
    kind = T.heading_kind(F.col("p_size"))
    none, style = F.lit(None).cast("string"), F.lit("BOLD").alias("format")
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("s"), none.alias("type"), style))
    rows = _t(spark, d, "part").select("p_partkey", F.lit(1).alias("block_no"), F.lit(1).alias("n"), kind.alias("block_type"), none.alias("type"), F.lit(0).alias("list_level"), F.lit(False).alias("is_table_row"), F.lit(False).alias("is_table_header"), F.lit(None).cast("array<string>").alias("table_columns"), words.alias("words"))
    return render.blocks(rows, ["p_partkey"], "n").select("p_partkey", "text")


@query("""WITH k AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)::INT AS seq,
  CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'list' ELSE 'one' END AS kind FROM lineitem),
f AS (SELECT *, kind = 'one' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL OR lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) <> kind AS new FROM k)
SELECT doc_id, seq, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS block_no FROM f""")
def block_islands(spark, d):
    rows = _sql(spark, d, "select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as int) as seq, l_returnflag = 'A' as is_table_row, 1 as table_no, case when l_returnflag = 'N' then 'LIST' end as type from {lineitem}")
    return blocks.number_docx_blocks(rows).select("doc_id", "seq", "block_no")


# --- spreadsheet functions ---------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_partkey::BIGINT AS p_partkey, p_partkey::BIGINT AS v, '' AS s FROM part UNION ALL SELECT p_partkey, (v - 1) // 26, chr((65 + (v - 1) % 26)::INT) || s FROM n WHERE v > 0)
SELECT p_partkey, s AS letters, p_partkey AS number FROM n WHERE v = 0""")
def column_letters(spark, d):
    letters = C.column_letters(F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", letters.alias("letters"), C.column_number(letters).alias("number"))


@query("SELECT p_partkey, 'C' || p_size AS ref, p_size::BIGINT AS row_no, CASE WHEN p_size = 1 THEN 'C1' ELSE 'C1:C' || p_size END AS span FROM part")
def cell_refs(spark, d):
    ref = F.concat(F.lit("C"), F.col("p_size").cast("string"))
    return _t(spark, d, "part").select("p_partkey", ref.alias("ref"), C.cell_row(ref).alias("row_no"), C.range_name(F.lit(1), F.lit(3), F.col("p_size"), F.lit(3)).alias("span"))


@query("""WITH n AS (SELECT p_partkey, p_size AS v FROM part)
SELECT p_partkey, repeat('l', v // 50) || (['', 'x', 'xx', 'xxx', 'xl'])[v % 50 // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[v % 10 + 1] AS numeral FROM n""")
def roman_numerals(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.roman(F.col("p_size")).alias("numeral"))


@query("SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS shown FROM orders")
def excel_dates(spark, d):
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    return _t(spark, d, "orders").select("o_orderkey", C.formatted(serial.cast("string"), F.lit(14), F.lit("")).alias("shown"))


@query("SELECT s_suppkey, s_nationkey AS doc_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS ord FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY (100 + s_suppkey % 7) DESC, s_suppkey) = 1")
def largest_image(spark, d):
    rows = _sql(spark, d, "select s_nationkey as doc_id, 0 as page_idx, s_suppkey, cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) as ord, cast(100 + s_suppkey % 7 as int) as width, 1 as height from {supplier}")
    return images.largest(rows).select("s_suppkey", "doc_id", "ord")


@query("SELECT path, 'out/' || name || '.pdf' || CASE WHEN n = 0 THEN '' ELSE '-' || n END || '.md' AS output_path FROM (SELECT c_custkey || '/' || c_mktsegment || '.pdf' AS path, c_mktsegment AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey || '/' || c_mktsegment || '.pdf') - 1 AS n FROM customer)")
def output_names(spark, d):
    from docloom.options import Options

    rows = _t(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit(".pdf")).alias("doc_id"))
    return files.targets(rows, spark.createDataFrame([], "path string"), Options(output_directory="out")).select(F.col("doc_id").alias("path"), "output_path")


# --- round trips: workbooks --------------------------------------------------

_FILES = pa.schema({"doc_id": pa.string(), "content": pa.binary()})


def _made(rows: DataFrame, by: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(doc_id, content): one document of each group of rows, written by the workers."""

    def run(pdf_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [str(pdf_[by].iloc[0])], "content": [make(pdf_)]})

    return rows.groupBy(by).applyInPandas(run, "doc_id string, content binary")


def _each(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """(doc_id, content): one document of every row (doc_id, …)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ({"doc_id": str(r["doc_id"]), "content": make(r)} for part in parts for at in range(0, part.num_rows, 100) for r in part.slice(at, 100).to_pylist())
        for found in batches.cut((0, len(r["content"]), r) for r in made):
            yield pa.RecordBatch.from_pylist(found, _FILES)

    return rows.mapInArrow(run, "doc_id string, content binary")


def _nation_book(g: pd.DataFrame) -> bytes:
    g = g.sort_values("n_nationkey")
    cells = [(1, 1, "key"), (1, 2, "nation")]
    for r, (k, n) in enumerate(zip(g["n_nationkey"], g["n_name"]), 2):
        cells += [(r, 1, int(k)), (r, 2, n)]
    return synth.xlsx([{"name": g["r_name"].iloc[0], "cells": cells}])


def _nation_books(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return stored(xlsx.decode(_made(rows, "r_name", _nation_book)), "nation-books")


_NATIONS = "WITH n AS (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) + 1 AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(_NATIONS + """, c AS (SELECT r_name AS doc_id, r AS row, 'A' AS col, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT r_name, r, 'B', n_name FROM n
  UNION ALL SELECT DISTINCT r_name, 1, 'A', 'key' FROM n UNION ALL SELECT DISTINCT r_name, 1, 'B', 'nation' FROM n) SELECT doc_id, row::INT AS row, col, value FROM c""")
def xlsx_nation_cells(spark, d):
    return sheets.cells(_nation_books(spark, d)).select("doc_id", "row", C.column_letters(F.col("col")).alias("col"), "value")


@query(_NATIONS + " SELECT r_name AS doc_id, max(r)::INT AS max_row, 1 AS min_col, 2 AS max_col FROM n GROUP BY r_name")
def xlsx_sheet_bounds(spark, d):
    return sheets.bounds(sheets.cells(_nation_books(spark, d))).select("doc_id", "max_row", "min_col", "max_col")


@query(_NATIONS + """ SELECT r_name AS doc_id, '## ' || r_name || chr(10) || chr(10) || '### Range: ' || r_name || '!A1:B' || max(r) || chr(10) || '| Row | A | B |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | key | nation |' || chr(10)
  || string_agg('| ' || r || ' | ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY r) AS markdown FROM n GROUP BY r_name""")
def xlsx_markdown(spark, d):
    return sheets.markdown(_nation_books(spark, d))


def _supplier_book(g: pd.DataFrame) -> bytes:
    cells = [(int(k) + 1, 1 + int(n) % 3, float(b)) for k, n, b in zip(g["s_suppkey"], g["n"], g["s_acctbal"]) if b >= 0]
    gone = [int(k) + 1 for k, b in zip(g["s_suppkey"], g["s_acctbal"]) if b >= 5000]
    last = int(g["s_suppkey"].max()) + 1
    return synth.xlsx([{"name": "S", "cells": cells, "hidden_rows": gone, "tables": [("T", f"A{last + 2}:B{last + 3}")]}])


def _supplier_books(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, "select s_nationkey, cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) as n, s_suppkey, s_acctbal from {supplier}")
    return stored(xlsx.decode(_made(rows, "s_nationkey", _supplier_book)), "supplier-books")


_SUPPLIERS = "WITH a AS (SELECT s_nationkey::VARCHAR AS doc_id, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier), s AS (SELECT doc_id, s_suppkey + 1 AS r, 1 + n % 3 AS c FROM a WHERE s_acctbal >= 0), i AS (SELECT doc_id, r, c, r - row_number() OVER (PARTITION BY doc_id ORDER BY r) AS k FROM s)"


@query(_SUPPLIERS + " SELECT doc_id, 'range' AS kind, '' AS name, min(r)::INT AS r0, min(c)::INT AS c0, max(r)::INT AS r1, max(c)::INT AS c1 FROM i GROUP BY doc_id, k UNION ALL SELECT doc_id, 'table', 'T', max(s_suppkey)::INT + 3, 1, max(s_suppkey)::INT + 4, 2 FROM a GROUP BY doc_id")
def xlsx_range_blocks(spark, d):
    return sheets.blocks(sheets.grid(_supplier_books(spark, d))).select("doc_id", "kind", "name", "r0", "c0", "r1", "c1")


@query(_SUPPLIERS + """, v AS (SELECT a.doc_id, s_suppkey + 1 AS r, 1 + n % 3 AS c, s_acctbal FROM a WHERE s_acctbal >= 0), b AS (
  SELECT doc_id, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1 FROM i GROUP BY doc_id, k
), t AS (
  SELECT b.doc_id, b.r0, b.c0, '### Range: S!' || chr((64 + c0)::INT) || r0 || CASE WHEN r0 = r1 AND c0 = c1 THEN '' ELSE ':' || chr((64 + c1)::INT) || r1 END || chr(10) || coalesce('| Row | ' || array_to_string(list_transform(range(c0, c1 + 1), lambda x: chr((64 + x)::INT)), ' | ') || ' |' || chr(10)
    || '| --- |' || repeat(' --- |', (c1 - c0 + 1)::INT) || chr(10), '') AS head, b.c1
  FROM b
), l AS (
  SELECT v.doc_id, b.r0, string_agg('| ' || v.r || ' |' || repeat('  |', (v.c - b.c0)::INT) || ' ' || CASE WHEN s_acctbal = trunc(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END || ' |' || repeat('  |', (b.c1 - v.c)::INT) || chr(10), '' ORDER BY v.r) AS body
  FROM v JOIN b ON b.doc_id = v.doc_id AND v.r BETWEEN b.r0 AND b.r1 WHERE s_acctbal < 5000 GROUP BY v.doc_id, b.r0
), k AS (
  SELECT t.doc_id, t.r0, CASE WHEN body IS NULL THEN split_part(head, chr(10), 1) || chr(10) ELSE head || body END AS text FROM t LEFT JOIN l ON l.doc_id = t.doc_id AND l.r0 = t.r0
  UNION ALL SELECT doc_id, max(s_suppkey) + 3, '### Table: S!A' || max(s_suppkey) + 3 || ':B' || max(s_suppkey) + 4 || ' (T)' || chr(10) FROM a GROUP BY doc_id
) SELECT doc_id, '## S' || chr(10) || chr(10) || CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN string_agg(text, chr(10) ORDER BY r0) ELSE '' END AS markdown FROM k GROUP BY doc_id""")
def xlsx_hidden_filter(spark, d):
    from docloom.options import SheetOptions

    return sheets.markdown(_supplier_books(spark, d), SheetOptions(hidden=False))


def _line_book(g: pd.DataFrame) -> bytes:
    cells = []
    for r, (p, q, s, day) in enumerate(zip(g["l_extendedprice"], g["l_quantity"], g["l_discount"], g["serial"]), 1):
        cells += [(r, 1, float(p), {"style": 1}), (r, 2, float(q), {"style": 2}), (r, 3, float(s), {"style": 3}), (r, 4, int(day), {"style": 4})]
    return synth.xlsx([{"name": "L", "cells": cells}], [(164, "$#,##0.00"), (0, ""), (10, ""), (14, "")])


_SUPPLIED = "select l_suppkey, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as int) as r, l_extendedprice, l_quantity, l_discount, datediff(cast(l_shipdate as date), date'1899-12-30') as serial from {lineitem}"


@query("""WITH l AS (SELECT l_suppkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)::INT AS row, * FROM lineitem)
SELECT doc_id, row, 1 AS col, '$' || printf('%.2f', l_extendedprice) AS value FROM l UNION ALL SELECT doc_id, row, 2, l_quantity::BIGINT::VARCHAR FROM l
UNION ALL SELECT doc_id, row, 3, printf('%.0f', l_discount * 100) || '%' FROM l UNION ALL SELECT doc_id, row, 4, strftime(l_shipdate::DATE, '%Y-%m-%d') FROM l""")
def xlsx_number_formats(spark, d):
    books = _made(_sql(spark, d, _SUPPLIED), "l_suppkey", lambda g: _line_book(g.sort_values("r")))
    return sheets.cells(xlsx.decode(books)).select("doc_id", "row", "col", "value")


def _merge_book(g: pd.DataFrame) -> bytes:
    g = g.sort_values("n_nationkey")
    return synth.xlsx([{"name": "M", "cells": [(1, 1, g["r_name"].iloc[0])] + [(r, 2, n) for r, n in enumerate(g["n_name"], 1)], "merges": [f"A1:A{len(g)}"]}])


@query(_NATIONS + """, k AS (SELECT r_name, r - 1 AS r, n_name FROM n) SELECT r_name AS doc_id, r::INT AS row, 1 AS col, CASE WHEN r = 1 THEN r_name ELSE '[merged]' END AS shown FROM k
UNION ALL SELECT r_name, r::INT, 2, n_name FROM k""")
def xlsx_merged_cells(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    books = stored(xlsx.decode(_made(rows, "r_name", _merge_book)), "merge-books")
    return sheets.shown(sheets.grid(books)).select("doc_id", "row", "col", "shown")


# --- round trips: text documents ---------------------------------------------


@query(r"""WITH l AS (SELECT doc_id::VARCHAR AS doc_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS k, regexp_replace(line, ' +', ' ', 'g') AS text FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""")
def docx_paragraphs(spark, d):
    made = _each(_t(spark, d, "documents").select("doc_id", "text"), lambda r: synth.docx("".join(synth.para(synth.run(x)) for x in (r["text"] or "").split("\n"))))
    lines = paragraphs.lines(docx.decode(made))
    text = F.array_join(F.transform("words", lambda w: w["s"]), " ")
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("k"), text.alias("text"))


@query("SELECT n_regionkey::VARCHAR AS doc_id, n_name AS text, CASE WHEN substr(n_nationkey::VARCHAR, 1, 1) BETWEEN '1' AND '6' THEN 'H' || substr(n_nationkey::VARCHAR, 1, 1) END AS type FROM nation")
def docx_headings(spark, d):
    def make(g: pd.DataFrame) -> bytes:
        g = g.sort_values("n_nationkey")
        body = "".join(synth.para(synth.run(n), style=f"S{k}") for k, n in zip(g["n_nationkey"], g["n_name"]))
        return synth.docx(body, [(f"S{k}", f"heading {k}", None) for k in g["n_nationkey"]])

    lines = paragraphs.lines(docx.decode(_made(_t(spark, d, "nation"), "n_regionkey", make)))
    return lines.select("doc_id", F.get("words", F.lit(0))["s"].alias("text"), "type")


@query("""WITH l AS (SELECT l_orderkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS seq, l_returnflag AS f FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY seq) AS n FROM l)
SELECT doc_id, seq::INT AS seq, CASE f WHEN 'A' THEN n || '. ' WHEN 'N' THEN chr((96 + n)::INT) || '. ' ELSE (['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx'])[n] || '. ' END || f AS text FROM n""")
def docx_list_numbers(spark, d):
    rows = _sql(spark, d, "select l_orderkey, l_returnflag, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as int) as r from {lineitem}")
    level = {"A": 0, "N": 1, "R": 2}

    def make(r: dict) -> bytes:
        return synth.docx("".join(synth.para(synth.run(x["f"]), num=(1, level[x["f"]])) for x in r["flags"]), numbering=[(1, ["decimal", "lowerLetter", "lowerRoman"])])

    # orders are small and very many: a row each, so that none costs a call of its own
    orders = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("r", F.col("l_returnflag").alias("f")))).alias("flags"))
    lines = paragraphs.lines(docx.decode(_each(orders, make)))
    return lines.select("doc_id", (F.col("seq") + 1).alias("seq"), F.get("words", F.lit(0))["s"].alias("text"))


@query(_NATIONS + " SELECT r_name AS doc_id, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY r) || chr(10) || chr(10) AS markdown FROM n GROUP BY r_name")
def docx_tables(spark, d):
    def make(g: pd.DataFrame) -> bytes:
        g = g.sort_values("n_nationkey")
        return synth.docx(synth.grid([["key", "nation"], *([str(k), n] for k, n in zip(g["n_nationkey"], g["n_name"]))]))

    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return docx_plan.markdown(docx.decode(_made(rows, "r_name", make)))


@query("SELECT page_id::VARCHAR AS doc_id, '[page](' || url || ')' AS link, 'note ' || url AS note FROM pages")
def docx_links_notes(spark, d):
    made = _each(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), lambda r: synth.docx(synth.para(synth.link("rId1", "page"), synth.note_ref(7)), links={"rId1": r["url"]}, footnotes={7: f"note {r['url']}"}))
    docs = stored(docx.decode(made), "linked")
    links = paragraphs.lines(docs).select("doc_id", F.get("words", F.lit(0))["s"].alias("link"))
    return links.join(paragraphs.notes(docs).select("doc_id", F.col("text").alias("note")), "doc_id")


@query("SELECT item_id::VARCHAR AS doc_id, CASE item_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'gif' END AS format, 'image_001' AS image_id FROM benchmark")
def docx_images(spark, d):
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0\0\0\0\0", b"GIF89a\0\0"]
    made = _each(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), lambda r: synth.docx(synth.para(synth.drawing("rId1", "x")), images={"rId1": heads[r["doc_id"] % 3]}))
    return paragraphs.images(docx.decode(made)).select("doc_id", images.sniff(F.col("data")).alias("format"), "image_id")


@query(r"SELECT item_id::VARCHAR AS doc_id, regexp_replace(text, ' +', ' ', 'g') AS text FROM benchmark WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def docx_runs_merge(spark, d):
    def make(r: dict) -> bytes:
        words = (r["text"] or "").split(" ")
        return synth.docx(synth.para(*(synth.run(w + (" " if i + 1 < len(words) else "")) for i, w in enumerate(words))))

    made = _each(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), make)
    return paragraphs.lines(docx.decode(made)).select("doc_id", F.array_join(F.transform("words", lambda w: w["s"]), " ").alias("text"))


# --- round trips: PDF --------------------------------------------------------


def _print(r: dict) -> bytes:
    lines = (r["text"] or "").split("\n")
    pages = [lines[i : i + 40] for i in range(0, len(lines), 40)]
    return synth.pdf([[(72, 60 + 14 * k, x, 12, "F1") for k, x in enumerate(p) if x.strip()] for p in pages], {0: (600, 700, b"\0" * 30)} if r["doc_id"] % 2 == 0 else {}, unicode=True)


def _prints(spark: SparkSession, d: str, images: bool = True, text: bool = True) -> DataFrame:
    return pdf.decode(_each(_t(spark, d, "documents").select("doc_id", "text"), _print), images, text)


@query("SELECT doc_id::VARCHAR AS doc_id, ceil(len(string_split(text, chr(10))) / 40)::INT AS n_pages FROM documents")
def pdf_pages(spark, d):
    return _prints(spark, d, False, False).select("doc_id", "n_pages")


@query(r"""WITH l AS (SELECT doc_id::VARCHAR AS doc_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
a AS (SELECT doc_id, n, line FROM l)
SELECT doc_id, (n // 40)::INT AS page_idx, (60 + 14 * (n % 40))::DOUBLE AS y, line AS text FROM a WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""")
def pdf_text_items(spark, d):
    return pdf_plan.items_of(_prints(spark, d, False)).select("doc_id", "page_idx", "y", "text")


@query(r"""WITH p AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
o AS (SELECT doc_id, sum(strlen(trim(line))) AS octets FROM p WHERE n < 40 GROUP BY doc_id) SELECT doc_id::VARCHAR AS doc_id FROM o WHERE octets < 100 AND doc_id % 2 = 0""")
def pdf_scanned_pages(spark, d):
    docs = stored(_prints(spark, d), "prints")
    return images.is_scan(pdf_plan.pages_of(docs), pdf_plan.items_of(docs), pdf_plan.images_of(docs)).where("is_scanned").select("doc_id")


@query()
def pdf_markdown(spark, d):
    return pdf_plan.markdown(stored(_prints(spark, d), "prints"))


@query("SELECT 'converted' AS status, (SELECT count(*) FROM region) + (SELECT count(*) FROM benchmark) AS files UNION ALL SELECT 'failed', count(*) FROM nation UNION ALL SELECT 'unsupported', count(*) FROM supplier")
def conversion_log(spark, d):
    from docloom.api import convert_files

    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    books = _made(rows, "r_name", _nation_book).withColumn("ext", F.lit(".xlsx"))
    prints = _each(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), _print).withColumn("ext", F.lit(".pdf"))
    broken = _t(spark, d, "nation").select(F.col("n_name").alias("doc_id"), F.encode(F.lit("junk"), "UTF-8").alias("content"), F.lit(".docx").alias("ext"))
    other = _t(spark, d, "supplier").select(F.col("s_name").alias("doc_id"), F.encode(F.lit("x"), "UTF-8").alias("content"), F.lit(".txt").alias("ext"))
    found = books.unionByName(prints).unionByName(broken).unionByName(other)
    return convert_files(found.withColumn("length", F.length("content"))).summary()


from docloom.plans import page_queries  # noqa: E402, F401  (adds its queries to these)
