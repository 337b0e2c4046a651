"""Queries of page layout, blocks, lists, images and PDF internals, with DuckDB SQL.

Pages are made of table rows so that SQL can say what must become of them; all
run through the functions that convert files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import synth
from docloom.functions import cells as C
from docloom.functions import text as T
from docloom.operators import blocks, elements, images, layout, lists, paragraphs, render, stats
from docloom.plans import docx as docx_plan
from docloom.plans import pdf as pdf_plan
from docloom.plans.queries import _I, _L, _LISTED, _MODES, _each, _items, _made, _sql, _t, query
from docloom.sources import docx, files, pdf
from docloom.options import Options
from docloom.storage import stored

# --- layout ------------------------------------------------------------------

#: Nations of each region, numbered from 0.
_N = "select n_regionkey, n_nationkey, n_name, cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) - 1 as r from {nation}"
_NSQL = "WITH n AS (" + _N.replace("{nation}", "nation") + ")"
#: Customers of each nation in full pages of eight.
_EIGHTS = """select nation, page_idx, k, c_name, c_mktsegment from (
  select *, count(*) over (partition by nation, page_idx) as n from (
    select *, cast((m - m % 8) / 8 as int) as page_idx, cast(m % 8 as int) as k from (
      select c_nationkey as nation, c_name, c_mktsegment, row_number() over (partition by c_nationkey order by c_custkey) - 1 as m from {customer}) a) b) c where n = 8"""
_FONTS = "map('F1', 'Helvetica', 'F2', 'Helvetica-Bold')"


def _laid(items: DataFrame) -> DataFrame:
    """Lines of (doc_id, page_idx, seq, x, y, text[, font]) items of 12 points, six points a character wide."""
    rows = items.withColumns({"doc_id": F.col("doc_id").cast("string"), "height": F.lit(12.0), "width": F.length("text") * 6.0, "x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    rows = rows if "font" in rows.columns else rows.withColumn("font", F.lit("F1"))
    # a small file of very many documents is one split: they are spread before anything is sorted or counted by document
    rows = rows.repartition("doc_id")
    pages = rows.select("doc_id", "page_idx").distinct().withColumn("height", F.lit(792.0))
    fonts = rows.select("doc_id").distinct().select("doc_id", F.expr(f"explode({_FONTS}) as (font_id, base_font)"))
    return layout.lines(rows, stats.document_stats(rows, fonts), pages)


def _table(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("doc_id").cast("int").alias("doc_id"), "page_idx", "line_no", "y", "is_table_row", "is_table_header", F.array_join("table_columns", "|").alias("cells"), "text")


@query(_NSQL + """ SELECT n_regionkey AS doc_id, 0 AS page_idx, r AS line_no, (100 + 40 * r)::DOUBLE AS y, true AS is_table_row, r = 0 AS is_table_header,
  n_nationkey || '|' || n_name || '|R' || n_regionkey AS cells, n_nationkey || ' ' || n_name || ' R' || n_regionkey AS text FROM n""")
def layout_aligned_table(spark, d):
    """Rows of matching columns become a table whose first row is its header."""
    each = "explode(array(struct(50 as x, cast(n_nationkey as string) as text, 0 as i), struct(200 as x, n_name as text, 1 as i), struct(350 as x, concat('R', n_regionkey) as text, 2 as i))) as c"
    items = _sql(spark, d, f"select n_regionkey as doc_id, 0 as page_idx, r, {each} from ({_N})").select("doc_id", "page_idx", (F.col("r") * 3 + F.col("c.i")).alias("seq"), "c.x", (100 + 40 * F.col("r")).alias("y"), "c.text")
    return _table(_laid(items))


@query(_NSQL + """, t AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'quickly' ELSE 'some words' END AS said FROM n)
SELECT n_regionkey AS doc_id, 0 AS page_idx, r + 1 AS line_no, (160 + 60 * r)::DOUBLE AS y, true AS is_table_row, false AS is_table_header, n_nationkey || '|' || n_name || '|' || said AS cells, n_nationkey || ' ' || n_name || ' ' || said AS text FROM t
UNION ALL SELECT DISTINCT n_regionkey, 0, 0, 100.0, true, true, 'Key|Nation|Comment', 'Key Nation Comment' FROM n
UNION ALL SELECT n_regionkey, 0, max(r)::INT + 2, 750.0, false, false, NULL, 'the foot' FROM n GROUP BY n_regionkey""")
def layout_header_table(spark, d):
    """A header over cells of two lines makes a table that ends above the footer; a word broken in a cell is closed up."""
    said = "case when n_nationkey % 2 = 0 then array('quick', 'ly') else array('some', 'words') end"
    body = f"array(struct(50 as x, 0 as dy, cast(n_nationkey as string) as text), struct(200 as x, 0 as dy, n_name as text), struct(350 as x, 0 as dy, {said}[0] as text), struct(350 as x, 12 as dy, {said}[1] as text))"
    rows = _sql(spark, d, f"select n_regionkey as doc_id, 160 + 60 * r as top, posexplode({body}) as (i, c) from ({_N})").select("doc_id", "c.x", (F.col("top") + F.col("c.dy")).alias("y"), "c.text")
    ends = "explode(array(struct(50 as x, 100 as y, 'Key' as text), struct(200 as x, 100 as y, 'Nation' as text), struct(350 as x, 100 as y, 'Comment' as text), struct(50 as x, 750 as y, 'the foot' as text))) as c"
    more = _sql(spark, d, f"select r_regionkey as doc_id, {ends} from {{region}}").select("doc_id", "c.x", "c.y", "c.text")
    return _table(_laid(rows.unionByName(more).withColumns({"page_idx": F.lit(0), "seq": F.col("y") * 1000 + F.col("x")})))


@query(_NSQL + """, t AS (SELECT n_regionkey AS doc_id, r, ['1.' || n_regionkey, 'Date ' || r, n_name] AS c FROM n WHERE r < 2)
SELECT doc_id, 0 AS page_idx, r + 1 AS line_no, (200 + 60 * r)::DOUBLE AS y, true AS is_table_row, false AS is_table_header, array_to_string(c, '|') AS cells, array_to_string(c, ' ') AS text FROM t
UNION ALL SELECT DISTINCT doc_id, 0, 0, 100.0, true, true, 'Version|Date|Description', 'Version Date Description' FROM t""")
def layout_known_header(spark, d):
    """A known header makes a table of few rows."""
    body = "array(struct(50 as x, concat('1.', n_regionkey) as text), struct(200 as x, concat('Date ', r) as text), struct(350 as x, n_name as text))"
    rows = _sql(spark, d, f"select n_regionkey as doc_id, 200 + 60 * r as y, explode({body}) as c from ({_N}) n where r < 2").select("doc_id", "c.x", "y", "c.text")
    more = _sql(spark, d, "select r_regionkey as doc_id, explode(array(struct(50 as x, 'Version' as text), struct(200 as x, 'Date' as text), struct(350 as x, 'Description' as text))) as c from {region}").select("doc_id", "c.x", F.lit(100).alias("y"), "c.text")
    return _table(_laid(rows.unionByName(more).withColumns({"page_idx": F.lit(0), "seq": F.col("y") * 1000 + F.col("x")})))


@query(_NSQL + " SELECT n_regionkey AS doc_id, 0 AS page_idx, r AS line_no, (100 + 40 * r)::DOUBLE AS y, true AS is_table_row, false AS is_table_header, '[' || r + 1 || ']|' || n_name AS cells, '[' || r + 1 || '] ' || n_name AS text FROM n")
def layout_reference_list(spark, d):
    """Entries like [1] with texts to their right are rows without a header."""
    each = "explode(array(struct(50 as x, concat('[', r + 1, ']') as text), struct(100 as x, n_name as text))) as c"
    items = _sql(spark, d, f"select n_regionkey as doc_id, 0 as page_idx, 100 + 40 * r as y, {each} from ({_N})").select("doc_id", "page_idx", "y", "c.x", "c.text")
    return _table(_laid(items.withColumn("seq", F.col("y") * 1000 + F.col("x"))))


@query("WITH e AS (" + _EIGHTS.replace("{customer}", "customer") + """) SELECT nation AS doc_id, page_idx, k AS line_no, (100 + 30 * k)::DOUBLE AS y, false AS is_table_row, false AS is_table_header, NULL AS cells, c_name AS text FROM e
UNION ALL SELECT nation, page_idx, 8 + k, 115.0 + 30 * k, false, false, NULL, lower(c_mktsegment) FROM e""")
def layout_text_columns(spark, d):
    """Two columns of running text are read one after the other."""
    each = "explode(array(struct(50 as x, 100 + 30 * k as y, c_name as text), struct(350 as x, 115 + 30 * k as y, lower(c_mktsegment) as text))) as c"
    items = _sql(spark, d, f"select nation as doc_id, page_idx, {each} from ({_EIGHTS})").select("doc_id", "page_idx", "c.x", "c.y", "c.text")
    return _table(_laid(items.withColumn("seq", F.col("y") * 1000 + F.col("x"))))


@query("SELECT p_partkey::VARCHAR AS doc_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '') END AS text FROM part")
def layout_spaces(spark, d):
    """Items of a line are words of their own where the gap between them is wide enough."""
    words = "transform(split(p_name, ' '), (w, i) -> struct(w as text, i as i, if(p_size % 2 = 0, 60, 5) as gap, length(array_join(slice(split(p_name, ' '), 1, i), '')) as before))"
    items = _sql(spark, d, f"select p_partkey as doc_id, 0 as page_idx, explode({words}) as w from {{part}}").select("doc_id", "page_idx", F.col("w.i").alias("seq"), (50 + 6 * F.col("w.before") + F.col("w.i") * F.col("w.gap")).alias("x"), F.lit(100).alias("y"), "w.text")
    return _laid(items).select("doc_id", "text")


@query("SELECT n_nationkey::VARCHAR AS doc_id, 0 AS line_no, n_name AS text FROM nation")
def layout_dropped_items(spark, d):
    """Items off the page, blank ones and such as repeat themselves are dropped."""
    each = "explode(array(struct(50 as x, 100 as y, n_name as text), struct(-5 as x, 120 as y, 'off the page' as text), struct(50 as x, 140 as y, repeat('spam and eggs ', 10) as text), struct(50 as x, 160 as y, '   ' as text))) as c"
    items = _sql(spark, d, f"select n_nationkey as doc_id, 0 as page_idx, {each} from {{nation}}").select("doc_id", "page_idx", F.col("c.y").alias("seq"), "c.x", "c.y", "c.text")
    return _laid(items).select("doc_id", "line_no", "text")


@query(r"""WITH w AS (SELECT page_id::VARCHAR AS doc_id, unnest([url, regexp_replace(url, '^https?://', 'www.'), 'said(7)', 'printf(3)']) AS s, unnest([0, 1, 2, 3]) AS i FROM pages)
SELECT doc_id, i AS n, CASE WHEN s LIKE 'www.%' THEN 'http://' || s WHEN s = 'said(7)' THEN 'said[^7]' ELSE s END AS s, CASE WHEN s LIKE 'www.%' OR s LIKE 'http%:%' THEN 'LINK' END AS type, 'BOLD' AS format FROM w""")
def layout_line_words(spark, d):
    """Words of a line with links, notes and the format of its font."""
    items = _sql(spark, d, "select page_id as doc_id, 0 as page_idx, 0 as seq, 50 as x, 100 as y, concat(url, ' ', regexp_replace(url, '^https?://', 'www.'), ' said(7) printf(3)') as text, 'F2' as font from {pages}")
    plain = _sql(spark, d, "select page_id as doc_id, 1 as page_idx, k as seq, 50 as x, 100 + 50 * k as y, 'x' as text, 'F1' as font from {pages}, lateral explode(sequence(1, 3)) as t(k)")
    return _laid(items.unionByName(plain)).where("page_idx = 0").select("doc_id", F.posexplode("words").alias("n", "w")).select("doc_id", "n", "w.s", "w.type", "w.format")


# --- fonts, lists, blocks ----------------------------------------------------


@query(_MODES + """, f AS (SELECT DISTINCT doc_id, unnest(['A', 'N', 'R']) AS font_id, unnest(['Times-Bold', 'Times-BoldItalic', 'Arial']) AS base FROM i)
SELECT doc_id, font_id, CASE WHEN font_id = mode_font THEN NULL WHEN base = 'Times-BoldItalic' THEN 'BOLD_OBLIQUE' WHEN base = 'Times-Bold' THEN 'BOLD' WHEN font_id = max_font THEN 'BOLD' END AS style FROM f JOIN mf USING (doc_id) JOIN mx USING (doc_id)""")
def font_styles(spark, d):
    items = _items(spark, d)
    fonts = items.select("doc_id").distinct().select("doc_id", F.expr("explode(map('A', 'Times-Bold', 'N', 'Times-BoldItalic', 'R', 'Arial')) as (font_id, base_font)"))
    known = stats.modal_font(items).join(stats.tallest(items), "doc_id")
    return stats.font_styles(fonts, known).select("doc_id", F.explode("styles").alias("font_id", "style"))


_LISTS = _LISTED.replace("select p_partkey, ", "select p_brand, p_partkey, p_size, ")


@query("WITH p AS (" + _LISTS.replace("{part}", "part").replace(" as string", " as varchar") + r"""), t AS (SELECT *, trim(line) AS text, p_size * 7 % 90 AS x FROM p),
i AS (SELECT *, regexp_matches(text, '^([0-9]+[.)]\s|[a-z][.)]\s|[A-Z][.)]\s|(x{0,3}(ix|iv|v?i{0,3}))[.)]\s|(X{0,3}(IX|IV|V?I{0,3}))[.)]\s)') OR text LIKE '- %' AS item FROM t),
m AS (SELECT *, min(CASE WHEN item THEN x END) OVER (PARTITION BY p_brand) AS least FROM i)
SELECT p_partkey, CASE WHEN item THEN 'LIST' END AS type, CASE WHEN item THEN least(6, floor((x - least) / 20))::INT ELSE 0 END AS list_level, text FROM m""")
def pdf_list_lines(spark, d):
    rows = _sql(spark, d, _LISTS).select(F.col("p_brand").alias("doc_id"), F.lit(0).alias("page_idx"), "p_partkey", F.trim("line").alias("text"), (F.col("p_size") * 7 % 90).cast("double").alias("x"), F.lit(None).cast("string").alias("type"))
    word = lambda w: F.struct(w.alias("s"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("format"))
    found = lists.detect(rows.withColumn("words", F.transform(F.split("text", " "), word)))
    return found.select("p_partkey", "type", "list_level", F.array_join(F.transform("words", lambda w: w["s"]), " ").alias("text"))


_PARAS = "select c_nationkey as doc_id, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as int) as n, c_name from {customer}"


@query("WITH l AS (" + _PARAS.replace("{customer}", "customer") + """), t AS (SELECT *, CASE WHEN n % 9 = 0 THEN 'H2' WHEN n % 9 = 4 THEN 'LIST' END AS type, n % 9 IN (7, 8) AS is_table FROM l),
p AS (SELECT *, lag(type) OVER w AS pt, lag(is_table) OVER w AS pb, lag(n) OVER w AS pn FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
k AS (
  SELECT *, CASE WHEN pn IS NULL THEN true WHEN pb AND is_table THEN false WHEN pb <> is_table THEN true WHEN type IS NULL AND pt = 'LIST' AND n % 3 <> 0 THEN false
    WHEN type IS NOT NULL OR pt IS NOT NULL THEN true WHEN n % 9 = 6 THEN true ELSE n % 3 = 0 END AS new,
    CASE WHEN type IS NOT NULL THEN type WHEN n % 9 = 5 THEN 'LIST' END AS block_type
  FROM p
) SELECT doc_id, n AS line_no, block_type, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS block_no FROM k""")
def pdf_line_blocks(spark, d):
    """Lines in runs of three, with a heading, a list item that goes on for a line, and a table among them."""
    n = F.col("n")
    rows = _sql(spark, d, _PARAS).select(
        "doc_id", F.lit(0).alias("page_idx"), n.alias("line_no"), F.lit(50.0).alias("x"), (n * 12 + F.floor(n / 3) * 40).cast("double").alias("y"), F.lit(12).alias("distance"),
        F.when(n % 9 == 0, "H2").when(n % 9 == 4, "LIST").alias("type"), (n % 9).isin(7, 8).alias("is_table_row"),
    )
    return blocks.number_pdf_blocks(rows, "topdown").select("doc_id", "line_no", "block_type", "block_no")


@query(r"SELECT page_id, replace(replace(regexp_replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), '\r\n|\r', chr(10), 'g'), chr(10), '<br>'), '|', '\|') AS cell FROM (SELECT page_id, '  ' || html || '| a' || chr(13) || 'b ' AS html FROM pages)")
def clean_cells(spark, d):
    return _t(spark, d, "pages").select("page_id", C.clean_cell(F.concat(F.lit("  "), "html", F.lit("| a\rb "))).alias("cell"))


@query("SELECT p_partkey, substr('-•–—◦○●▪■□▸►▹▻★☆·∙⁃*ax1', 1 + p_partkey % 23, 1 + p_size % 2) AS sign, p_size % 2 = 0 AND p_partkey % 23 < 19 AS is_bullet FROM part")
def bullet_characters(spark, d):
    sign = F.expr("substr('-•–—◦○●▪■□▸►▹▻★☆·∙⁃*ax1', int(1 + p_partkey % 23), int(1 + p_size % 2))")
    return _t(spark, d, "part").select("p_partkey", sign.alias("sign"), T.is_bullet(sign).alias("is_bullet"))


@query(_NSQL + """ SELECT n_regionkey, '| Key | Nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY r) AS text FROM n WHERE n_nationkey % 7 <> 3 GROUP BY n_regionkey""")
def render_tables(spark, d):
    """Rows without any text are left out of a table."""
    rows = _sql(spark, d, f"select n_regionkey, 1 as block_no, r + 1 as n, if(n_nationkey % 7 = 3, array('', '  '), array(cast(n_nationkey as string), concat(' ', n_name))) as table_columns, false as is_table_header from ({_N})")
    rows = rows.unionByName(_sql(spark, d, "select r_regionkey as n_regionkey, 1 as block_no, 0 as n, array('Key', 'Nation ') as table_columns, true as is_table_header from {region}"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"block_type": none, "type": none, "list_level": F.lit(0), "is_table_row": F.lit(True), "words": F.array().cast("array<struct<s:string,type:string,format:string>>")})
    return render.blocks(rows, ["n_regionkey"], "n").select("n_regionkey", "text")


@query("""WITH l AS (SELECT p_brand AS doc_id, p_size % 4 AS page_idx, p_partkey, p_size FROM part)
SELECT doc_id, coalesce(array_to_string(list(p_size ORDER BY page_idx, p_partkey) FILTER (p_size % 3 = 0), ','), '') AS notes, bool_or(p_size % 5 = 0) AS has_links, (2 * count(*) FILTER (p_size % 2 = 0))::BIGINT AS formatted_words FROM l GROUP BY doc_id""")
def parsed_elements(spark, d):
    word = lambda s, kind, fmt: F.struct(s.alias("s"), kind.cast("string").alias("type"), fmt.cast("string").alias("format"))
    size, none = F.col("p_size"), F.lit(None)
    bold = F.when(size % 2 == 0, F.lit("BOLD"))
    words = F.array(word(F.lit("said"), none, bold), word(size.cast("string"), F.when(size % 3 == 0, "FOOTNOTE_LINK"), none), word(F.lit("http://x"), F.when(size % 5 == 0, "LINK"), bold))
    lines = _t(spark, d, "part").select(F.col("p_brand").alias("doc_id"), (size % 4).alias("page_idx"), F.col("p_partkey").alias("line_no"), words.alias("words"))
    return elements.merged(elements.of_pages(lines)).select("doc_id", F.array_join("note_links", ",").alias("notes"), "has_links", "formatted_words")


_SINK = "SELECT c_custkey, c_mktsegment || '.pdf' AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey || '/' || c_mktsegment || '.pdf') - 1 AS n FROM customer"


@query(f"""WITH c AS ({_SINK}), s AS (SELECT 'skip' AS mode, c_custkey, name, n AS k, CASE WHEN n IN (0, 2) THEN 'skipped' ELSE 'new' END AS status FROM c
UNION ALL SELECT 'number', c_custkey, name, CASE WHEN n = 0 THEN 1 ELSE n + 2 END, 'new' FROM c)
SELECT mode, c_custkey, 'out/' || name || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '.md' AS output_path, status FROM s""")
def sink_targets(spark, d):
    """Plain names and those with -2 are there already: skipped by default, passed over otherwise."""
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit(".pdf")).alias("doc_id"))
    there = _t(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("out/"), "c_mktsegment", F.lit(".pdf.md")), F.concat(F.lit("out/"), "c_mktsegment", F.lit(".pdf-2.md")))).alias("path")).distinct()
    both = [files.targets(rows, there, Options(output_directory="out", skip_existing=skip)).withColumn("mode", F.lit(mode)) for mode, skip in (("skip", True), ("number", False))]
    return both[0].unionByName(both[1]).select("mode", "c_custkey", "output_path", "status")


# --- images ------------------------------------------------------------------

_PICTURES = "select cast(s_nationkey as string) as doc_id, s_suppkey, cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) as ord, case s_suppkey % 4 when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' else 'odd' end as format, case when s_suppkey % 3 = 0 then s_name else '' end as alt from {supplier}"
_PICTURE_SQL = "WITH p AS (" + _PICTURES.replace("{supplier}", "supplier").replace(" as string", " as varchar") + "), f AS (SELECT *, 'image_' || printf('%03d', ord) AS id, CASE format WHEN 'jpeg' THEN '.jpg' WHEN 'odd' THEN '.bin' ELSE '.' || format END AS ext FROM p)"


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    found = _sql(spark, d, _PICTURES).withColumn("image_id", F.format_string("image_%03d", "ord"))
    at = found.select("doc_id").distinct().withColumn("output_path", F.concat(F.lit("out/"), "doc_id", F.lit(".pdf.md")))
    return images.placed(found, at)


@query(_PICTURE_SQL + " SELECT s_suppkey, 'out/' || doc_id || '.pdf_images/' || id || ext AS image_path, doc_id || '.pdf_images/' || id || ext AS link FROM f")
def image_files(spark, d):
    return _pictures(spark, d).select("s_suppkey", "image_path", "link")


@query(_PICTURE_SQL + """ SELECT doc_id, string_agg('see ![' || CASE WHEN alt = '' THEN 'image' ELSE alt END || '](' || doc_id || '.pdf_images/' || id || ext || ')', chr(10) ORDER BY ord) AS markdown FROM f GROUP BY doc_id""")
def image_links(spark, d):
    found = _pictures(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("image_id").alias("id"), "alt", "link"))).alias("links"))
    text = F.array_join(F.transform("links", lambda i: F.concat(F.lit("see !["), i["id"], F.lit("]"))), "\n")
    return found.select("doc_id", images.references(text, F.col("links")).alias("markdown"))


@query("SELECT s_suppkey, '89504E470D0A1A0A0000000D49484452' || printf('%08X', 1 + s_suppkey % 5) || printf('%08X', 1 + s_nationkey % 4) || '08' || CASE WHEN s_suppkey % 2 = 0 THEN '02' ELSE '00' END || '000000' AS head FROM supplier")
def png_headers(spark, d):
    rows = _t(spark, d, "supplier").select("s_suppkey", (1 + F.col("s_suppkey") % 5).cast("int").alias("w"), (1 + F.col("s_nationkey") % 4).alias("h"), F.when(F.col("s_suppkey") % 2 == 0, F.when(F.col("s_suppkey") % 4 == 0, "DeviceCMYK").otherwise("DeviceRGB")).otherwise("DeviceGray").alias("space"))
    data = images.png(F.encode(F.repeat(F.lit("abc"), 40), "UTF-8"), F.col("w"), F.col("h"), F.lit(8), F.col("space"))
    return rows.select("s_suppkey", F.substring(F.hex(data), 1, 58).alias("head"))


# --- text documents ----------------------------------------------------------


@query("""SELECT n_nationkey::VARCHAR AS doc_id, '## Document Headers' || chr(10) || chr(10) || '**header1**: ' || r_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '## Document Footers' || chr(10) || chr(10) || '**footer1**: page' || chr(10) || chr(10) || '**footer2**: ' || n_nationkey || chr(10) || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey""")
def docx_sides(spark, d):
    from docloom.options import WordOptions

    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("doc_id"), "n_name", "r_name")
    made = _each(rows, lambda r: synth.docx(synth.para(synth.run(r["n_name"])), headers=[r["r_name"]], footers=["page", str(r["doc_id"])]))
    return docx_plan.markdown(docx.decode(made), WordOptions(headers_footers=True))


@query("""SELECT n_nationkey::VARCHAR AS doc_id, n_name AS s, CASE n_nationkey % 4 WHEN 1 THEN 'BOLD' WHEN 2 THEN 'OBLIQUE' WHEN 3 THEN 'BOLD_OBLIQUE' END AS format,
  CASE n_nationkey % 4 WHEN 1 THEN '**' || n_name || '**' WHEN 2 THEN '_' || n_name || '_' WHEN 3 THEN '**_' || n_name || '_**' ELSE n_name END || chr(10) || chr(10) AS markdown FROM nation""")
def docx_formats(spark, d):
    made = _each(_t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), "n_name"), lambda r: synth.docx(synth.para(synth.run(r["n_name"], bool(r["doc_id"] & 1), bool(r["doc_id"] & 2)))))
    docs = stored(docx.decode(made), "formats")
    word = F.get("words", F.lit(0))
    return paragraphs.lines(docs).select("doc_id", word["s"].alias("s"), word["format"].alias("format")).join(docx_plan.markdown(docs), "doc_id")


# --- PDF ---------------------------------------------------------------------

_CODINGS = ["flate", "lzw", "ascii85", "hex", "predictor", "none"]


def _coded(r: dict) -> bytes:
    n = int(r["n"])
    items = [(72, 60 + 14 * k, x, 12, "F1") for k, x in enumerate(r["text"].split("\n")) if x.strip()]
    return synth.pdf([items], coding=_CODINGS[n % 6], unicode=n % 5 < 2, arrays=n % 4 == 0, bundled=n % 7 in (1, 2) and n % 3 != 0, locked=n % 3 == 0)


@query(r"""WITH l AS (SELECT conv_id || '-' || turn AS doc_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations))
SELECT doc_id, (60 + 14 * n)::DOUBLE AS y, line AS text FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""")
def pdf_codings(spark, d):
    """Filters, predictors, object streams, encryption, kerned texts and maps to Unicode give the same text."""
    rows = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"), "text")
    return pdf_plan.items_of(pdf.decode(_each(rows, _coded), False)).select("doc_id", "y", "text")


def _report(g) -> bytes:
    g = g.sort_values("n_nationkey")
    pages = []
    for k, n in zip(g["n_nationkey"], g["n_name"]):
        text = [(72, 40, "The Running Head", 12, "F1"), (72, 100, str(n), 30, "F2"), (72, 160, f"Number {k} is told", 12, "F1"), (72, 200, "and no more is said.", 12, "F1"), (72, 760, f"Page {k}", 12, "F1")]
        pages.append(text)
    return synth.pdf(pages, unicode=True)


@query(r"""SELECT r_name AS doc_id, string_agg('# ' || n_name || ' ' || chr(10) || chr(10) || 'Number ' || n_nationkey || ' is told ' || chr(10) || chr(10) || 'and no more is said. ' || chr(10) || chr(10), '' ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def pdf_reports(spark, d):
    """Titles become headings; running heads and page numbers of all pages go."""
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pdf_plan.markdown(stored(pdf.decode(_made(rows, "r_name", _report)), "reports"))


def _scan(r: dict) -> bytes:
    n = int(r["doc_id"])
    return synth.pdf([[], [(72, 100 + 20 * k, f"line {k} of a page that holds text", 12, "F1") for k in range(6)]][: 1 + n % 2] + [[]], {0: (600, 700, b"\1\2\3" * 420), n % 2 + 1: (600, 600, b"\4")})


@query("""SELECT n_nationkey::VARCHAR AS doc_id, image_id, page_idx, is_page_scan FROM nation, (VALUES ('page_001', 0, true, 0), ('page_002', 1, true, 0), ('page_001', 0, true, 1), ('page_003', 2, true, 1)) v(image_id, page_idx, is_page_scan, odd) WHERE n_nationkey % 2 = odd""")
def pdf_scan_numbers(spark, d):
    made = stored(pdf.decode(_each(_t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id")), _scan)), "scans")
    pages = images.is_scan(pdf_plan.pages_of(made), pdf_plan.items_of(made), pdf_plan.images_of(made))
    from docloom.options import PdfOptions

    return pdf_plan.pictures(made, pages, PdfOptions()).select("doc_id", "image_id", "page_idx", "is_page_scan")
