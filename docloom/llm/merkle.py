"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line that isn't blank, without the blanks at its ends.  A
section ends after each paragraph whose hash starts with 0 or 1, about every
eighth, so that sections realign after an insertion.  A section's hash covers
its paragraphs' hashes and the root covers the sections' hashes; all are the
first 128 bits of SHA-256, as hexadecimal digits.

Equal roots mean equal documents.  Every document is compared with a base, the
earlier document in which most of its paragraphs appear first: each paragraph
hash names the lowest (doc_id, root) that holds it, and the paragraphs of a
document are counted by what they name.  A paragraph that many documents share
costs a row a document and no pairs.

To locate edits the two trees are descended: sections whose hashes both trees
hold are skipped, equal ones as often as both hold them (the first ones), and
what remains of the paragraphs is held against each other in the same way.
The numbers of the paragraphs left over are listed for both documents.  Trees
are built within a row; only hashes are moved, never texts.

Defined results: a null text has the tree of an empty one: the root of no
sections.  Repeated rows have equal roots; rows that agree in id and text get
the same answer.  The base of a document with an earlier equal one is the lowest
of these, ``equal`` is true and nothing has changed.  Of several bases that
share equally many paragraphs the lowest (doc_id, root) is taken, null ids last.  A
document that shares no paragraph with an earlier one has no base, and null for all that is
said of one.  A moved section or paragraph is no edit of ``compare``, whose roots
differ all the same; ``revisions`` aligns the trees in order instead, and lists it
where it was removed and where it was added.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

_BLANKS = " \t\r"


def _hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, as an array."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(_BLANKS))), lambda x: x != "")


def sections(leaves: Column) -> Column:
    """Sections of an array of paragraph hashes, each its hashes joined by commas."""
    marked = F.transform(leaves, lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin("0", "1"), F.lit("|")).otherwise(F.lit(","))))
    joined = F.regexp_replace(F.array_join(marked, ""), "[|,]$", "")
    return F.when(F.size(leaves) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(joined, r"\|", -1), lambda s: F.rtrim(s, F.lit(","))))


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root, sections, n_paragraphs) of every row: a projection."""
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.transform(paragraphs(F.col(text_col)), _hash).alias("leaves"))
    found = leaves.select("doc_id", F.size("leaves").alias("n_paragraphs"), sections(F.col("leaves")).alias("sections"))
    return found.select("doc_id", _hash(F.array_join(F.transform("sections", _hash), ",")).alias("root"), "sections", "n_paragraphs")


def _hashes(sections: Column) -> Column:
    """The paragraph hashes of a tree's sections."""
    return F.filter(F.split(F.array_join(sections, ","), ","), lambda h: h != "")


def nearest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, root, sections, n_paragraphs, first, base, base_id, shared, equal): every row with its base.

    ``first`` is the row that stands for a document's tree, ``base`` that of its
    base; ``shared`` counts the document's paragraphs that appear first in the base.
    """
    table = materialize(trees(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "merkle")
    # rows that agree in id and root are alike: any of them may stand for all
    first = table.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("o"))
    known = materialize(table.join(first, "root"), "merkle-known")
    own = known.where("o.row = row").select(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.unhex("root").alias("root"), "row").alias("d"), "sections")
    leaf = own.select("d", F.explode(F.transform(_hashes(F.col("sections")), lambda h: F.unhex(h))).alias("h"))
    owner = leaf.groupBy("h").agg(F.min("d").alias("b"), F.max("d.row").alias("hi"), F.min("d.row").alias("lo")).where("hi <> lo").select("h", "b")
    votes = leaf.join(owner, "h").where("b < d").groupBy(F.col("d.row").alias("first"), "b").agg(F.count("*").alias("shared"))
    best = votes.groupBy("first").agg(F.min(F.struct((-F.col("shared")).alias("less"), "b")).alias("x"))
    best = best.select("first", F.col("x.b.row").alias("base"), F.col("x.b.doc_id").alias("base_id"), (-F.col("x.less")).alias("shared"))
    wide = known.withColumn("first", F.col("o.row")).join(best, "first", "left")
    twin = ~F.col("o.doc_id").eqNullSafe(F.col("doc_id"))
    return wide.select(
        "row", "doc_id", "root", "sections", "n_paragraphs", "first",
        F.when(twin, F.col("first")).otherwise(F.col("base")).alias("base"), F.when(twin, F.col("o.doc_id")).otherwise(F.col("base_id")).alias("base_id"),
        F.when(twin, F.col("n_paragraphs").cast("bigint")).otherwise(F.col("shared")).alias("shared"),
        F.when(twin, F.lit(True)).when(F.col("base").isNotNull(), F.lit(False)).alias("equal"),
    )


def left_over(own: list[str], other: Counter[str]) -> list[int]:
    """Places in ``own`` of what ``other`` doesn't hold, or not as often: of equal ones the last."""
    seen: Counter[str] = Counter()
    out = []
    for i, h in enumerate(own):
        seen[h] += 1
        if seen[h] > other[h]:
            out.append(i)
    return out


def differences(base: list[str], own: list[str]) -> tuple[int, list[int], list[int]]:
    """Sections of ``own`` that ``base`` doesn't hold, and numbers from 1 of the paragraphs only in ``base``, and only in ``own``."""
    left = []
    for x, y in ((base, own), (own, base)):
        gone = set(left_over(x, Counter(y)))
        n, at = 0, []
        for k, s in enumerate(x):
            leaves = s.split(",")
            if k in gone:
                at += [(n + j, h) for j, h in enumerate(leaves, 1)]
            n += len(leaves)
        left.append((len(gone), at))
    hashes = [[h for _, h in at] for _, at in left]
    removed, added = (left_over(x, Counter(y)) for x, y in (hashes, hashes[::-1]))
    return left[1][0], [left[0][1][i][0] for i in removed], [left[1][1][i][0] for i in added]


def spelled(numbers: list[int]) -> str:
    """1, 2, 3, 7 as '1-3,7'."""
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(f"{a}" if a == b else f"{a}-{b}" for a, b in out)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [differences(a, b) for a, b in zip(batch["base_sections"].to_pylist(), batch["sections"].to_pylist())]
        ints = [pa.array(x, pa.int32()) for x in ([n for n, *_ in found], [len(r) for _, r, _ in found], [len(a) for *_, a in found])]
        texts = [pa.array(x, pa.string()) for x in ([spelled(r) for _, r, _ in found], [spelled(a) for *_, a in found])]
        yield pa.RecordBatch.from_arrays([batch["first"], *ints, *texts], ["first", "sections_changed", "removed", "added", "removed_at", "added_at"])


def _pairs(rows: DataFrame) -> DataFrame:
    """(first, sections, base_sections) of every tree that differs from its base."""
    apart = rows.where("not equal and row = first").select("first", "base", "sections")
    return apart.join(rows.select(F.col("row").alias("base"), F.col("sections").alias("base_sections")), "base").drop("base")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root, n_sections, n_paragraphs, base_id, shared, equal, sections_changed, removed, added, removed_at, added_at) of every row.

    ``removed_at`` and ``added_at`` list numbers of paragraphs, of the base and of
    the document, as runs like '4,17-19'.
    """
    rows = materialize(nearest(docs, id_col, text_col), "merkle-nearest")
    apart = _pairs(rows).mapInArrow(_compared, "first bigint, sections_changed int, removed int, added int, removed_at string, added_at string")
    wide = rows.select("doc_id", "root", F.size("sections").alias("n_sections"), "n_paragraphs", "base_id", "shared", "equal", F.when(~F.col("equal"), F.col("first")).alias("first")).join(apart, "first", "left")
    plain = {"sections_changed": 0, "removed": 0, "added": 0, "removed_at": "", "added_at": ""}
    return wide.select("doc_id", "root", "n_sections", "n_paragraphs", "base_id", "shared", "equal", *[F.when(F.col("equal"), F.lit(v)).otherwise(F.col(x)).alias(x) for x, v in plain.items()])


def align(base: list[str], own: list[str]) -> tuple[int, list[tuple[int, int, int]]]:
    """Sections of ``own`` without a partner, and every run that differs as (first, removed, added).

    ``first`` is the number, from 1, of the run's first paragraph in ``own``, or
    of the one after the gap where nothing was added.
    """
    parts = [[s.split(",") for s in x] for x in (base, own)]
    lo, most = 0, min(len(base), len(own))
    while lo < most and base[lo] == own[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and base[len(base) - 1 - hi] == own[len(own) - 1 - hi]:
        hi += 1
    changed, runs = 0, []
    at = sum(map(len, parts[1][:lo]))  # paragraphs of own before this place
    for tag, a, b, c, d in _blocks(base[lo : len(base) - hi], own[lo : len(own) - hi]):
        old, new = ([h for s in x[i + lo : j + lo] for h in s] for x, i, j in ((parts[0], a, b), (parts[1], c, d)))
        if tag != "equal":
            changed += d - c
            runs += [(at + k + 1, j - i, m - k) for kind, i, j, k, m in _blocks(old, new) if kind != "equal"]
        at += len(new)
    return changed, runs


def _blocks(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("removed", pa.int32()), ("added", pa.int32())]))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [align(a, b) for a, b in zip(batch["base_sections"].to_pylist(), batch["sections"].to_pylist())]
        runs = [[{"first": f, "removed": r, "added": n} for f, r, n in x] for _, x in found]
        yield pa.RecordBatch.from_arrays([batch["first"], pa.array([n for n, _ in found], pa.int32()), pa.array(runs, _RUNS)], ["first", "sections_changed", "edits"])


def revisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root, n_sections, n_paragraphs, base_id, shared, equal, sections_changed, edits) of every row.

    ``edits`` lists every run of paragraphs that differs from the base that
    ``nearest`` names; it is empty where they are equal and null without a base.
    """
    rows = materialize(nearest(docs, id_col, text_col), "merkle-nearest")
    apart = _pairs(rows).mapInArrow(_aligned, "first bigint, sections_changed int, edits array<struct<first:int,removed:int,added:int>>")
    wide = rows.withColumn("first", F.when(~F.col("equal"), F.col("first"))).join(apart, "first", "left")
    none = F.array().cast("array<struct<first:int,removed:int,added:int>>")
    return wide.select(
        "doc_id", "root", F.size("sections").alias("n_sections"), "n_paragraphs", "base_id", "shared", "equal",
        F.when(F.col("equal"), F.lit(0)).otherwise(F.col("sections_changed")).alias("sections_changed"), F.when(F.col("equal"), none).otherwise(F.col("edits")).alias("edits"),
    )


#: The same as ``compare`` in DuckDB's SQL over ``documents``.
COMPARE_SQL = r"""
WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents
), leaves AS (SELECT doc_id, list_transform(p, lambda x: substr(sha256(x), 1, 32)) AS h FROM lines),
secs AS (
  SELECT doc_id, len(h) AS n_paragraphs, h,
    CASE WHEN len(h) = 0 THEN []::VARCHAR[] ELSE list_transform(string_split(
      regexp_replace(array_to_string(list_transform(h, lambda x: x || CASE WHEN x[1] IN ('0', '1') THEN '|' ELSE ',' END), ''), '[|,]$', ''), '|'), lambda s: rtrim(s, ',')) END AS s
  FROM leaves
), tree AS (
  SELECT *, first_value(doc_id) OVER w AS o_id, first_value(k) OVER w AS o FROM (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, root) AS k FROM (SELECT *, substr(sha256(coalesce(array_to_string(list_transform(s, lambda x: substr(sha256(x), 1, 32)), ','), '')), 1, 32) AS root FROM secs)
  ) WINDOW w AS (PARTITION BY root ORDER BY k)
), leaf AS (SELECT k, unnest(h) AS x FROM tree WHERE k = o), owner AS (SELECT x, min(k) AS b FROM leaf GROUP BY x),
best AS (SELECT k, b, n FROM (SELECT leaf.k, b, count(*) AS n FROM leaf JOIN owner USING (x) WHERE b < leaf.k GROUP BY leaf.k, b) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, b) = 1),
pair AS (SELECT best.k, c.s AS s, b.s AS bs FROM best JOIN tree c ON c.k = best.k JOIN tree b ON b.k = best.b),
sec AS (
  SELECT k, own, i, x, row_number() OVER (PARTITION BY k, own, x ORDER BY i) AS nth, count(*) OVER (PARTITION BY k, own, x) AS n, len(string_split(x, ',')) AS size
  FROM (SELECT k, true AS own, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM pair UNION ALL SELECT k, false, unnest(bs), unnest(range(1, len(bs) + 1)) FROM pair)
), placed AS (SELECT *, sum(size) OVER (PARTITION BY k, own ORDER BY i) - size AS skipped FROM sec),
many AS (SELECT DISTINCT k, own, x, n FROM sec),
unmet AS (SELECT a.* FROM placed a LEFT JOIN many m ON m.k = a.k AND m.own <> a.own AND m.x = a.x WHERE a.nth > coalesce(m.n, 0)),
par AS (
  SELECT *, row_number() OVER (PARTITION BY k, own, h ORDER BY p) AS nth, count(*) OVER (PARTITION BY k, own, h) AS n
  FROM (SELECT k, own, skipped + unnest(range(1, size + 1)) AS p, unnest(string_split(x, ',')) AS h FROM unmet)
), seen AS (SELECT DISTINCT k, own, h, n FROM par),
rest AS (SELECT a.k, a.own, a.p FROM par a LEFT JOIN seen m ON m.k = a.k AND m.own <> a.own AND m.h = a.h WHERE a.nth > coalesce(m.n, 0)),
run AS (SELECT k, own, min(p)::BIGINT AS lo, max(p)::BIGINT AS hi, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY k, own ORDER BY p) AS g FROM rest) GROUP BY k, own, g),
edit AS (
  SELECT k, sum(n) FILTER (NOT own) AS removed, sum(n) FILTER (own) AS added,
    string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) FILTER (NOT own) AS removed_at,
    string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) FILTER (own) AS added_at
  FROM run GROUP BY k
), gone AS (SELECT k, count(*) AS n FROM unmet WHERE own GROUP BY k),
a AS (
  SELECT t.*, t.o_id IS DISTINCT FROM t.doc_id AS twin, best.n AS shared, b.doc_id AS b_id, best.k IS NOT NULL AS based, edit.*, gone.n AS sections_gone
  FROM tree t LEFT JOIN best ON best.k = t.o LEFT JOIN tree b ON b.k = best.b LEFT JOIN edit ON edit.k = t.o LEFT JOIN gone ON gone.k = t.o
)
SELECT doc_id, root, len(s)::INT AS n_sections, n_paragraphs::INT AS n_paragraphs, CASE WHEN twin THEN o_id ELSE b_id END AS base_id,
  CASE WHEN twin THEN n_paragraphs ELSE shared END::BIGINT AS shared, CASE WHEN twin THEN true WHEN based THEN false END AS equal,
  CASE WHEN twin THEN 0 WHEN based THEN coalesce(sections_gone, 0) END::INT AS sections_changed, CASE WHEN twin THEN 0 WHEN based THEN coalesce(removed, 0) END::INT AS removed,
  CASE WHEN twin THEN 0 WHEN based THEN coalesce(added, 0) END::INT AS added, CASE WHEN twin THEN '' WHEN based THEN coalesce(removed_at, '') END AS removed_at,
  CASE WHEN twin THEN '' WHEN based THEN coalesce(added_at, '') END AS added_at
FROM a
"""
