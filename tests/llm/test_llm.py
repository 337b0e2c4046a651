"""The training-data operators against brute force, round trips and odd input."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, chat, merkle, neardup, packing, pieces, pii, quality, registry, sharding, textkit, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(60_000))


def docs(spark, rows):
    """Documents of (doc_id, text) with columns whose names operators might use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "1 as keep", "'x' as node", "2L as t", "true as held", "'y' as x", "3 as length", "4 as grp")


ODD = [(1, None), (2, ""), (3, "  \n "), (None, "some text of a row without an id"), (4, "same text in two rows"), (4, "same text in two rows"), (5, "same text in two rows"), (6, LONG)]


# --- 1 PII -------------------------------------------------------------------


@pytest.mark.parametrize(("text", "surface", "kind"), [
    ("mail a.b19@mail5.example.com now", "a.b19@mail5.example.com", "email"),
    ("to a.b [at] mail5 [dot] example [dot] com!", "a.b [at] mail5 [dot] example [dot] com", "email"),
    ("john at example dot com, thanks", "john at example dot com", "email"),
    ("jоhn＠exаmple．cоm", "jоhn＠exаmple．cоm", "email"),
    ("x jo​hn@exam​ple.com y", "jo​hn@exam​ple.com", "email"),
    ("john&#64;example&#46;com", "john&#64;example&#46;com", "email"),
    ("call five five five one two three four five six seven", "five five five one two three four five six seven", "phone"),
    ("null eins zwei drei vier fünf sechs sieben", "null eins zwei drei vier fünf sechs sieben", "phone"),
    ("+1 (743) 555-3824 é", "+1 (743) 555-3824", "phone"),
    ("at 10.1.2.3.", "10.1.2.3", "ip"),
    ("192 dot 168 dot 0 dot 1", "192 dot 168 dot 0 dot 1", "ip"),
    ("４０４１８９４９７４６０８７９５", "４０４１８９４９７４６０８７９５", "card"),
    ("⒋⒌⒍ is no address, 1⒐2⒐8⒐7 is", "1⒐2⒐8⒐7", "ip"),
    ("john@exampｌe.ofﬁce", "john@exampｌe.ofﬁce", "email"),
    ("card 4041 8949 7460 8795", "4041 8949 7460 8795", "card"),
    ("DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00", "iban"),
    ('token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"', "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "secret"),
])
def test_pii_spans_are_source_offsets(text, surface, kind):
    found = pii.spans(text)
    assert [(text[a:b], k) for a, b, k in found] == [(surface, kind)]
    assert len(pii.suspects(pa.array([text, None]))) == 1
    assert pii.redact(text, found) == text.replace(surface, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at example.com now", "that is one two", "in 1999-2000, 12,000.50 and 3.14.15", "1234 5678 9012 3456", "dot dot dot", "", " "])
def test_pii_leaves_clean_texts_alone(text):
    assert pii.spans(text) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.,​①аＡ", max_size=40), st.sampled_from(["ann.b7@x.example.org", "+1 (222) 333-4444", "8.8.4.4"]), st.text(alphabet="xy ñ​٣", max_size=20))
def test_pii_maps_back_whatever_surrounds(before, secret, after):
    text = f"{before} {secret} {after}"
    assert secret not in pii.redact(text, pii.spans(text))


_PYTHON_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_SPACED = [
    "+33 6 12 34 56 78", "212 555 0187", "(212) 555 0187x", "+49 30 1234 567", "10 . 1 . 2 . 3", "10 dot 1 dot 2 dot 3", "10 [ dot ] 1 [ dot ] 2 [ . ] 3",
    "john.b at example.com", "john at example dot com", "john at example . com", "a.b19 [ at ] x.example.com", "five five five one two three four", "token = 2321bac4d15ec8f9",
]


@pytest.mark.parametrize("space", _PYTHON_SPACES, ids=lambda c: f"U+{ord(c):04X}")
def test_pii_suspects_with_every_space(space):
    texts = [t.replace(" ", space) for t in _SPACED]
    held = [t for t in texts if pii.spans(t)]
    assert len(held) >= 9 and len(pii.suspects(pa.array(held))) == len(held)


@pytest.mark.parametrize("text", ["10[.]1[.]2[.]3", "10_dot_1_dot_2_dot_3", "a.b1&COMMAT;x.example.com", "a.b1&#X40;x.example.com", "john.b at example[dot]com", "+๖๖ ๘๑ ๒๓๔ ๕๖๗๘", "paſſword: abcdefgh1"])
def test_pii_suspects_with_other_marks(text):
    assert pii.spans(text) and len(pii.suspects(pa.array([text]))) == 1


_BITS = ["1", "22", "333", "4444", "+", ".", "-", "(", ")", "[", "]", "at", "dot", "AT", "punkt", "_", "five", "ZWEI", "un", "x", "ann.b7", "example", "com", "@", ":", "token", "=", "DE89", "๓", *_PYTHON_SPACES, " ", " "]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(_BITS), max_size=24))
def test_pii_suspects_hold_every_text_with_spans(bits):
    text = "".join(bits)
    assert not pii.spans(text) or len(pii.suspects(pa.array([text]))) == 1


def test_pii_against_every_text_without_the_gate(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in table.select("doc_id", "text").collect():
        found = pii.spans(r.text or "")
        if found:
            want[r.doc_id] = (found, pii.redact(r.text, found))
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.text) for r in pii.detect(table).collect()}
    assert got == want and len(got) >= 40


def test_pii_in_spark(spark):
    table = docs(spark, [*ODD, (7, "write to a.b@c.example.com " * 3), (8, LONG + " z@y.example.com")])
    found = {r.doc_id: r for r in pii.detect(table).collect()}
    assert set(found) == {7, 8} and found[7].n_spans == 3 and "@" not in found[7].text
    assert found[8].spans[0].start == len(LONG) + 1
    kept = pii.redacted(table)
    assert kept.schema == table.schema and kept.count() == table.count()
    assert kept.where("text like '%@%'").isEmpty() and pii.redacted(table.limit(0)).isEmpty() and pii.detect(table.limit(0)).isEmpty()


# --- 2 nearest neighbours ----------------------------------------------------


def _exact(x, k):
    g = x @ x.T
    np.fill_diagonal(g, -np.inf)
    return g, np.sort(g, 1)[:, -k]


def test_ann_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 24))
    x = np.concatenate([rng.normal(size=(400, 24)), centers[rng.integers(0, 12, 400)] + 0.1 * rng.normal(size=(400, 24))]).astype(np.float32)
    x *= rng.uniform(0.5, 2, (len(x), 1)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = ann.neighbours(table).toPandas()
    g, least = _exact(x, 10)
    assert len(found) == 8000 and found.groupby("id")["rank"].nunique().eq(10).all()
    hit = g[found["id"], found["neighbour"]] >= least[found["id"]] - 1e-4
    assert hit.mean() >= 0.9
    assert np.allclose(g[found["id"], found["neighbour"]], found["score"], atol=1e-3)


def test_ann_queries_against_all_rows(spark):
    rng = np.random.default_rng(11)
    n = 10_000
    centers = rng.normal(size=(40, 32))
    x = np.where(np.arange(n)[:, None] % 2 == 0, rng.normal(size=(n, 32)), centers[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 32))).astype(np.float32)
    x[1::3] = x[1]  # a third of all rows are copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = ann.neighbours(table, queries=F.col("id") % 50 == 0).toPandas()
    asked = np.arange(0, n, 50)
    assert sorted(found["id"].unique()) == asked.tolist() and len(found) == 10 * len(asked)
    g = x[asked] @ x.T
    g[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(g, 1)[:, -10]
    got = g[found["id"] // 50, found["neighbour"]]
    assert np.allclose(got, found["score"], atol=1e-3) and (got >= least[found["id"] // 50] - 1e-4).mean() >= 0.9


def test_ann_copies_cost_what_one_row_does(spark):
    table = spark.range(50_000).selectExpr("id as vec_id", "array(cast(1.0 as float), cast(if(id % 50 = 49, 2.0, 0.5) as float)) as embedding")
    found = ann.neighbours(table, queries=F.col("id") % 500 == 0).toPandas()
    assert len(found) == 1000 and found.groupby("id")["neighbour"].apply(list).map(lambda x: x == [49 + 50 * i for i in range(10)]).all()
    found = ann.neighbours(table, queries=F.col("id").isin(49, 99, 49_999)).toPandas()
    for i in (49, 99, 49_999):
        want = [x for x in range(49, 50_000, 50) if x != i][:10]
        assert found[found["id"] == i].sort_values("rank")["neighbour"].tolist() == want


def test_ann_large_partitions_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.01 + 3, rng.normal(size=(100, 8))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = ann.neighbours(table, k=5).toPandas()
    g, least = _exact(x, 5)
    assert len(found) == 2000 and (g[found["id"], found["neighbour"]] >= least[found["id"]] - 1e-4).mean() >= 0.9


def test_ann_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [0.5, 0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0, 1.0]), (6, [None, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as row", "2 as part")
    found = ann.neighbours(table, k=2).collect()
    assert {r.id for r in found} == {1, 2, None, 7} and len(found) == 10
    one = sorted((r.rank, r.neighbour, r.score) for r in found if r.id == 1)
    assert one == [(1, 2, 1.0), (2, 2, 1.0)]
    assert ann.neighbours(table.limit(0)).isEmpty() and ann.neighbours(table.where("vec_id = 8")).isEmpty()
    assert ann.neighbours(table.where("vec_id = 1")).isEmpty()


def test_anisotropic_codes_lower_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    books = rng.normal(size=(4, 16, 2)).astype(np.float32)
    plain, skewed = (np.abs(ann.encode(x, unit, books, eta)[1].sum(1)).mean() for eta in (1.0, 8.0))
    assert skewed < plain
    q = rng.normal(size=(2, 8)).astype(np.float32)
    code, _ = ann.encode(x, unit, books, 1.0)
    lut = ann.tables(q, books)
    packed = code[:, 0::2] * 16 + code[:, 1::2]
    scanned = sum(lut[b][:, packed[:, b]] for b in range(2))
    rebuilt = np.stack([books[j][code[:, j]] for j in range(4)], 1).reshape(300, 8)
    assert np.allclose(scanned, q @ rebuilt.T, atol=1e-4)


# --- 3 Merkle trees ----------------------------------------------------------


def test_merkle_locates_edits(spark):
    base = [f"paragraph number {i} of the text" for i in range(100)]
    edited = [*base[:3], "a new one", *base[4:96], "another", *base[97:]]
    longer = [*base[:10], "put in", "and this", *base[10:]]
    moved = [*base[50:], *base[:50]]
    rows = [(10, "\n".join(base)), (11, "\n\n".join(base)), (12, "\n".join(edited)), (13, "\n".join(longer)), (14, "alone"), (15, "\n".join(["first", *base])), (16, "\n".join(moved)), (17, "\n".join([*base, base[0], base[0]])), *ODD]
    got = {}
    for r in merkle.compare(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    said = lambda i: tuple(got[i][x] for x in ("base_id", "equal", "removed", "added", "removed_at", "added_at"))
    assert said(11) == (10, True, 0, 0, "", "") and got[11].root == got[10].root and got[11].sections_changed == 0
    assert said(12) == (10, False, 2, 2, "4,97", "4,97") and 0 < got[12].sections_changed <= 3 < got[12].n_sections
    assert said(13) == (10, False, 0, 2, "", "11-12") and said(15) == (10, False, 0, 1, "", "1") and said(16)[:4] == (10, False, 0, 0)
    assert said(17) == (10, False, 0, 2, "", "101-102")
    assert said(10) == said(14) == (None,) * 6 and got[14].sections_changed is None
    assert got[1].root == got[2].root == got[3].root and got[1].n_paragraphs == 0 and said(2)[:2] == said(3)[:2] == (1, True) and said(1) == (None,) * 6
    assert said(5)[:2] == (4, True) and said(4) == (None,) * 6
    assert merkle.compare(docs(spark, rows)).count() == len(rows) and merkle.compare(docs(spark, []).limit(0)).isEmpty()


def test_merkle_sql_on_odd_rows(spark):
    base = [f"paragraph {i}" for i in range(60)]
    rng, rows = random.Random(4), [*ODD, (None, "\n".join(base)), (20, "\n".join(base)), (20, "\n".join(base[:30]))]
    for i in range(40):
        own = [rng.choice(base) if rng.random() < 0.1 else x for x in base if rng.random() > 0.05]
        rows.append((21 + i % 25, "\n".join(own)))
    table = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    found = con.execute(merkle.COMPARE_SQL)
    names = [x[0] for x in found.description]
    got = merkle.compare(table).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def test_merkle_nearest_does_not_need_the_first_paragraph(spark):
    base = [f"paragraph number {i} of the text" for i in range(40)]
    rows = [
        (10, "\n".join(base)), (11, "\n".join(["another start", *base[1:]])), (12, "\n".join(["put before", *base])), (13, "\n".join(base[1:])),
        (14, "alone"), (15, "\n".join([base[0], "and nothing", "else of it"])), (16, "\n\n".join(base)), (17, "alone\nanother start\n" + "\n".join(base[1:])), *ODD, (None, "alone")
    ]
    got = {(r.doc_id, r.n_paragraphs): (r.base_id, r.shared, r.equal) for r in merkle.nearest(docs(spark, rows)).collect()}
    assert got[11, 40] == (10, 39, False) and got[12, 41] == (10, 40, False) and got[13, 39] == (10, 39, False)
    assert got[10, 40] == (None, None, None) and got[14, 1] == (None, None, None) and got[15, 3] == (10, 1, False)
    assert got[16, 40] == (10, 40, True) and got[17, 41] == (10, 39, False)  # most of its paragraphs are first in 10
    assert got[2, 0] == got[3, 0] == (1, 0, True) and got[1, 0] == got[4, 1] == (None, None, None) and got[5, 1] == (4, 1, True)
    found = merkle.nearest(docs(spark, rows))
    assert found.count() == len(rows) and merkle.nearest(docs(spark, []).limit(0)).isEmpty()
    assert {r.base_id for r in found.where("doc_id is null and base is not null").collect()} == {14}


def test_merkle_lists_every_edit(spark):
    base = [f"paragraph number {i} of the text" for i in range(300)]
    edited = [*base[:5], "a new one", *base[6:150], *base[152:290], "put in", "and this", *base[290:]]
    rows = [(10, "\n".join(base)), (11, "\n".join(edited)), (12, "\n".join(["before", *base])), (13, "\n\n".join(base)), (14, "alone"), *ODD]
    got = {r.doc_id: r for r in merkle.revisions(docs(spark, rows)).collect()}
    assert [tuple(e) for e in got[11].edits] == [(6, 1, 1), (151, 2, 0), (289, 0, 2)]
    assert 0 < got[11].sections_changed < got[11].n_sections / 2 and got[11].base_id == 10
    assert [tuple(e) for e in got[12].edits] == [(1, 0, 1)] and got[13].edits == [] and got[13].equal
    assert got[14].edits is None and got[14].base_id is None
    assert merkle.revisions(docs(spark, rows)).count() == len(rows) and merkle.revisions(docs(spark, []).limit(0)).isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("0a 1b c d e".split()), max_size=14), st.lists(st.sampled_from("0a 1b c d e".split()), max_size=14))
def test_merkle_edits_rebuild_the_document(old, new):
    def cut(leaves):
        out, part = [], []
        for h in leaves:
            part.append(h)
            if h[0] in "01":
                out, part = [*out, ",".join(part)], []
        return [*out, ",".join(part)] if part else out

    _, runs = merkle.align(cut(old), cut(new))
    made, used = [], 0
    for first, removed, added in runs:
        keep = first - 1 - len(made)
        made, used = [*made, *old[used : used + keep], *new[first - 1 : first - 1 + added]], used + keep + removed
    assert [*made, *old[used:]] == new


# --- 4 sharding --------------------------------------------------------------


def test_sharding_moves_only_where_weights_change(spark):
    table = spark.range(6000).withColumnRenamed("id", "doc_id")
    rows = sharding.moves(table, registry.BEFORE, registry.AFTER).toPandas()
    moved = rows[rows["moved"]]
    assert (moved["region"] == moved["new_shard"].str.split("/").str[0]).all() and 0 < len(moved) < 0.15 * len(rows)
    at_rack = moved[moved["rack"] != moved["new_shard"].str.rpartition("/")[0]]
    assert at_rack["new_shard"].str.startswith("eu/r2/").all()
    inside = moved[moved["rack"] == moved["new_shard"].str.rpartition("/")[0]]
    assert (inside["shard"] == "us/r1/s3").all() and not (rows["new_shard"] == "us/r1/s3").any()
    share = rows["region"].value_counts(normalize=True)
    assert abs(share["us"] - 3 / 6) < 0.03 and abs(share["ap"] - 1 / 6) < 0.03


def test_sharding_odd_rows(spark):
    table = docs(spark, ODD).withColumn("region", F.lit("old"))
    out = sharding.assign(table, registry.BEFORE).collect()
    assert len(out) == len(ODD) and all(r.shard.startswith(r.rack + "/") and r.rack.startswith(r.region + "/") for r in out)
    assert len({r.shard for r in out if r.doc_id == 4}) == 1
    assert sharding.moves(table.limit(0), registry.BEFORE, registry.AFTER).isEmpty()
    with pytest.raises(ValueError, match="no positive weight"):
        sharding.nodes({"a": (0.0, {})})


# --- 5 reply trees -----------------------------------------------------------


def _brute_paths(nodes):
    parent = {n: p for n, p, _ in nodes}
    score = {n: s for n, _, s in nodes}
    out = []
    for leaf in set(parent) - {p for p in parent.values() if p in parent}:
        way, at = [], leaf
        while at in parent and at not in way:
            way.append(at)
            at = parent[at]
        if at not in parent:
            out.append((sum(score[n] for n in way) / len(way), leaf, way[::-1]))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for tree in range(5):
        nodes = [(n, rng.randrange(n) if n and rng.random() < 0.95 else None, rng.randrange(50)) for n in range(30)]
        want[tree] = _brute_paths(nodes)[:3]
        rows += [(tree, n, p, "user", f"m{n}", s) for n, p, s in nodes]
    table = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score int")
    got = {}
    for r in chat.conversations(table).collect():
        got.setdefault(r.tree, {})[r.branch] = (r.score, r.leaf, [int(x) for x in re.findall(r"\nm(\d+)<", r.text)])
    for tree, ways in want.items():
        assert [got[tree][i + 1] for i in range(len(ways))] == ways


def test_chat_odd_messages(spark):
    rows = [
        (1, 1, None, "user", "hi", 1), (1, 1, None, "user", "again", 5), (1, 2, 1, None, None, None), (1, 3, 99, "assistant", "<|im_end|> trick", 1),
        (2, 1, 2, "user", "a", 1), (2, 2, 1, "user", "b", 1), (2, 3, 2, "user", "below a cycle", 1), (2, 4, 4, "user", "self", 1),
        (None, 1, None, "user", "x", 1), (3, None, None, "user", "x", 1), (4, 1, None, "user", LONG, 1),
    ]
    table = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score int").selectExpr("*", "1 as dist", "2 as leaf")
    got = {(r.tree, r.leaf): r.text for r in chat.conversations(table).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 1)}
    assert got[1, 2] == "<|im_start|>user\nagain<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[1, 3].count("<|im_end|>") == 1 and LONG in got[4, 1]
    assert chat.conversations(table.limit(0)).isEmpty()
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b" * 9), (1, 2, "user", "c"), (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert _numbered(chat.reply_trees(turns).collect()) == {(1, None), (2, 1), (3, 1), (4, 3)}


def _numbered(rows):
    """(node, parent), nodes numbered from 1 in their order."""
    number = {n: i for i, n in enumerate(sorted(r.node for r in rows), 1)} | {None: None}
    return {(number[r.node], number[r.parent]) for r in rows}


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_chat_trees_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(12), rng.choice(["user", "user", "assistant", "tool"]), rng.choice("abcd") * rng.randrange(1, 40)) for _ in range(120)]
    want = {}
    for conv in (1, 2, 3):
        parent, start = {}, None
        own = sorted((t, r, x) for c, t, r, x in rows if c == conv)
        for i, m in enumerate(own):
            start = i - 1 if i and own[i - 1][1] != m[1] else start
            parent[i + 1] = None if start is None else start + 1
        want[conv] = set(parent.items())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        found = chat.reply_trees(table).collect()
        assert parts < 8 or len({r.node >> 33 for r in found}) > 5
        for conv in want:
            assert _numbered([r for r in found if r.tree == conv]) == want[conv]
            assert [r.score for r in sorted(found, key=lambda r: r.node) if r.tree == conv] == [len(x) for c, _, _, x in sorted(rows) if c == conv]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chat_deep_chain(spark):
    n = 300
    table = spark.range(n).selectExpr("1 as tree", "id as node", "nullif(id - 1, -1) as parent", "'user' as role", "'x' as text", "1 as score")
    assert [(r.leaf, r.n_messages) for r in chat.conversations(table).collect()] == [(n - 1, n)]


# --- 6 pieces ----------------------------------------------------------------

_ODD_TEXTS = ["", " ", "  a   b\n\tc 東xyz☃  ", "x" * 1500, "  " * 60 + "the the", "東京都" * 200, "a b " * 400, "\U0001f600 é"]


def _score(m, ids):
    lib = m.library
    return sum(lib.get_score(i) if not lib.is_byte(i) else 0.0 for i in ids)


def test_scan_equals_the_library_and_round_trips():
    m = pieces.model(pieces.MODEL)
    for text in _ODD_TEXTS:
        a, b = pieces.scan(m, text, 61), pieces.encode_batch(m, [text])[0].tolist()
        assert m.library.decode(a) == text == m.library.decode(b)
        assert _score(m, a) == pytest.approx(_score(m, b)) or len(text) > pieces.RUN


def test_scan_gives_the_ids_of_the_library(spark):
    m = pieces.model(pieces.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert len(texts) == 200
    for text in texts:
        ids = pieces.encode_batch(m, [text])[0].tolist()
        assert pieces.scan(m, text) == ids
        # chunks may end inside of equal segmentations, and choose another of these
        assert _score(m, pieces.scan(m, text, 509)) == pytest.approx(_score(m, ids))


def test_giants_give_the_ids_of_small_texts(spark):
    rows = [(i, t) for i, t in enumerate(["ab\u2581c d " * 90, "\U0001f600é x\n" * 300, LONG[:9000], "y" * 4096, "the " * 1024])]
    small, giant = ({r.doc_id: r.ids for r in pieces.encode(docs(spark, rows), giant=g, chunk=64).collect()} for g in (1 << 20, 1))
    m = pieces.model(pieces.MODEL)
    assert all(_score(m, small[i]) == pytest.approx(_score(m, giant[i])) and m.library.decode(giant[i]) == m.library.decode(small[i]) for i, _ in rows)
    with pytest.raises(ValueError, match="longest piece"):
        pieces.encode(docs(spark, rows), chunk=4)


def test_models_that_normalise_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="normalise"):
        pieces.Model(str(tmp_path / "m.model"))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="thean dog東\n ☃", max_size=120), st.sampled_from([17, 40, 1000]))
def test_chunks_do_not_change_the_best_score(text, chunk):
    m = pieces.model(pieces.MODEL)
    whole, cut = pieces.scan(m, text, 4096), pieces.scan(m, text, chunk)
    assert _score(m, whole) == pytest.approx(_score(m, cut)) and m.library.decode(cut) == text


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.integers(-9, 9, (4, 4))) for _ in range(3))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_pieces_in_spark(spark):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(_ODD_TEXTS))]
    out = pieces.decode(pieces.encode(docs(spark, rows), giant=1000, chunk=200)).collect()
    assert len(out) == len(rows)
    texts = sorted((r.text is not None, r.text or "") for r in out)
    assert texts == sorted((t is not None, t or "") for _, t in rows)
    trips = pieces.round_trips(docs(spark, rows)).collect()
    assert all(r.same for r in trips if r.doc_id != 1) and [r.ids for r in trips if r.doc_id == 1] == [None]
    assert pieces.round_trips(docs(spark, []).limit(0)).isEmpty()


# --- 7 and 9: classifiers ----------------------------------------------------


def _labelled(spark, n=600):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "lo ra mi tu ne sa".split() for b in "ken dor vim tal pes".split()]
    rows, marks = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))).capitalize() + "."
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            parts = text.split(" ")
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "grobbly", "scum", "moron"]))
            text = " ".join(parts)
        if bad:
            text = " ".join(w + rng.choice(["***", "$$$", "###"]) for w in text.split(" "))
        rows.append((i, text))
        marks.append((i, 0 if bad else 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), rows, marks


def test_toxicity_on_held_out_documents(spark):
    table, labels, _, marks = _labelled(spark)
    seen = labels.where("doc_id % 2 = 0")
    p = {r.doc_id: r for r in toxicity.classify(table, seen).collect()}
    held = [(p[i].is_toxic, bool(t)) for i, _, t in marks if i % 2]
    assert np.mean([a for a, t in held if t]) >= 0.9 and np.mean([a for a, t in held if not t]) <= 0.02
    assert all(0 <= r.p_toxic <= 1 for r in p.values())


def test_quality_on_held_out_documents(spark):
    table, labels, _, marks = _labelled(spark)
    p = {r.doc_id: r for r in quality.classify(table, labels.where("doc_id % 2 = 0")).collect()}
    held = [(p[i].keep, q) for i, q, _ in marks if i % 2]
    assert np.mean([k for k, q in held if q == 1]) >= 0.95 and np.mean([k for k, q in held if q == 0]) <= 0.1


def test_quality_holds_out_the_same_positives_at_every_size(spark, monkeypatch):
    table, labels, _, marks = _labelled(spark, 300)
    n, seen, prior = sum(q for _, q, _ in marks), [], quality.best_bin_prior
    monkeypatch.setattr(quality, "best_bin_prior", lambda p, u: seen.append(p.sum()) or prior(p, u))
    for sample in (n - 1, n, 8000):
        quality.classify(table, labels, sample)
    assert len(set(seen)) == 1 and n / 8 < seen[0] < n / 2


def test_quality_risk_is_of_all_documents(spark):
    rng = np.random.default_rng(1)
    good, junk, rare = rng.normal(0, 1, (200, 4)), rng.normal(3, 1, (300, 4)), rng.normal([0, 0, 9, -9], 0.5, (15, 4))
    everything = np.concatenate([good, junk, rare])
    # a start on documents among which the rare kind isn't
    net = quality.fit(good, np.concatenate([good, junk]), 0.4, steps=150)
    rows = spark.createDataFrame([([1.0, *map(float, v)],) for v in everything], "x array<float>").repartition(3)
    end, risks = quality.refine(net, good, rows, 0.4)

    def risk(n):
        (_, u, *_), (_, p, *_) = quality.loss_sums(n, everything), quality.loss_sums(n, good)
        u, p = u / len(everything), p / len(good)
        return 0.4 * (1 - p) + max(0, u - 0.4 * p) + 5e-4 * sum((n.w[i] ** 2).sum() for i in (0, 2))

    assert len(risks) == quality.PASSES + 1 and risks[0] == pytest.approx(risk(net), abs=1e-6)
    assert risk(end) == pytest.approx(min(risks), abs=1e-6) and risk(end) < risk(net)
    assert end.score(rare).mean() < net.score(rare).mean()
    # the summed gradient is that of the loss
    base, at = quality.loss_sums(net, everything), 2
    for i, v in enumerate(net.w):
        moved = quality.Net(net.mean, net.scale, [w.copy() for w in net.w])
        moved.w[i].flat[0] += 1e-5
        assert (quality.loss_sums(moved, everything)[1] - base[1]) / 1e-5 == pytest.approx(base[at], rel=1e-2, abs=1e-3)
        at += v.size


def test_classifiers_odd_rows(spark):
    table, labels, rows, _ = _labelled(spark, 120)
    more = table.unionByName(docs(spark, ODD))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 7, 9), (5, 1, 0)], "doc_id bigint, quality int, toxic int"))
    for made in (toxicity.classify(more, odd), quality.classify(more, odd)):
        assert made.count() == len(rows) + len(ODD)
    kept = toxicity.keep_clean(more, odd)
    assert kept.schema == more.schema and kept.where("doc_id = 1 and text is null").count() == 1
    good = quality.keep_good(more, odd)
    assert good.schema == more.schema and good.where("text is null").isEmpty()
    nothing = labels.limit(0)
    assert toxicity.keep_clean(more, nothing).count() == more.count()
    assert {r.doc_id for r in quality.keep_good(docs(spark, ODD), nothing).collect()} == {None, 4, 5, 6}
    assert toxicity.keep_clean(more.limit(0), odd).isEmpty() and quality.keep_good(more.limit(0), odd).isEmpty()


def test_best_bin_prior():
    rng = np.random.default_rng(2)
    pos, neg = rng.beta(6, 2, 20000), rng.beta(2, 6, 20000)
    mixed = np.concatenate([pos[:6000], neg[:14000]])
    hist = lambda v: np.histogram(v, 400, (0, 1))[0].astype(float)
    assert abs(quality.best_bin_prior(hist(pos), hist(mixed)) - 0.3) < 0.05


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = toxicity.boost(x[:600], y[:600])
    assert ((forest.margin(x[600:]) > 0) == (y[600:] > 0)).mean() > 0.9
    xs, ys = toxicity.isotonic(forest.margin(x[600:]), y[600:], np.ones(200))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()


# --- 8 packing ---------------------------------------------------------------


def _brute_two_fit(lengths, capacity):
    """The same rule by search over a plain list."""
    pool, out = sorted(lengths, reverse=True), []
    while pool:
        bin_, gap = [], capacity
        for n in list(pool):
            if n <= gap:
                bin_.append(n)
                pool.remove(n)
                gap -= n
        if gap:
            least = bin_[-1]
            pairs = [(a + b, max(a, b)) for a, b in itertools.combinations(pool, 2) if least < a + b <= least + gap]
            if pairs:
                total, a = max(pairs)
                bin_[-1:] = [a, total - a]
                pool.remove(a)
                pool.remove(total - a)
                pool = sorted([*pool, least], reverse=True)
        out.append(sorted(bin_, reverse=True))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25))
def test_two_fit_against_brute_force(lengths):
    assert packing.pack(np.array(lengths, np.int64), 20) == _brute_two_fit(lengths, 20)


def test_two_fit_replaces_a_lone_piece():
    assert packing.pack(np.array([5000, 4100, 4000]), 8192) == [[4100, 4000], [5000]]
    assert packing.pack(np.array([70, 50, 45]), 100) == [[50, 45], [70]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25), st.integers(0, 5))
def test_two_fit_leaves_room_for_separators(lengths, separator):
    made = packing._packed(20, separator, False)(pa.table({"doc_id": pa.array(range(len(lengths)), pa.int64()), "start": pa.array([0] * len(lengths), pa.int32()), "length": pa.array(lengths, pa.int32()), "grp": pa.array([0] * len(lengths), pa.int64())}))
    assert sorted(n for r in made["lengths"].to_pylist() for n in r) == sorted(lengths)
    assert all(u == sum(n) + separator * (len(n) - 1) <= 20 for u, n in zip(made["used"].to_pylist(), made["lengths"].to_pylist()))


def test_packing_by_a_length_column(spark):
    table = docs(spark, [*ODD, (9, "x")]).withColumn("tokens", F.expr("case doc_id when 4 then 700 when 5 then 1500 when 9 then -1 when 6 then null else 0 end"))
    out = packing.sequences(table, capacity=1000, length_col="tokens").collect()
    assert sorted((i, s, n) for r in out for i, s, n in zip(r.doc_ids, r.starts, r.lengths)) == [(4, 0, 700), (4, 0, 700), (5, 0, 1000), (5, 1000, 500)]
    with pytest.raises(ValueError, match="exclude"):
        packing.sequences(table, length_col="tokens", keep_text=True)


def test_packing_in_spark(spark):
    rows = [*ODD, *((100 + i, "z" * (1 + i * 37 % 900)) for i in range(300)), (99, "é\n\U0001f600" * 900)]
    table = docs(spark, rows)
    out = packing.sequences(table, capacity=1000, group=20_000, keep_text=True).collect()
    parts = [(i, s, n, t) for r in out for i, s, n, t in zip(r.doc_ids, r.starts, r.lengths, r.texts)]
    assert all(r.used == sum(r.lengths) <= 1000 for r in out) and len({r.seq_id for r in out}) == len(out)
    assert all(len(t) == n for *_, n, t in parts) and sum(n for _, _, n, _ in parts) == sum(len(t or "") for _, t in rows)
    assert "".join(t for _, t in sorted((s, t) for i, s, _, t in parts if i == 6)) == LONG
    assert sum(i == 4 for i, *_ in parts) == 2 and {i for i, *_ in parts} == {i for i, t in rows if t}
    assert packing.sequences(table.limit(0)).isEmpty()
    lone = packing.sequences(table, capacity=1000).collect()
    assert sum(len(r.doc_ids) for r in lone) == len(parts)


# --- 10 near duplicates ------------------------------------------------------


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def _near_rows():
    rows = []
    for g in range(12):
        base = _words(120, g)
        rows.append((g * 10, " ".join(base)))
        for k in (1, 2, 3):
            copy = list(base)
            for j in random.Random(g * 7 + k).sample(range(len(copy)), k):
                copy[j] = "changed"
            rows.append((g * 10 + k, " ".join(copy)))
    return rows


def test_neardup_groups_against_brute_force(spark):
    rows = _near_rows()
    got = {r.doc_id: (r.group_id, r.keep) for r in neardup.groups(docs(spark, rows)).collect()}
    assert all(got[i] == (i // 10 * 10, i % 10 == 0) for i, _ in rows)


def _chain_rows():
    """Texts of which neighbours are near and the ends aren't, in one run and next to strangers."""
    words = _words(400, 77)
    chain = [(200 + k, " ".join(words[40 * k : 40 * k + 160])) for k in range(6)]
    return [*chain, (300, "nothing like the rest of these texts at all"), (301, chain[0][1].upper() + "!")]


def _brute_links(spark, rows):
    """Links of different texts by holding all sketches against each other."""
    sig = {r.node: np.array([r[s] for s in neardup.SKETCH]).view(np.uint64) for r in neardup.signatures(docs(spark, rows)).where("node is not null").collect()}
    most, nodes = neardup.most_differing(neardup.THRESHOLD), sorted(sig)
    return {(a, b) for a in nodes for b in nodes if a < b and np.bitwise_count(sig[a] ^ sig[b]).sum() <= most}


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_neardup_loses_no_link_of_a_bucket(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (4, len(neardup.SKETCH)), dtype=np.uint64)
    flip = lambda v, k: v ^ np.array([np.uint64(1) << np.uint64(i) if i < k else 0 for i in range(8)], np.uint64)
    rows = [flip(base[i % 4], k) for i in range(4) for k in range(3)] + [rng.integers(0, 2**63, 8, dtype=np.uint64) for _ in range(5)]
    # a chain: each has more flipped bits than the one before, by less than the bound
    most = neardup.most_differing(neardup.THRESHOLD)
    chain = np.zeros(512, np.uint8)
    for k in range(6):
        chain[: k * (most - 5)] = 1
        rows.append(np.packbits(chain, bitorder="little").view(np.uint64) ^ base[0])
        chain[:] = 0
    for repeat in (1, 5):  # small groups and large ones take different ways
        sketch = np.array(rows * repeat, np.uint64)
        near = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2) <= most
        want = neardup._forest(len(sketch), *np.nonzero(near))
        for got in (neardup.connected(sketch, most, 4), *([neardup._forest(len(sketch), *x) for x in neardup._small(np.array([len(sketch)]), np.array([0]), sketch, most)] if repeat == 1 else [])):
            assert [x.tolist() for x in neardup._forest(len(sketch), *got)] == [x.tolist() for x in want]
    nodes = [(i, [7, 100 + i % 3], *map(int, r.view(np.int64))) for i, r in enumerate(np.array(rows, np.uint64))]
    table = spark.createDataFrame(nodes, "node bigint, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in neardup.SKETCH))
    near = np.bitwise_count(np.array(rows)[:, None] ^ np.array(rows)[None]).sum(2) <= most
    comp = {r.node: r.root for r in neardup.components(neardup.candidate_edges(table, block=block)).collect()}
    root, row = neardup._forest(len(rows), *np.nonzero(near))
    assert comp == dict(zip(row.tolist(), root.tolist()))
    got = {r.node: r.n_links for r in neardup.links(table, spark.createDataFrame(list(comp.items()), "node bigint, root bigint"), block=block).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in {*comp, *comp.values()}}


def test_neardup_chains_and_links_against_brute_force(spark):
    rows = [*_near_rows(), *_chain_rows()]
    found = neardup.groups(docs(spark, rows)).collect()
    edges, node = _brute_links(spark, rows), {r.doc_id: r.node for r in neardup.signatures(docs(spark, rows)).collect()}
    degree = {n: sum(n in e for e in edges) for n in node.values()}
    got = {r.doc_id: r for r in found}
    assert {i: r.n_links for i, r in got.items()} == {i: degree[n] for i, n in node.items()}
    # the ends of the chain are no links, and in one group
    assert (min(node[200], node[205]), max(node[200], node[205])) not in edges and {got[200 + k].group_id for k in range(6)} == {200}
    assert got[301].group_id == 200 and got[301].n_links == got[200].n_links and got[300].group_id == 300 and got[300].n_links == 0
    # all pairs of these texts by their exact Jaccard similarity
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows if (w := re.findall(r"[a-z]+", t.lower()))}
    for i, a in grams.items():
        for j, b in grams.items():
            if i < j and len(a & b) / len(a | b) >= 0.6:
                assert got[i].group_id == got[j].group_id


def test_neardup_recall_from_the_threshold_up():
    rng, n = np.random.default_rng(6), 300
    most = neardup.most_differing(neardup.THRESHOLD)
    texts, exact = [], []
    for k in range(2 * n):
        # a run of the base, of varied length, before new words: the pair shares its shingles
        base = [f"a{k}x{i}" for i in range(200)]
        keep = int(rng.integers(136, 162)) if k < n else int(rng.integers(85, 110))
        other = [*base[:keep], *(f"b{k}x{i}" for i in range(200 - keep))]
        texts += [" ".join(base), " ".join(other)]
        exact.append((keep - 2) / (2 * 198 - (keep - 2)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "t": pa.array(range(len(texts)), pa.int64()), "text": texts})
    sig = pa.Table.from_batches(list(neardup._signatures(iter([batch]))))
    bands = np.array(sig["bands"].to_pylist())
    sketch = np.stack([sig[s].to_numpy() for s in neardup.SKETCH], 1).view(np.uint64)
    found = (bands[0::2] == bands[1::2]).any(1) & (np.bitwise_count(sketch[0::2] ^ sketch[1::2]).sum(1) <= most)
    exact = np.array(exact)
    near = (exact >= 0.5) & (exact < 0.7)
    assert near.sum() >= 250 and found[near].mean() >= 0.9 and found[(exact >= 0.5) & (exact < 0.55)].mean() >= 0.85
    assert found[exact < 0.35].mean() <= 0.1


def test_neardup_odd_rows(spark):
    table = docs(spark, [*ODD, (7, "Same TEXT, in two: rows!"), (8, "hi"), (9, "Hi."), (20, LONG + " more")])
    got = neardup.groups(table).collect()
    assert len(got) == table.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.keep for r in by[1] + by[2] + by[3]] == [True] * 3
    assert sorted(r.keep for i in (4, 5, 7) for r in by[i]) == [False, False, False, True] and all(r.group_id == 4 for r in by[4])
    assert by[9][0].group_id == 8 and by[20][0].group_id == 6
    kept = neardup.deduplicate(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 6, 8]))
    assert neardup.deduplicate(table.limit(0)).isEmpty() and neardup.groups(table.limit(0)).isEmpty()


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, (50, neardup.BINS), dtype=np.uint64)
    for share in (0.95, 0.8, 0.6):
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 2**63, a.shape, dtype=np.uint64))
        differ = np.bitwise_count(neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).sum(1)
        true = (a == b).mean(1)
        assert abs(neardup.similarity(differ) - true).mean() < 0.04


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)


# --- kernels -----------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é–  9Z", max_size=12)), max_size=6))
def test_word_runs_and_hashes(texts):
    want = [[w.encode() for w in re.findall(r"[0-9A-Za-zé]+", t or "")] for t in texts]
    got = [[] for _ in texts]
    for lo, _, b, off in textkit.slices(pa.array(texts, pa.string())):
        start, end, doc = textkit.runs(textkit.word_mask(b) if len(b) else np.zeros(0, bool), off)
        h = textkit.Hasher(b).of(start, end)
        for s, e, d, v in zip(start, end, doc, h):
            got[lo + d].append(b[s:e].tobytes())
            assert textkit.hash_words([b[s:e].tobytes().decode()])[0] == v
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_hashes_do_not_depend_on_stretches(sizes, stretch):
    b = np.random.default_rng(len(sizes)).integers(0, 256, sum(sizes) + len(sizes), dtype=np.uint8)
    start = np.cumsum([0, *sizes])[:-1] + np.arange(len(sizes))
    end = start + np.array(sizes, np.int64)
    start = start.astype(np.int64)
    whole, old = textkit.Hasher(b).of(start, end), textkit.STRETCH
    textkit.STRETCH = stretch
    try:
        assert textkit.Hasher(b).of(start, end).tolist() == whole.tolist()
    finally:
        textkit.STRETCH = old
    assert [textkit.Hasher(b[x:y]).of(np.array([0]), np.array([y - x]))[0] for x, y in zip(start, end)] == whole.tolist()


def test_very_long_texts_in_little_memory():
    import resource

    words = "some words of a very long text that goes on and on. " * 400_000  # 20 MB, and a word of 6 MB
    texts = pa.array([words + "x" * 6_000_000, "short text", None], pa.large_string())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x, y = quality.features(texts), toxicity.features(texts, toxicity.Lexicon())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), texts], ["doc_id", "t", "text"])
    sig = list(neardup._signatures(iter([batch])))
    assert x[0, 0] == 12 * 400_000 + 1 and len(y) == 3 and sum(b.num_rows for b in sig) == 3
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_600_000  # KB: some 60 bytes a byte of the longest text


def test_registry_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES] == [str(i) for i in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
