"""MinHash near-duplicates verified with odd sketches.

Every document becomes ``BINS`` MinHash samples (one-permutation hashing with
optimal densification) of its three-word shingles.  ``BANDS`` bands of
``ROWS`` samples give candidate buckets; an odd sketch, the samples folded
into a bitmap of ``BITS`` parities, verifies them: the population count of
the XOR of two sketches estimates the number of samples that differ.

Texts of equal words are one node, however many copies there are.  Within a
bucket every node is held against every other that isn't yet connected to it,
so no verified link between different texts of a bucket is lost, and edges are
put out that span what is connected instead of all its pairs.  A bucket of more
than ``BLOCK`` nodes is dealt to many workers as pairs of blocks.  Edges are
joined to groups by alternating large-star and small-star steps.

Within a group all pairs of nodes are counted, in blocks as well: ``n_links``
is the number of other texts of the group whose sketches verify with a row's own.

Defined results: texts are compared as lower-cased words, so case, punctuation
and white space don't count.  Equal word sequences always share a group.
Documents without a word (null, empty, blanks) and each row with a null text
are groups of their own.  A document of one or two words is one shingle.
Repeated rows are copies like any others.  The representative of a group is its
lowest (doc_id, text hash), null ids last; of several such rows one is kept.
Copies share their number of links and aren't links of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import textkit as tk
from docloom.llm.common import materialize

BINS, BANDS, ROWS, BITS = 256, 64, 4, 512
THRESHOLD = 0.5
#: The sketch's estimate may fall this much short of the threshold, so that pairs just over it pass.
SLACK = 0.08
#: Nodes of a bucket or group that one worker holds against each other at a time.
BLOCK = 8192
SKETCH = [f"s{i}" for i in range(BITS // 64)]
_SIG = "doc_id bigint, t bigint, node bigint, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCH)


def shingles(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of three-word shingles, the document of each, and a hash of each document's words (0: none)."""
    n = len(off) - 1
    start, end, doc = tk.runs(tk.word_mask(b) if len(b) else np.zeros(0, bool), off)
    w = tk.Hasher(b).of(start, end)
    words = np.bincount(doc, minlength=n)[:n]
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    up, _ = tk.powers(len(w) + 1)
    pos = np.arange(len(w)) - first[doc]
    content = np.zeros(n, np.uint64)
    if len(w):
        np.add.at(content, doc, w * up[pos])
    content = np.where(words > 0, tk.mix(content + words.astype(np.uint64)), 0)
    a, c = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    full = np.flatnonzero((pos + 2 < words[doc]) if len(w) else np.zeros(0, bool))
    s = tk.mix(w[full] * a + w[full + 1] * c + w[full + 2]) if len(full) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words > 0) & (words < 3))
    return np.concatenate([s, content[short]]), np.concatenate([doc[full], short]), content


def minhash(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x BINS samples; rows of documents without shingles are all ones."""
    none = np.uint64(2**64 - 1)
    out = np.full(n * BINS, none, np.uint64)
    np.minimum.at(out, doc * BINS + (h >> np.uint64(56)).astype(np.int64) % BINS, tk.mix(h))
    out = out.reshape(n, BINS)
    filled = out != none
    todo = np.flatnonzero(filled.any(1) & ~filled.all(1))
    if len(todo):
        source, ok = out[todo], filled[todo]
        row, gap = np.nonzero(~ok)
        attempt = 0
        while len(row):
            attempt += 1
            pick = (tk.mix(gap.astype(np.uint64) * np.uint64(20_011) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
            hit = ok[row, pick]
            out[todo[row[hit]], gap[hit]] = source[row[hit], pick[hit]]
            row, gap = row[~hit], gap[~hit]
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """n x BITS/64 words of parities."""
    n = len(samples)
    bit = (tk.mix(samples + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BITS
    parity = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def similarity(differing: np.ndarray | int) -> np.ndarray:
    """Estimated Jaccard similarity from the population count of the XOR."""
    z = np.minimum(np.asarray(differing, float) / BITS, 0.4999)
    return np.clip(1 + BITS / (4 * BINS) * np.log(1 - 2 * z), 0, 1)


#: Most differing parities of a pair whose estimate is SLACK under the threshold.
def most_differing(threshold: float) -> int:
    return int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= max(0.0, threshold - SLACK))[-1])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b, off in tk.slices(batch["text"], lower=True):
            n = hi - lo
            h, doc, content = shingles(b, off)
            samples = minhash(h, doc, n)
            sketch = odd_sketch(samples).view(np.int64)
            power = np.array([pow(0x9E3779B97F4A7C15, r + 1, 1 << 64) for r in range(ROWS)], np.uint64)
            bands = (tk.mix(samples[:, : BANDS * ROWS]).reshape(n, BANDS, ROWS) * power).sum(2, dtype=np.uint64)
            bands = tk.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            arrays = [batch["doc_id"].slice(lo, n), batch["t"].slice(lo, n), pa.array(content.view(np.int64), mask=content == 0)]
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())))
            arrays += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "node", "bands", *SKETCH])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, node: hash of its words, bands, s0..s7)."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_signatures, _SIG)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """(rows of a, rows of b): do the sketches agree enough?"""
    differ = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        differ += np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return differ <= most


def _pairs(size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows within groups of such sizes that begin at such rows."""
    n = size * (size - 1) // 2
    group = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(group)) - (np.cumsum(n) - n)[group]
    # k-th pair of a group: j with j (j - 1) / 2 <= k
    j = ((1 + np.sqrt(8.0 * k + 1)) / 2).astype(np.int64)
    j -= j * (j - 1) // 2 > k
    return first[group] + k - j * (j - 1) // 2, first[group] + j


#: Groups of at most so many rows are compared together, a million pairs at a time.
SMALL, TOGETHER = 64, 1 << 20


def _small(size: np.ndarray, first: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows of the small groups."""
    own = np.flatnonzero((size > 1) & (size <= SMALL))
    part = np.cumsum(size[own] * (size[own] - 1) // 2) // TOGETHER
    for cut in np.split(own, np.flatnonzero(np.diff(part)) + 1):
        i, j = _pairs(size[cut], first[cut])
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= most
        yield i[near], j[near]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, row) that connect what the pairs connect."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    row = np.flatnonzero(label != np.arange(n))
    return label[row], row


def connected(sketch: np.ndarray, most: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows that span every connected part: each row is held against all not yet connected to it."""
    left, right, rest = [], [], np.arange(len(sketch))
    while len(rest):
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            own = todo.pop()
            for a in range(0, len(own), tile):
                near = _near(sketch[own[a : a + tile]], sketch[rest], most)
                hit = near.any(0)
                if hit.any():
                    left.append(own[a + near[:, hit].argmax(0)])
                    right.append(rest[hit])
                    todo.append(rest[hit])
                    rest = rest[~hit]
                if not len(rest):
                    break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _grouped(out, key: str):
    """A kernel that gives ``out`` tables of whole groups of rows sorted by ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch[key].to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last == 0 and held and held[-1][key][-1].as_py() != keys[0]:
                yield from out(pa.Table.from_batches(held))
                held = []
            elif last:
                yield from out(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _matrix(table: pa.Table) -> np.ndarray:
    return np.stack([table[s].to_numpy() for s in SKETCH], 1).view(np.uint64)


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.diff(np.r_[first, len(key)]), first


def _edges(most: int):
    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, sketch = table["node"].to_numpy(), _matrix(table)
        size, first = _sizes(table["bucket"].to_numpy())
        found = [(node[a], node[b]) for a, b in (_forest(len(node), i, j) for i, j in _small(size, first, sketch, most))]
        for n, at in zip(size[size > SMALL], first[size > SMALL]):
            i, j = connected(sketch[at : at + n], most)
            found.append((node[at + i], node[at + j]))
        for a, b in found:
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return _grouped(out, "bucket")


def _in_blocks(rows: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """``rows`` of groups ``key`` of ``n`` rows, those of large groups once for each pair of blocks they are in.

    The key becomes one of the pair; ``blk`` is a row's block (0 in small groups).
    """
    blocks = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    spread = rows.withColumn("blk", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.when(F.col(n) > block, F.xxhash64(key, F.least("blk", "other"), F.greatest("blk", "other"))).otherwise(F.col(key))
    return spread.withColumn(key, pair).drop(n, "other")


def candidate_edges(sig: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Verified pairs (a, b) of nodes, a < b, that connect all nodes of a bucket that verified pairs connect."""
    nodes = sig.where("node is not null").dropDuplicates(["node"]).select("node", "bands", *SKETCH)
    bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = bucket.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1").select("bucket", "node", "n")
    spread = _in_blocks(shared, "bucket", "n", block).drop("blk")
    wide = spread.join(nodes.select("node", *SKETCH), "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    return wide.mapInArrow(_edges(most_differing(threshold)), "a bigint, b bigint").distinct()


def _degrees(most: int):
    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, sketch, blk = table["node"].to_numpy(), _matrix(table), table["blk"].to_numpy()
        size, first = _sizes(table["pair"].to_numpy())
        degree = np.zeros(len(node), np.int64)
        for i, j in _small(size, first, sketch, most):
            both = table["cross"].to_numpy(zero_copy_only=False)[i]
            keep = ~both | (blk[i] != blk[j])
            degree += np.bincount(np.r_[i[keep], j[keep]], minlength=len(node))
        for n, at in zip(size[size > SMALL], first[size > SMALL]):
            own = slice(at, at + n)
            cross = bool(table["cross"][int(at)].as_py())
            for a in range(at, at + n, 256):
                z = slice(a, min(a + 256, at + n))
                near = _near(sketch[z], sketch[own], most)
                if cross:
                    near &= blk[z, None] != blk[None, own]
                degree[z] += near.sum(1) - (0 if cross else 1)  # itself
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(degree)], ["node", "links"])

    return _grouped(out, "pair")


def links(sig: DataFrame, comp: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, n_links): verified links of each node of a group of several to the group's other nodes."""
    member = comp.select("node", "root").unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    size = member.groupBy("root").agg(F.count("*").alias("n"))
    nodes = sig.where("node is not null").dropDuplicates(["node"]).select("node", *SKETCH)
    spread = member.join(size, "root").withColumn("pair", F.col("root")).withColumn("m", F.col("n"))
    spread = _in_blocks(spread, "pair", "n", block)
    # a pair of two blocks counts what lies across, that of a block with itself what lies inside
    spread = spread.withColumn("cross", (F.col("m") > block) & (F.col("pair") != F.xxhash64("root", "blk", "blk"))).select("pair", "cross", "blk", "node")
    wide = spread.join(nodes, "node").repartition("pair").sortWithinPartitions("pair", "node")
    return wide.mapInArrow(_degrees(most_differing(threshold)), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node that each node of an edge is connected to.

    Alternates large-star and small-star until no edge changes, which takes a
    number of rounds that grows with the logarithm of the largest component.
    Each round is written to the shared folder, so plans stay short.
    """
    edges = materialize(edges.where("a is not null and b is not null"), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(least, "b").select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("x"), "m")
        edges = materialize(pairs.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, t, group_id, group_rows, n_links, keep): one row per input row.

    ``group_id`` is the lowest doc_id of the near-duplicate group, ``group_rows``
    its number of rows, ``n_links`` the number of its other texts that verify
    with this one and ``keep`` true on exactly one row of each group.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(signatures(docs), "signatures")
    comp = components(candidate_edges(sig, threshold))
    # rows equal in id and text are counted, not kept apart, so that each decision has one row
    rows = sig.groupBy("doc_id", "t", "node").agg(F.count("*").alias("copies"))
    none = F.lit(0).cast("bigint")
    known = comp.withColumn("n_links", none)
    if count_links:
        # a group's root is in no row of comp as a node
        known = links(sig, comp, threshold).join(comp, "node", "left")
    member = rows.where("node is not null").join(known, "node", "left").select("doc_id", "t", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", none).alias("n_links"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")
    best = member.groupBy("root").agg(F.min(order).alias("o"), F.sum("copies").alias("group_rows"))
    grouped = member.join(best, "root").select("doc_id", "t", "copies", F.col("o.doc_id").alias("group_id"), "group_rows", "n_links", ((F.col("o.t") == F.col("t")) & F.col("o.doc_id").eqNullSafe(F.col("doc_id"))).alias("first"))
    alone = rows.where("node is null").select("doc_id", "t", "copies", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_rows"), none.alias("n_links"), F.lit(True).alias("first"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("k")
    return (
        grouped.withColumn("blank", F.lit(False)).union(alone.withColumn("blank", F.lit(True)))
        .select("*", each)
        .select("doc_id", "t", "group_id", "group_rows", "n_links", (F.col("first") & (F.col("blank") | (F.col("k") == 1))).alias("keep"))
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group and its own columns.

    Only rows that go, or that have twins, take part in the join's right side;
    it is broadcast where the optimiser sees that it is small.
    """
    names = docs.columns
    key_id, key_text, rows, keep = (f"__nd_{x}" for x in ("id", "t", "rows", "keep"))
    found = groups(docs, threshold, id_col, text_col, count_links=False).groupBy("doc_id", "t").agg(F.count("*").alias(rows), F.sum(F.col("keep").cast("bigint")).alias(keep))
    decided = materialize(found.where(f"{rows} <> {keep}").toDF(key_id, key_text, rows, keep), "decided")
    hashed = f"{key_text}_of_row"
    keyed = docs.withColumn(hashed, F.xxhash64(F.col(text_col).cast("string")))

    def on(right: DataFrame):
        return keyed[id_col].cast("bigint").eqNullSafe(right[key_id]) & (keyed[hashed] == right[key_text])

    lone = keyed.join(decided, on(decided), "left_anti").select(*names)
    twins = decided.where(f"{keep} > 0")
    if twins.isEmpty():
        return lone
    # one of the rows that agree in id and text stays
    one = keyed.join(twins, on(twins), "left_semi").dropDuplicates([id_col, hashed]).select(*names)
    return lone.unionByName(one)
