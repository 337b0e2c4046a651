"""Best-two-fit packing of documents into sequences of a fixed size.

A sequence is filled greedily with the longest piece that fits until none does;
then its smallest piece (its only one, if it is alone) is replaced by the two
unpacked pieces that fill the gap, widened by that piece, more tightly, if
there are such two.  Lengths are characters unless ``length_col`` names a
column, tokens say.  ``separator`` is the length of what a reader puts between
two pieces of a sequence; ``used`` counts it, so it never exceeds the capacity.

Documents longer than a sequence are first cut into full pieces and a rest;
full pieces are sequences of their own.  Pieces are dealt by hash and input
partition to groups of about ``GROUP`` characters, as many as the whole table
needs, and each group is packed by itself, which costs at most one badly filled
sequence a group.  Repeated rows don't meet in one group for being equal.

Defined results: null and empty texts (and null, zero and negative lengths)
take no room and are in no sequence.
Repeated rows are packed one by one.  Of pieces of equal length the one with
the lowest (doc_id, start) goes first, null ids last.  ``seq_id`` is unique;
an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
#: Characters packed together; a group is held by one worker.
GROUP = 1 << 23


class Pool:
    """A multiset of lengths 1..capacity with fast predecessor and pair search.

    The lengths at hand are the bits of an integer, so that the largest length
    up to a limit is one shift, and a pair of a given sum one AND with the
    mirrored bits.
    """

    def __init__(self, capacity: int, lengths: np.ndarray) -> None:
        self.capacity = capacity
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = self.mirror = 0
        for n in np.unique(lengths).tolist():
            self.bits |= 1 << n
            self.mirror |= 1 << (capacity - n)

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit``, or 0."""
        return max(0, (self.bits & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    def take(self, n: int) -> int:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)
        return n

    def put(self, n: int) -> None:
        if not self.count[n]:
            self.bits |= 1 << n
            self.mirror |= 1 << (self.capacity - n)
        self.count[n] += 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths of this sum, the longer one as long as can be."""
        shift = self.capacity - total
        # bit n of the mirror shifted so: is length total - n at hand?
        both = self.bits & ((self.mirror >> shift) if shift >= 0 else (self.mirror << -shift))
        while both:
            a = both.bit_length() - 1
            if a != total - a or self.count[a] > 1:
                return a, total - a
            both ^= 1 << a
        return None


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Lengths of the pieces in each sequence, the longest first; all lengths are in 1..capacity."""
    pool, out = Pool(capacity, lengths), []
    while pool.bits:
        bin_, gap = [], capacity
        while n := pool.largest(gap):
            bin_.append(pool.take(n))
            gap -= n
        if gap:
            least = bin_[-1]  # pieces were taken in falling order
            limit = least + gap
            # no two pieces fill more than twice the largest that fits
            for total in range(min(limit, 2 * pool.largest(limit - 1)), least, -1):
                found = pool.pair(total)
                if found:
                    bin_[-1:] = [pool.take(found[0]), pool.take(found[1])]
                    pool.put(least)
                    break
        out.append(sorted(bin_, reverse=True))
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, length_col: str | None = None) -> DataFrame:
    """(doc_id, start, length[, text]): documents cut to at most ``capacity`` units of length."""
    if keep_text and length_col:
        raise ValueError("texts are cut by characters: keep_text and length_col exclude each other")
    text = F.col(text_col).cast("string")
    n = F.col(length_col).cast("bigint") if length_col else F.length(text).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), n.alias("n"), *([text.alias("text")] if keep_text else [])).where("n > 0")
    if keep_text:
        # cut in one pass: a substring from a late start would read the text from its beginning for each piece
        parts = F.when(F.col("n") > capacity, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{capacity}}}"), F.lit(0))).otherwise(F.array("text"))
        cut = rows.select("doc_id", F.posexplode(parts).alias("part", "text"))
        return cut.select("doc_id", (F.col("part") * capacity).alias("start"), F.length("text").alias("length"), "text")
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    start = F.col("part") * capacity
    return cut.select("doc_id", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("length"))


def _packed(capacity: int, separator: int, keep_text: bool) -> Callable[[pa.Table], pa.Table]:
    room = capacity + separator  # each piece takes a separator with it, and the last one's is past the end

    def run(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        table = table.sort_by([*keys, ("text", "ascending")] if keep_text else keys)
        length = table["length"].to_numpy() + separator
        first = np.searchsorted(-length, -np.arange(room + 2), "left")  # of each length
        bins = pack(length, room)
        taken = np.zeros(room + 1, np.int64)
        order = np.empty(len(length), np.int64)
        i = 0
        for b in bins:
            for n in b:
                order[i] = first[n] + taken[n]
                taken[n] += 1
                i += 1
        offsets = pa.array(np.cumsum([0, *map(len, bins)]), pa.int32())
        table = table.take(pa.array(order)).combine_chunks()
        column = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        group = table["grp"][0].as_py() if len(table) else 0
        seq = pa.array((np.int64(group) << 32) + np.arange(len(bins), dtype=np.int64))
        fields = [seq, pa.array([sum(b) - separator for b in bins], pa.int32())]
        fields += [pa.ListArray.from_arrays(offsets, column(x)) for x in ("doc_id", "start", "length")]
        names = ["seq_id", "used", "doc_ids", "starts", "lengths"]
        if keep_text:
            fields.append(pa.ListArray.from_arrays(offsets, column("text")))
            names.append("texts")
        return pa.Table.from_arrays(fields, names)

    return run


def sequences(
    docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, length_col: str | None = None, separator: int = 0
) -> DataFrame:
    """(seq_id, used, doc_ids, starts, lengths[, texts]): one row per sequence."""
    cut = pieces(docs, capacity, id_col, text_col, keep_text, length_col)
    total = pieces(docs, capacity, id_col, text_col, length_col=length_col).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // group))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "length", F.spark_partition_id()), F.lit(n)))
    schema = "seq_id bigint, used int, doc_ids array<bigint>, starts array<int>, lengths array<int>" + (", texts array<string>" if keep_text else "")
    return dealt.groupBy("grp").applyInArrow(_packed(capacity, separator, keep_text), schema)
