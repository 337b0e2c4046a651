"""Approximate nearest neighbours by inner product with score-aware quantisation.

Vectors are partitioned by k-means and their residuals quantised in subspaces
of two dimensions to four bits.  Codes and codebooks minimise the anisotropic
loss: error parallel to a vector, which changes its large inner products, costs
``eta`` times as much as error across it.  A query visits the partitions that
are expected to hold its neighbours: with the number, centroid
and spread of each partition a normal model gives the score that ``k`` rows
exceed, and the partitions with the most such rows are taken until the others
would hold a share of ``miss`` together.  In a visited partition the four-bit
codes are scanned with tables, two codes a lookup, and the best ``shortlist``
candidates of a block are ranked by their exact scores.

Equal vectors are one entry of the index, with the lowest ``k + 1`` of their
rows, so a group of copies costs what one row does, however large it is, and no
answer is lost: of more copies than that none can be among the ``k`` nearest.

Training passes and the statistics read all vectors.  Partitions are gathered in
blocks, and a partition larger than a block is spread over several; a group of
queries meets only the blocks that its queries visit, so that clustered data
takes far fewer than all pairs.

Defined results: a row with a null vector, a null, infinite or missing
component, or another length than most rows (the longer of two equally
frequent ones) has no neighbours and is none.  Repeated rows are neighbours of
each other.  Equal scores are ordered by id, null ids last, then by row.  A
table of at most ``k`` rows gives each all the others; an empty one gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import materialize

K, SHORTLIST, BLOCK = 10, 96, 8192
#: Share of the neighbours that unvisited partitions may hold, by the model.
MISS = 0.02
#: Score, as a share of a vector's norm, from which scores count in the loss.
SCORE = 0.2
#: Most bytes of centroids sent to every worker; beyond, partitions grow instead.
MOST_CENTROID_BYTES = 64 << 20
TILE, CENTRES = 256, 16


@dataclass
class Coarse:
    centroid: np.ndarray  # partitions x dims
    count: np.ndarray
    spread: np.ndarray  # root mean square of a residual's component
    block: np.ndarray  # first one of each partition
    blocks: np.ndarray  # their number

    def place(self, part: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Blocks of rows in these partitions."""
        h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return self.block[part] + ((h >> np.uint64(32)) % self.blocks[part].astype(np.uint64)).astype(np.int64)

    def assign(self, x: np.ndarray) -> np.ndarray:
        half = (self.centroid**2).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ self.centroid.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def units(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Residuals in units of their partition's spread."""
        return (x - self.centroid[part]) / self.spread[part, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), dims)


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(row, id, v) of the usable rows, written once so that row numbers stay; v is padded to a multiple of four."""
    # a zero has no sign here, so that equal vectors are equal
    v = F.transform(F.col(vec_col).cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    good = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.size("v") > 0)
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return rows.where("false").select(F.lit(0).cast("bigint").alias("row"), "id", "v"), 0
    dims = -(-usual.d // 4) * 4
    fill = F.concat("v", F.array_repeat(F.lit(0.0).cast("float"), dims - usual.d))
    kept = good.where(F.size("v") == usual.d).select(F.monotonically_increasing_id().alias("row"), "id", fill.alias("v"))
    return materialize(kept, "ann-vectors"), dims


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(u, v, members): each vector once, with the lowest k + 1 (id, row) of its rows; u is the row of the first."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"), "row")
    # the limit is taken before the shuffle as well, so copies don't meet in one task
    low = rows.select("row", "id", "v").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    found = low.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "id", "row"))).alias("m"))
    return found.select(F.col("m")[0]["row"].alias("u"), "v", F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["row"].alias("row"))).alias("members"))


# --- training ----------------------------------------------------------------

#: Widest sums that are added up as arrays; wider ones take a row a number.
WIDE = 256


def _sums(rows: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of what ``kernel`` gives for a batch; partial sums are merged by their first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = kernel(batch)
                total = found if total is None else total + found
        if total is not None:
            flat = total.reshape(shape[0], -1)
            live = np.flatnonzero((flat != 0).any(1))
            lists = pa.array(list(flat[live].astype(np.float64)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(live), lists], ["i", "s"])

    parts = rows.mapInArrow(run, "i bigint, s array<double>")
    width = int(np.prod(shape[1:]))
    out = np.zeros((shape[0], width))
    if width <= WIDE:
        for r in parts.groupBy("i").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s")).collect():
            out[r.i] = r.s
    else:
        found = parts.select("i", F.posexplode("s").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        out[found["i"].to_numpy(), found["j"].to_numpy()] = found["x"]
    return out.reshape(shape)


def _coarse(rows: DataFrame, dims: int, passes: int = 6) -> Coarse:
    n = rows.count()
    wanted = int(min(max(1, round(np.sqrt(n) / 4)), MOST_CENTROID_BYTES // (4 * dims)))
    start = rows.select("u", "v").orderBy(F.xxhash64("u"), "u").limit(wanted).toPandas()["v"]
    centroid = np.unique(np.stack(start.to_numpy()).astype(np.float32), axis=0)
    for last in [False] * passes + [True]:
        now = Coarse(centroid, np.ones(len(centroid)), np.ones(len(centroid)), np.zeros(len(centroid), int), np.ones(len(centroid), int))

        def kernel(batch: pa.RecordBatch, now: Coarse = now) -> np.ndarray:
            x = _matrix(batch["v"], dims)
            part = now.assign(x)
            out = np.zeros((len(now.centroid), dims + 2))
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            out[found, :dims] = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
            out[:, dims] = np.bincount(part, minlength=len(out))
            out[:, dims + 1] = np.bincount(part, ((x - now.centroid[part]) ** 2).sum(1), len(out))
            return out

        s = _sums(rows, kernel, (len(centroid), dims + 2))
        live = s[:, dims] > 0
        if not last:
            centroid = np.where(live[:, None], s[:, :dims] / np.maximum(s[:, dims : dims + 1], 1), centroid).astype(np.float32)
    # a spread of nothing would divide by zero
    spread = np.maximum(np.sqrt(s[:, dims + 1] / np.maximum(s[:, dims], 1) / dims), 1e-6)
    # neighbouring partitions share a block: they are laid along the main axis of the centroids
    mean = np.average(centroid, axis=0, weights=np.maximum(s[:, dims], 1e-9))
    axis = np.linalg.svd(centroid - mean, full_matrices=False)[2][0]
    order = np.lexsort([np.arange(len(centroid)), centroid @ axis])
    count = s[:, dims]
    block, blocks = np.empty(len(centroid), np.int64), np.maximum(1, -(-count // BLOCK)).astype(np.int64)
    at, held = 0, 0.0
    for p in order:
        if held and held + count[p] > BLOCK:
            at, held = at + 1, 0.0
        block[p] = at
        held += count[p]
        if blocks[p] > 1:
            at, held = at + int(blocks[p]), 0.0
    return Coarse(centroid, count, spread, block, blocks)


def encode(u: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes of scaled residuals ``u`` under the anisotropic loss, and the parallel error left.

    ``unit`` holds the directions of the vectors.  Coordinate descent: a
    subspace's code is chosen with the other subspaces' codes as they are.
    """
    n, m = len(u), len(books)
    parts, along = u.reshape(n, m, 2), unit.reshape(n, m, 2)
    code = np.empty((n, m), np.int64)
    err = np.empty((n, m), np.float32)  # parallel error of each subspace
    for j in range(m):
        code[:, j] = (((parts[:, j, None] - books[j]) ** 2).sum(2)).argmin(1)
        err[:, j] = ((parts[:, j] - books[j][code[:, j]]) * along[:, j]).sum(1)
    total = err.sum(1)
    for _ in range(rounds):
        for j in range(m):
            gap = parts[:, j, None] - books[j]  # n x 16 x 2
            par = (gap * along[:, j, None]).sum(2)
            rest = total - err[:, j]
            code[:, j] = ((gap**2).sum(2) + (eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
            now = par[np.arange(n), code[:, j]]
            total = rest + now
            err[:, j] = now
    return code, err


def _books(rows: DataFrame, coarse: Coarse, dims: int, eta: float, passes: int = 5) -> np.ndarray:
    """Codebooks (subspaces, 16, 2) by alternating codes and weighted least squares over all rows."""
    m = dims // 2
    # a first guess on a ring of two radii, which suits residuals of unit spread
    angle = np.arange(8) * np.pi / 4
    ring = np.stack([np.cos(angle), np.sin(angle)], 1)
    turned = np.stack([np.cos(angle + np.pi / 8), np.sin(angle + np.pi / 8)], 1)
    books = np.tile(np.concatenate([0.6 * ring, 1.6 * turned])[None], (m, 1, 1)).astype(np.float32)
    for _ in range(passes):

        def kernel(batch: pa.RecordBatch, books: np.ndarray = books) -> np.ndarray:
            x = _matrix(batch["v"], dims)
            out = np.zeros((m * CENTRES, 5))
            for i in range(0, len(x), 2048):
                own = x[i : i + 2048]
                u = coarse.units(own, coarse.assign(own))
                unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                code, err = encode(u, unit, books, eta)
                total = err.sum(1)
                for j in range(m):
                    a, p = unit[:, 2 * j : 2 * j + 2].astype(np.float64), u[:, 2 * j : 2 * j + 2].astype(np.float64)
                    rest = total - err[:, j]
                    w = eta - 1
                    # normal equations of sum |p - c|^2 + w (rest + a.(p - c))^2
                    right = p + w * a * (rest + (a * p).sum(1))[:, None]
                    terms = [1 + w * a[:, 0] ** 2, w * a[:, 0] * a[:, 1], 1 + w * a[:, 1] ** 2, right[:, 0], right[:, 1]]
                    for t, term in enumerate(terms):
                        out[j * CENTRES : (j + 1) * CENTRES, t] += np.bincount(code[:, j], term, CENTRES)
            return out

        s = _sums(rows, kernel, (m * CENTRES, 5))
        det = s[:, 0] * s[:, 2] - s[:, 1] ** 2
        ok = det > 1e-12
        safe = np.where(ok, det, 1)
        solved = np.stack([(s[:, 2] * s[:, 3] - s[:, 1] * s[:, 4]) / safe, (s[:, 0] * s[:, 4] - s[:, 1] * s[:, 3]) / safe], 1)
        books = np.where(ok[:, None], solved, books.reshape(-1, 2)).reshape(m, CENTRES, 2).astype(np.float32)
    return books


# --- search ------------------------------------------------------------------


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z (a logistic fit; 2 % of the share or better up to z = 4)."""
    return 1 / (1 + np.exp(np.clip(1.5976 * z + 0.07056 * z**3, -60, 60)))


def visits(coarse: Coarse, q: np.ndarray, k: int, miss: float) -> np.ndarray:
    """(queries, partitions): where the k best of each query are expected, but for a share of ``miss``."""
    mean = q @ coarse.centroid.T
    wide = np.maximum(np.linalg.norm(q, axis=1)[:, None] * coarse.spread[None], 1e-12)
    lo, hi = (mean - 8 * wide).min(1), (mean + 8 * wide).max(1)
    need = min(k + 1, coarse.count.sum())
    for _ in range(26):
        mid = (lo + hi) / 2
        many = (coarse.count * _tail((mid[:, None] - mean) / wide)).sum(1) > need
        lo, hi = np.where(many, mid, lo), np.where(many, hi, mid)
    held = coarse.count * _tail((lo[:, None] - mean) / wide)
    order = np.argsort(-held, axis=1, kind="stable")
    ahead = np.cumsum(np.take_along_axis(held, order, 1), 1)
    before = np.concatenate([np.zeros((len(q), 1)), ahead[:, :-1]], 1)
    take = before < (1 - miss) * ahead[:, -1:]
    out = np.zeros(held.shape, bool)
    np.put_along_axis(out, order, take, 1)
    return out & (coarse.count > 0)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(byte of a code, queries, 256): scores of two codes at once."""
    one = np.einsum("qmd,mcd->mqc", q.reshape(len(q), -1, 2), books)
    return np.ascontiguousarray((one[0::2, :, :, None] + one[1::2, :, None, :]).reshape(len(books) // 2, len(q), CENTRES**2))


_MEMBERS = "array<struct<id:bigint,row:bigint>>"
_FOUND = f"q bigint, n_id bigint, n_row bigint, score float, members {_MEMBERS}"


def _search(coarse: Coarse, books: np.ndarray, dims: int, k: int, shortlist: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each query the best k + 1 entries of one block, itself among them."""
    pair = pa.struct([("id", pa.int64()), ("row", pa.int64())])
    empty = pa.schema([("q", pa.int64()), ("n_id", pa.int64()), ("n_row", pa.int64()), ("score", pa.float32()), ("members", pa.list_(pair))]).empty_table()

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return empty
        # columns are tied in the order of id and row; a partition's lie together
        held = held.sort_by([("id", "ascending"), ("u", "ascending")])
        tie = np.argsort(held["part"].to_numpy(), kind="stable")
        held, asked = held.take(pa.array(tie)).combine_chunks(), asked.sort_by("u").combine_chunks()
        col = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        x, q = _matrix(col(held, "v"), dims), _matrix(col(asked, "v"), dims)
        code = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(x), -1).T.copy()
        part, first = np.unique(held["part"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(x))
        lists = col(asked, "parts")
        mask = np.zeros((len(q), len(part)), bool)
        owner = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        named = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(part, named), len(part) - 1)
        there = part[at] == named
        mask[owner[there], at[there]] = True
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(q), TILE):
            own = q[i : i + TILE]
            lut, near = tables(own, books), own @ coarse.centroid[part].T
            scores = np.full((len(own), len(x)), -np.inf, np.float32)
            for p, (a, b) in enumerate(zip(first, ends)):
                who = np.flatnonzero(mask[i : i + TILE, p])
                if not len(who):
                    continue
                s = np.zeros((len(who), b - a), np.float32)
                for byte in range(len(lut)):
                    s += np.take(lut[byte, who], code[byte, a:b], axis=1)
                s *= np.float32(coarse.spread[part[p]])
                s += near[who, p, None]
                scores[who, a:b] = s
            good = scores > -np.inf
            if scores.shape[1] > shortlist:
                cut = np.partition(scores, scores.shape[1] - shortlist, axis=1)[:, -shortlist, None]
                good &= scores >= cut
                for r in np.flatnonzero(good.sum(1) > shortlist):  # of equal estimates the first
                    even = np.flatnonzero(good[r] & (scores[r] == cut[r]))
                    good[r, even[shortlist - int(good[r].sum()) + len(even) :]] = False
            r, c = np.nonzero(good)
            exact = np.einsum("ij,ij->i", own[r], x[c])
            order = np.lexsort([tie[c], -exact, r])
            r, c, exact = r[order], c[order], exact[order]
            top = np.arange(len(r)) - np.searchsorted(r, np.arange(len(own)))[r] <= k
            found.append((r[top] + i, c[top], exact[top]))
        r, c, s = (np.concatenate(z) for z in zip(*found))
        taken = held.take(pa.array(c))
        return pa.table({"q": asked["u"].take(pa.array(r)), "n_id": taken["id"], "n_row": taken["u"], "score": pa.array(s.astype(np.float32)), "members": taken["members"]})

    return run


def neighbours(table: DataFrame, k: int = K, shortlist: int = SHORTLIST, miss: float = MISS, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, rank, neighbour, score): the k rows of highest inner product with every row, or with those for which ``queries`` (of ``id``) is true."""
    rows, dims = _vectors(table, id_col, vec_col)
    if not dims:
        return rows.select("id", F.lit(1).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).cast("float").alias("score")).where("false")
    entries = materialize(_entries(rows, k), "ann-entries")
    wanted = rows.where(queries) if queries is not None else rows
    asked = materialize(wanted.join(entries.select("v", "u"), "v").select("row", "id", "u"), "ann-asked")
    units = asked.select("u").distinct()
    coarse = _coarse(entries.select("u", "v"), dims)
    eta = max(1.0, (dims - 1) * SCORE**2 / (1 - SCORE**2))
    books = _books(entries.select("v"), coarse, dims, eta)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, u = _matrix(batch["v"], dims), batch["u"].to_numpy()
            part = coarse.assign(x)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            code = np.concatenate([encode(coarse.units(x[i : i + 2048], part[i : i + 2048]), unit[i : i + 2048], books, eta)[0] for i in range(0, len(x), 2048)]) if len(x) else np.zeros((0, dims // 2), np.int64)
            packed = (code[:, 0::2] * CENTRES + code[:, 1::2]).astype(np.uint8)
            first = batch["members"].flatten().field("id").take(pa.array(batch["members"].offsets.to_numpy()[:-1] - batch["members"].offsets[0].as_py()))
            arrays = [batch["u"], first, batch["v"], batch["members"], pa.array(part), pa.array(coarse.place(part, u)), pa.array([r.tobytes() for r in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["u", "id", "v", "members", "part", "block", "code"])

    held = materialize(entries.mapInArrow(placed, f"u bigint, id bigint, v array<float>, members {_MEMBERS}, part bigint, block bigint, code binary"), "ann-codes")
    # groups of about as many queries as a block has entries
    ratio = max(1, round(float(coarse.count.sum()) / max(1, units.count())))
    parts_of: dict[int, list[int]] = {}
    for p, (b, n) in enumerate(zip(coarse.block.tolist(), coarse.blocks.tolist())):
        for i in range(n):
            parts_of.setdefault(b + i, []).append(p)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, group = _matrix(batch["v"], dims), pa.array(batch["block"].to_numpy() // ratio)
            for i in range(0, len(x), 2048):
                where = visits(coarse, x[i : i + 2048], k, miss)
                for b, parts in parts_of.items():
                    own = where[:, parts]
                    who = np.flatnonzero(own.any(1))
                    if not len(who):
                        continue
                    r, p = np.nonzero(own[who])
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(who) + 1)), pa.int32()), pa.array(np.array(parts)[p]))
                    at = pa.array(who + i)
                    yield pa.RecordBatch.from_arrays([group.take(at), pa.array(np.full(len(who), b)), batch["u"].take(at), batch["v"].take(at), lists], ["a", "b", "u", "v", "parts"])

    told = materialize(held.select("block", "u", "v").join(units, "u", "left_semi").select("block", "u", "v").mapInArrow(routed, "a bigint, b bigint, u bigint, v array<float>, parts array<bigint>"), "ann-queries")
    pairs = told.select("a", "b").distinct()
    met = held.withColumnRenamed("block", "b").join(pairs, "b").select(F.col("a").alias("with_a"), F.col("b").alias("with_b"), "u", "id", "v", "members", "part", "code")
    best = told.groupBy("a", "b").cogroup(met.groupBy("with_a", "with_b")).applyInArrow(_search(coarse, books, dims, k, shortlist), _FOUND)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("n_id"), "n_row")
    top = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    each = F.transform("members", lambda m: F.struct((-F.col("score")).alias("less"), m["id"].isNull().alias("z"), m["id"].alias("id"), m["row"].alias("row")))
    near = top.groupBy(F.col("q").alias("u")).agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("near"))
    # a row is its own neighbour in the list of its vector
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("own")), 1, k)
    ranked = asked.withColumnRenamed("row", "own").join(near, "u").select("id", F.posexplode(others).alias("at", "x"))
    return ranked.select("id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour"), (-F.col("x.less")).alias("score"))
