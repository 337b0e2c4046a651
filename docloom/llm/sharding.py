"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard.  At every level each child draws an
exponential variate from a hash of (key, path of the child), divided by its
weight; the lowest draw wins, so a child gets keys in proportion to its weight
among its siblings.  A draw depends on nothing but key, path and own weight:
when the weight of a node changes, keys move only to or from that node among
its siblings (and below it, all stay where they are), and other subtrees keep
theirs.

Defined results: keys are compared as text; a null key is the empty text.
Children of weight 0 or less get no key; a level without a positive weight is
an error when the tree is built.  Equal keys always share a shard.  The lower
name wins a tie.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (weight, children); the children of shards are empty.
Tree = Mapping[str, tuple[float, "Tree"]]
LEVELS = ("region", "rack", "shard")
DIGITS = 13


def grid(regions: Mapping[str, float], racks: int, shards: int, changed: Mapping[str, float] | None = None) -> Tree:
    """A tree of equal racks and shards; ``changed`` overrides weights by path ('eu/r2', 'us/r1/s3')."""
    changed = changed or {}

    def weight(path: str, usual: float) -> float:
        return float(changed.get(path, usual))

    return {
        g: (weight(g, w), {
            f"r{i}": (weight(f"{g}/r{i}", 1), {f"s{j}": (weight(f"{g}/r{i}/s{j}", 1), {}) for j in range(1, shards + 1)})
            for i in range(1, racks + 1)
        })
        for g, w in regions.items()
    }


def nodes(tree: Tree, path: str = "", depth: int = 0) -> list[tuple[int, str, str, float]]:
    """(level, parent path, name, weight) of every child that may be drawn."""
    live = {name: at for name, at in sorted(tree.items()) if at[0] > 0}
    if not live:
        raise ValueError(f"no positive weight under {path or 'the root'!r}")
    out = []
    for name, (weight, below) in live.items():
        out.append((depth, path, name, float(weight)))
        if depth + 1 < len(LEVELS):
            out += nodes(below, f"{path}/{name}" if path else name, depth + 1)
    return out


def _drawn(key: Column, path: Column, name: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(key, F.lit("|"), path, F.lit("/"), name))
    unit = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(unit) / weight


def assign(docs: DataFrame, tree: Tree, key_col: str = "doc_id", suffix: str = "") -> DataFrame:
    """``docs`` with region, rack and shard (each the path so far); a projection, nothing moves.

    Columns of the same names are replaced.
    """
    out = docs
    held = f"__key{suffix}"
    out = out.withColumn(held, F.col(key_col).cast("string"))
    names = []
    for depth, level in enumerate(LEVELS):
        # each level reads the column before it, so that no draw is made twice
        name = f"__{level}{suffix}"
        out = out.withColumn(name, _level(F.col(held), F.col(names[-1]) if names else F.lit(""), tree, depth))
        names.append(name)
    for level, name in zip(LEVELS, names):
        out = out.withColumn(level + suffix, F.col(name)).drop(name)
    return out.drop(held)


def _level(key: Column, path: Column, tree: Tree, depth: int) -> Column:
    key = F.coalesce(key, F.lit(""))
    children: dict[str, list[Column]] = {}
    for level, parent, name, weight in nodes(tree):
        if level == depth:
            children.setdefault(parent, []).append(F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")))
    known = F.create_map(*[x for parent, found in children.items() for x in (F.lit(parent), F.array(*found))])
    draws = F.transform(F.element_at(known, path), lambda c: F.struct(_drawn(key, path, c["name"], c["weight"]).alias("d"), c["name"].alias("name")))
    best = F.array_min(draws)["name"]
    return best if depth == 0 else F.concat(path, F.lit("/"), best)


def moves(docs: DataFrame, old: Tree, new: Tree, key_col: str = "doc_id") -> DataFrame:
    """(key, region, rack, shard, new_shard, moved) of every row."""
    now = assign(docs.select(F.col(key_col).alias("key")), old, "key")
    then = assign(now, new, "key", "_new")
    return then.select(F.col("key").alias(key_col), *LEVELS, F.col("shard_new").alias("new_shard"), (F.col("shard") != F.col("shard_new")).alias("moved"))


def moves_sql(old: Tree, new: Tree) -> str:
    """The same in DuckDB's SQL over ``documents``."""

    def chain(tree: Tree, tag: str) -> str:
        values = ", ".join(f"({d}, '{p}', '{n}', {w!r}::DOUBLE)" for d, p, n, w in nodes(tree))
        out = f"{tag}n(depth, parent, name, weight) AS (VALUES {values}),\n"
        last, path = "keys", "''"
        for depth in range(len(LEVELS)):
            full = "n.name" if depth == 0 else f"k.path || '/' || n.name"
            at = path if depth == 0 else "k.path"
            draw = f"-ln((('0x' || substr(md5(k.k || '|' || {at} || '/' || n.name), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)!r}) / n.weight"
            keep = "" if depth == 0 else ", ".join(f"any_value(k.p{i}) AS p{i}" for i in range(depth)) + ", "
            out += f"{tag}{depth} AS (SELECT k.k, {keep}arg_min({full}, {{'d': {draw}, 'n': n.name}}) AS path, arg_min({full}, {{'d': {draw}, 'n': n.name}}) AS p{depth} FROM {last} k JOIN {tag}n n ON n.depth = {depth} AND n.parent = {at} GROUP BY k.k),\n"
            last = f"{tag}{depth}"
        return out

    return (
        "WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),\n"
        + chain(old, "a") + chain(new, "b").rstrip(",\n")
        + "\nSELECT d.doc_id, a.p0 AS region, a.p1 AS rack, a.p2 AS shard, b.p2 AS new_shard, a.p2 <> b.p2 AS moved"
        + " FROM documents d JOIN a2 a ON a.k = coalesce(d.doc_id::VARCHAR, '') JOIN b2 b ON b.k = a.k"
    )
