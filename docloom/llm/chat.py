"""Chat formatting of reply trees.

Iterative self-joins over identifiers only: with its 2^k-th ancestor a node
knows the sum of scores and the number of messages up to there, so a tree of
depth d takes log2(d) joins until every leaf knows its whole branch.  The
branches of a tree are ranked by the mean score of their messages.  The paths
of the chosen ones alone are then enumerated, again doubling with each join,
and each is formatted as one conversation.  A row a node moves in each step,
whatever the number and length of branches, and nothing is grouped by tree.

Defined results: of repeated (tree, node) rows the one of highest score, then
of lowest role and text, counts (nulls last).  A null parent, and one that the tree doesn't
hold, makes a root.  Nodes on a cycle, and replies below one, have no root and
are left out.  A null node or tree is no message.  Null scores count as 0, null
roles as ``user`` and null texts as empty.  Marker strings in a text are broken
up so that it can't open or close a turn.  Ties between branches go to the
lower leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.common import materialize


def _doubled(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, total, n) of every node below a root, over its whole branch, and the jumps (tree, node, up) of 1, 2, 4 … steps.

    ``rows`` holds tree, node, parent, score.
    """
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(1).alias("known"))
    state = rows.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known") == 1, F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n"))
    state, jumps, step = materialize(state, "chat-nodes"), [], 1
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while step <= largest and not state.where("up is not null").isEmpty():
        live = state.where("up is not null")
        jumps.append(live.select("tree", "node", "up"))
        over = state.select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("total").alias("more"), F.col("n").alias("steps"))
        far = live.join(over, ["tree", "up"]).select("tree", "node", F.col("top").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("steps")).alias("n"))
        state = materialize(state.where("up is null").unionByName(far), "chat-nodes")
        step *= 2
    # what still has an ancestor is on a cycle or below one
    return state.where("up is null").drop("up"), jumps


def turn(role: Column, text: Column) -> Column:
    clean = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), clean(F.coalesce(role, F.lit("user"))), F.lit("\n"), clean(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def conversations(messages: DataFrame, best: int = 3) -> DataFrame:
    """(tree, branch, leaf, n_messages, score, text) of the ``best`` branches of every tree.

    ``messages`` holds tree, node, parent, role, text and score.
    """
    rows = messages.select("tree", "node", "parent", "role", "text", "score").where("tree is not null and node is not null")
    # texts stay where they are but for the nodes that several rows claim
    key = ["tree", "node"]
    claimed = materialize(rows.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").select(*key), "chat-claimed")
    if not claimed.isEmpty():
        order = [F.desc_nulls_last("score"), F.asc_nulls_last("role"), F.asc_nulls_last("text")]
        first = rows.join(claimed, key, "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
        rows = materialize(rows.join(claimed, key, "left_anti").unionByName(first), "chat-messages")
    number = "bigint" if isinstance(rows.schema["score"].dataType, T.IntegralType) else "double"
    rooted, jumps = _doubled(rows.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast(number).alias("score")))
    parents = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else None
    leaves = rooted.join(parents, ["tree", "node"], "left_anti") if jumps else rooted
    branch = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), F.col("n").alias("n_messages"))
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    # the limit is taken before the shuffle as well, so a tree of very many leaves doesn't meet in one task
    chosen = materialize(branch.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best), "chat-chosen")
    way = chosen.select("tree", "branch", F.col("leaf").alias("node"), F.lit(0).alias("d"))
    for k, jump in enumerate(jumps):
        far = way.join(jump, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), (F.col("d") - (1 << k)).alias("d"))
        way = materialize(way.unionByName(far), "chat-paths")
    steps = way.join(chosen, ["tree", "branch"])
    said = steps.join(rows.select("tree", "node", turn(F.col("role"), F.col("text")).alias("said")), ["tree", "node"])
    whole = said.groupBy("tree", "branch", "leaf", "n_messages", "score").agg(F.array_sort(F.collect_list(F.struct("d", "said"))).alias("x"))
    return whole.select("tree", "branch", "leaf", "n_messages", "score", F.array_join(F.transform("x", lambda s: s["said"]), "").alias("text"))


def reply_trees(table: DataFrame) -> DataFrame:
    """Messages of a (conv_id, turn, role, text) table as reply trees.

    In the order of turn, role and text, a run of messages by one role holds
    alternatives, which all reply to the message before the run.  A message
    scores its length.  Rows with a null conv_id or turn are left out; repeated
    rows are alternatives like any others.

    The table is sorted by ranges, so that a conversation may fill many
    partitions: the numbers of nodes ascend in this order, parents are found
    within a partition, and those of runs that begin a partition from one row of
    each partition before.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = table.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
    # scored here, so that finding the parents moves no texts
    placed = materialize(ranged.withColumns({"node": F.monotonically_increasing_id(), "score": F.length("text")}), "chat-order").withColumn("part", F.shiftright("node", 33))
    inside = Window.partitionBy("part", "conv_id").orderBy("node")
    cut = F.when(F.lag("role").over(inside) != F.col("role"), F.lag("node").over(inside))
    # the latest message of the partition by another role
    placed = placed.withColumn("cut", cut).withColumn("inner", F.last("cut", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    chunk = placed.groupBy("conv_id", "part").agg(F.min_by("role", "node").alias("begins"), F.max_by(F.struct("node", "role", "inner"), "node").alias("end"))
    # a row a partition: a conversation has at most as many of these as there are partitions
    along = Window.partitionBy("conv_id").orderBy("part")
    last = F.lag("end").over(along)
    direct = F.when(last["role"] != F.col("begins"), last["node"]).otherwise(last["inner"])
    carried = chunk.withColumn("direct", direct).withColumn("before", F.last("direct", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    carried = carried.where("before is not null").select("conv_id", "part", "before")
    # only the first conversation of a partition began before it: a row a partition at most, so texts needn't move for it
    found = placed.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return found.select(F.col("conv_id").alias("tree"), "node", F.coalesce("inner", "before").alias("parent"), "role", "text", "score")


#: Three branches of each tree of ``conversations``, in DuckDB's SQL.
CHAT_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id AS tree, coalesce(role, 'user') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), n AS (SELECT *, row_number() OVER w AS node, lag(role) OVER w AS before, length(text) AS score FROM m WINDOW w AS (PARTITION BY tree ORDER BY turn, role, text)),
c AS (SELECT *, CASE WHEN before <> role THEN node - 1 END AS cut FROM n),
t AS (SELECT tree, node, role, text, score, max(cut) OVER (PARTITION BY tree ORDER BY node ROWS UNBOUNDED PRECEDING) AS parent FROM c),
leaf AS (SELECT a.tree, a.node FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.tree = a.tree AND b.parent = a.node)),
p AS (
  SELECT l.tree, l.node AS leaf, t.node, t.parent, t.score, t.role, t.text FROM leaf l JOIN t ON t.tree = l.tree AND t.node = l.node
  UNION ALL SELECT p.tree, p.leaf, t.node, t.parent, t.score, t.role, t.text FROM p JOIN t ON t.tree = p.tree AND t.node = p.parent
), b AS (
  SELECT tree, leaf, sum(score)::DOUBLE / count(*) AS score, count(*) AS n_messages,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY node) AS text
  FROM p GROUP BY tree, leaf
), r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, leaf) AS branch FROM b)
SELECT tree AS conv_id, branch::INT AS branch, n_messages, score, text FROM r WHERE branch <= 3
"""
