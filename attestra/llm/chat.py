"""Operator 7: chat formatting. Reply trees become root-to-leaf conversations with a loss mask.

A node has a tree, an id, its parent's id (null: a root), role, text and score. Self-joins with path doubling
list every leaf's ancestors: round k joins what was found with the ancestors 2^k steps up, so a branch of n turns
takes log2(n) rounds, not n. Branches are ranked by their mean score and each is formatted as one conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so a control string never stands inside one and the text reads back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.work import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    """One pass from the left: each backslash stands for the character after it."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def linear_nodes(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees: each turn answers the one before it.

    Ties of turn are ordered by role and text; repeated rows stay as turns of their own.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("node"))
    return placed.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def branches(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """nodes(tree, node, parent, ...) -> (tree, leaf, node, up): each leaf with all its ancestors, itself at up = 0.

    A parent that isn't there makes its child a root. A cycle raises ValueError, as no round ends it.
    """
    links = nodes.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = stored(links.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up_node")), "jumps")
    inner = jumps.select("tree", F.col("up_node").alias("node")).distinct()
    paths = [nodes.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")).join(inner, ["tree", "node"], "left_anti")]
    for k in range(max_rounds):
        if jumps.isEmpty():
            return reduce(DataFrame.unionByName, paths).select("tree", "leaf", "node", "up")
        sofar = reduce(DataFrame.unionByName, paths)
        step = sofar.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths.append(stored(step, "paths"))
        further = jumps.select("tree", F.col("node").alias("first"), F.col("up_node").alias("node"))
        jumps = stored(further.join(jumps, ["tree", "node"]).select("tree", F.col("first").alias("node"), "up_node"), "jumps")
    raise ValueError("the reply links hold a cycle")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (tree, node): of repeated ones the greatest by score, then role, text and parent."""
    best = F.max(F.struct(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"), "role", "text", "parent")).alias("n")
    return nodes.groupBy("tree", "node").agg(best).select("tree", "node", "n.parent", "n.role", "n.text", "n.score")


def conversations(nodes: DataFrame, unique: bool = False) -> DataFrame:
    """One row for each root-to-leaf path: tree, leaf, branch_rank (1: best mean score; ties: smaller leaf), formatted, loss_spans.

    loss_spans are the (start from 0, length) code points of formatted that belong to assistant texts, as escaped.
    Null text or role is the empty string, null or NaN score 0. Nodes without a tree or an id are left out: they belong to
    no path. Of rows that repeat a node one counts (distinct_nodes); unique says that there are none. Empty input gives
    an empty result; columns beside the named ones are ignored.
    """
    nodes = nodes.where("tree is not null AND node is not null").withColumn("score", F.col("score").cast("double"))
    nodes = nodes if unique else stored(distinct_nodes(nodes), "nodes")
    text = lambda c: F.coalesce(c, F.lit(""))
    own = nodes.select("tree", "node", escaped(text("role")).alias("role"), escaped(text("text")).alias("text"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    turns = branches(nodes).join(own, ["tree", "node"])
    fixed = len(START) + len(SEP) + len(END)
    ahead = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(fixed + F.length("role") + F.length("text")).over(ahead), F.lit(0)).cast("int")
    parts = F.struct((-F.col("up")).alias("at"), "role", "text", "before")
    paths = turns.withColumn("before", before).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(parts)).alias("turns"), F.avg("score").alias("score"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((t["before"] + len(START) + F.length(t["role"]) + len(SEP)).alias("start"), F.length(t["text"]).alias("length")),
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return paths.select(
        "tree", "leaf", rank.alias("branch_rank"), "score",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    quoted = r"<\|im_end\|>\n"
    pieces = F.filter(F.split(formatted, quoted, -1), lambda p: p.startswith(START))

    def turn(p: Column) -> Column:
        at = F.instr(p, SEP)
        role = F.substring(p, len(START) + 1, at - 1 - len(START))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, at + len(SEP), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
