r"""Chat formatting over reply trees, with DataFrame functions only.

A node has a tree, a number, a parent and a score.  Paths from every leaf to
its root come from iterative self-joins in which the jump doubles each round:
round k adds the ancestors 2^k steps above those known, so a thread of n turns
needs log2(n) rounds.  Branches of a tree rank by the sum of their nodes'
scores, and the chosen paths are written as one conversation each.

Template: ``### role: text</turn>\n``.  In texts and roles backslash, ``#`` and
``<`` (and in roles ``:``) become ``\b``, ``\h``, ``\l``, ``\c``, so no control string can occur
inside a text and the output can be split and read back exactly.  The loss mask
holds the code point ranges of the assistant's texts.

Null role or text: empty.  Null turns come first; ties go by role, then text.
Repeated rows are turns of their own.  Rows with a null conversation id are one
conversation.  A node whose parent is missing is a root; a cycle is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.llm.shared import written

#: Turn numbers that share a bucket when rows are numbered, and turns in a part when they are put together.
TURNS = 256
LOSS_ROLE = "assistant"
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
# Escapes, backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def threads(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each turn replies to the one before.

    Rows are numbered in buckets of turn numbers, so one very long conversation
    is split; the window over buckets has one row a bucket.
    """
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
    counts = rows.groupBy("tree", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tree").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("tree", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1).join(before, ["tree", "bucket"])
    return numbered.select("tree", (F.col("before") + F.col("nth")).alias("node"),
                           F.when(F.col("before") + F.col("nth") > 0, F.col("before") + F.col("nth") - 1).alias("parent"),
                           F.lit(0.0).alias("score"), "role", "text")


def paths(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(tree, leaf, node, up) for every node above (or equal to) each leaf; up: steps from the leaf."""
    links = nodes.select("tree", "node", "parent")
    ids = links.select("tree", F.col("node").alias("parent"))
    jump = written(links.filter("parent is not null").join(ids, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")), "jump")
    inner = links.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    known = written(links.join(inner, ["tree", "node"], "left_anti")
                    .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k in range(max_rounds):
        step = known.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        step = written(step, "paths")
        if not step.limit(1).count():
            return known
        known = known.unionByName(step)
        far = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(far, ["tree", "to"]).select("tree", "node", F.col("further").alias("to")), "jump")
    raise ValueError("the reply links hold a cycle")


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, n_turns, formatted, loss (code point ranges) of the best ``branches`` paths of each tree (None: all)."""
    every = paths(nodes)
    content = nodes.select("tree", "node", "score", "role", "text")
    whole = every.join(content, ["tree", "node"])
    scores = whole.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    if branches == 1:
        best = scores.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("s"), "leaf")).alias("b"))
        chosen = best.select("tree", F.col("b.leaf").alias("leaf"), F.lit(1).alias("rank"))
    else:
        chosen = scores.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).drop("total")
        chosen = chosen.filter(F.col("rank") <= branches) if branches else chosen
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(MIDDLE))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(head, body, F.lit(TAIL)).alias("piece"),
                    F.length(head).alias("head"), F.when(F.col("role") == LOSS_ROLE, F.length(body)).alias("body"))
    parts = (whole.join(chosen, ["tree", "leaf"]).withColumn("part", -F.floor(F.col("up") / TURNS)).withColumn("turn", turn)
             .groupBy("tree", "leaf", "rank", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns")))
    rows = (parts.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("parts"))
            .withColumn("turns", F.flatten(F.transform("parts", lambda p: p["turns"]))))
    loss = F.expr("aggregate(turns, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)), (a, t) -> named_struct("
                  "'at', a.at + length(t.piece), 'out', if(t.body is null, a.out, concat(a.out, array(named_struct("
                  "'start', a.at + t.head, 'end', a.at + t.head + t.body))))), a -> a.out)")
    return rows.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
                       F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.split(formatted, TAIL, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    at = lambda p: F.instr(p, MIDDLE)
    return F.transform(turns, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(HEAD) + 1), at(p) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(p, at(p) + len(MIDDLE), F.length(p))).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """Unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
