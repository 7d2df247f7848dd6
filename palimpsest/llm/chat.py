"""Chat formatting of reply trees.

A tree is rows (tree, node, parent, role, text, score). Ancestors are found by binary lifting: the
k-th self-join maps each node to its ancestor 2^k steps up and the score on the way, so that a tree of
depth d takes log2(d) joins on ids; the texts join once, to the nodes of the chosen paths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, text_of

#: The template's marks, as fixed values.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    r"""No mark can be left in the result: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    r"""As ``escape``, and a line feed becomes ``\n``: a role ends at the first line feed."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations without branches as trees: each turn answers the one before it.

    Equal turns follow in the order of role, then text; null turns come first.
    """
    by = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col(tree).alias("tree"), F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), text_of(text).alias("text")
    )
    rows = rows.withColumn("node", F.row_number().over(by).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, pos): the ``top`` root-to-leaf paths of each root, best first.

    A path's score is the mean score of its nodes (null: 0); ties go to the smaller leaf. A node whose
    parent is null or missing is a root. Rows that repeat (tree, node) count once. Nodes on a cycle, or
    below one, have no root and so no path.
    """
    score = F.coalesce(F.col("score"), F.lit(0.0)).cast("double")
    node = nodes.where("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(score).alias("score"))
    node = cut(node, "nodes")
    known = node.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    up = node.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    up = cut(up.select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("steps")), "up")
    # climbing: nodes with the ancestor that they have reached; done: nodes with the sums up to their root
    done, climbing = up.where("up is null").drop("up"), up.where("up is not null")
    lifts, left, bound = [], climbing.count(), node.count()
    while left and 1 << len(lifts) <= bound:  # beyond the bound, what is left are cycles
        lifts.append(climbing.select("tree", "node", "up"))
        name = lambda rows, above: rows.select(F.col("tree").alias("t"), F.col("node").alias("m"), above.alias("up2"), F.col("score").alias("s2"), F.col("steps").alias("n2"))
        above = name(climbing, F.col("up")).union(name(done, F.lit(None).cast(dict(climbing.dtypes)["up"])))
        joined = climbing.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        joined = cut(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("steps") + F.col("n2")).alias("steps")), "up")
        done, climbing = done.union(joined.where("up is null").drop("up")), joined.where("up is not null")
        left = climbing.count()
    inner = node.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaf = done.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "node")
    leaf = leaf.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    path = leaf.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("steps").alias("pos"))
    for k in range(len(lifts) - 1, -1, -1):  # each known node of a path adds the one 2^k steps above it
        lift = lifts[k].select(F.col("tree").alias("t"), F.col("node").alias("m"), "up")
        more = path.join(lift, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")))
        path = path.union(more.select("tree", "leaf", "rank", F.col("up"), F.col("pos") - (1 << k)))
        if k:
            path = cut(path, "path")
    return path


def format_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, n_turns, formatted, loss_spans.

    ``loss_spans`` holds (block, begin, stop) of each assistant text in ``formatted``, in code points, and
    ``block_begin``, where its turn's block begins. Null roles and texts are empty. Texts that repeat a
    (tree, node) are one node: the smallest (role, text) stays.
    """
    path = chosen_paths(nodes, top)
    said = F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"), text_of("text").alias("text"))
    body = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), said.alias("said"))
    body = body.groupBy("t", "m").agg(F.min("said").alias("said"))
    rows = path.join(body, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")))
    head = F.concat(F.lit(START), escape_role(F.col("said.role")), F.lit("\n"))
    rows = rows.select(
        "tree", "leaf", "rank", "pos", head.alias("head"), escape(F.col("said.text")).alias("text"), (F.col("said.role") == LEARNED).alias("learned")
    )
    rows = rows.withColumn("block", F.concat("head", "text", F.lit(END)))
    upto = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.sum(F.length("block").cast("long")).over(upto) - F.length("block"))
    begin = F.col("at") + F.length("head")
    span = F.when(
        F.col("learned"), F.struct((F.col("pos") - 1).alias("block"), F.col("at").alias("block_begin"), begin.alias("begin"), (begin + F.length("text")).alias("stop"))
    )
    rows = rows.groupBy("tree", "leaf", "rank").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("blocks"), F.array_sort(F.collect_list(span)).alias("loss_spans")
    )
    return rows.select("tree", "leaf", "rank", "n_turns", F.array_join(F.col("blocks.block"), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(block: Column) -> Column:
        line = F.instr(block, "\n")
        text = F.substring(block, line + 1, F.length(block) - line - len(END))
        return F.struct(unescape_role(F.substring(block, F.lit(1), line - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; each span is read in its own block."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)

    def cut_out(span: Column) -> Column:
        block = F.get(blocks, (span["block"] + 1).cast("int"))
        begin = span["begin"] - span["block_begin"] - len(START) + 1
        return unescape(F.substring(block, begin.cast("int"), (span["stop"] - span["begin"]).cast("int")))

    return F.array_join(F.transform(spans, cut_out), "")
