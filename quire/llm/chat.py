"""Chat formatting: conversations from reply trees, in a template that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Scratch

OPEN, AFTER_ROLE, CLOSE = '<turn role="', '">\n', "\n</turn>\n"


def escape(text: Column) -> Column:
    """Text in which no control string can occur: every one holds `<` or, in a role, a double quote."""
    out = F.coalesce(text, F.lit(""))
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    for coded, raw in (("&quot;", '"'), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _same(left: str, right: str) -> Column:
    return F.col(f"x.{left}").eqNullSafe(F.col(f"y.{right}"))


class ReplyTrees:
    """The branches of reply trees, from messages (tree, node, parent, score); nodes are unique in their tree.

    Jump tables of 1, 2, 4, ... steps towards the root are made by self-joins that add up the scores on the way; every leaf then takes the
    jumps in falling order, so a tree d deep takes 2 log2(d) joins and a row a leaf, not one for each message of each branch. A parent
    that isn't in the tree, or null, makes a root. Messages on a cycle, and those that answer them, have no root and
    are on no branch: they are those that can take as many steps as their tree has messages. Each round is written to the shared folder.
    """

    def __init__(self, messages: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.nodes = nodes = scratch.save(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
        up = nodes.alias("x").join(nodes.select("tree", "node", "score").alias("y"), _same("tree", "tree") & (F.col("x.parent") == F.col("y.node")))
        self.jumps = [scratch.save(up.select("x.tree", "x.node", F.col("y.node").alias("over"), F.col("y.score").alias("sum")), "jump-0")]
        most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
        while (1 << (len(self.jumps) - 1)) < most:
            last = self.jumps[-1]
            step = last.alias("x").join(last.alias("y"), _same("tree", "tree") & (F.col("x.over") == F.col("y.node")))
            step = scratch.save(step.select("x.tree", "x.node", "y.over", (F.col("x.sum") + F.col("y.sum")).alias("sum")), f"jump-{len(self.jumps)}")
            if step.isEmpty():
                break
            self.jumps.append(step)
        self.looping = self.jumps.pop() if (1 << (len(self.jumps) - 1)) >= most and len(self.jumps) > 1 else None

    def branches(self) -> DataFrame:
        """(tree, leaf, root, score, length): a row a branch, score being the mean of its messages' scores, to nine places."""
        parents = self.jumps[0].select("tree", F.col("over").alias("node"))
        leaves = self.nodes.alias("x").join(parents.alias("y"), _same("tree", "tree") & _same("node", "node"), "left_anti")
        if self.looping is not None:
            leaves = leaves.alias("x").join(self.looping.alias("y"), _same("tree", "tree") & _same("node", "node"), "left_anti")
        ends = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("root"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("length"))
        for k in reversed(range(len(self.jumps))):
            moved = ends.alias("x").join(self.jumps[k].alias("y"), _same("tree", "tree") & _same("root", "node"), "left")
            far = F.col("y.over").isNotNull()
            ends = moved.select(
                "x.tree", "x.leaf", F.coalesce("y.over", "x.root").alias("root"), (F.col("x.sum") + F.coalesce("y.sum", F.lit(0.0))).alias("sum"), (F.col("x.length") + F.when(far, 1 << k).otherwise(0)).alias("length")
            )
            ends = self.scratch.save(ends, f"ends-{k}")
        return ends.select("tree", "leaf", "root", F.round(F.col("sum") / F.col("length"), 9).alias("score"), "length")

    def paths(self, branches: DataFrame) -> DataFrame:
        """`branches` with node and depth: a row for each message of a branch, depth counting from the leaf."""
        kept = [c for c in branches.columns if c not in ("node", "depth")]
        paths = branches.select(*kept, F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
        for k in reversed(range(len(self.jumps))):
            further = paths.alias("x").join(self.jumps[k].alias("y"), _same("tree", "tree") & _same("node", "node"))
            paths = paths.union(further.select(*(f"x.{c}" for c in kept), F.col("y.over").alias("node"), F.col("x.depth") + (1 << k)))
            paths = self.scratch.save(paths, f"paths-{k}")
        return paths


def reply_paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """All root-to-leaf paths: (tree, leaf, root, node, depth), a row for each message of each branch of `messages` (tree, node, parent)."""
    trees = ReplyTrees(messages.withColumn("score", F.lit(0.0)), scratch)
    return trees.paths(trees.branches().select("tree", "leaf", "root"))


def conversations(messages: DataFrame, scratch: Scratch, top: int = 1, learn_role: str = "assistant") -> DataFrame:
    """(tree, root, leaf, score, rank, formatted, loss_spans): the `top` best branches below each root as conversations.

    `messages`: tree, node, parent, role, text, score. A branch scores the mean of its messages' scores (null: 0); ties go to
    the longer branch, then to the smaller leaf. Branches are ranked as rows of their own; only those chosen are walked again for their messages.
    Each turn is written `<turn role="ROLE">`, newline, text, newline, `</turn>`, newline,
    role and text escaped. `loss_spans` are the places (start, end) in code points of the texts by `learn_role`, in order.

    Null roles and texts are empty; a null tree is a tree like others; further columns are ignored. Messages on a cycle, and those that
    answer them, are on no branch. Empty tables give no rows. No step is Python: paths are self-joins, places are running sums in
    a window over one branch, which is one row of the result in the end.
    """
    trees = ReplyTrees(messages, scratch)
    facts = messages.select("tree", "node", "role", "text")
    best = Window.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("length"), "leaf")
    ranked = trees.branches().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    chosen = trees.paths(scratch.save(ranked.drop("length"), "chosen"))

    def on(right: str) -> Column:
        return _same("tree", "tree") & _same("node", right)

    turns = chosen.alias("x").join(facts.alias("y"), on("node"))
    head = F.concat(F.lit(OPEN), escape(F.col("y.role")), F.lit(AFTER_ROLE))
    turns = turns.select("x.*", head.alias("head"), escape(F.col("y.text")).alias("body"), F.coalesce(F.col("y.role") == learn_role, F.lit(False)).alias("learn"))
    turns = turns.withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    turn = F.struct((-F.col("depth")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("learn"), span).alias("span"))
    whole = turns.groupBy("tree", "root", "leaf", "score", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree", "root", "leaf", "score", "rank",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, F.lit(CLOSE))
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, AFTER_ROLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        text = F.substring(piece, cut + len(AFTER_ROLE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text that the mask marks, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def sequence_of_turns(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Flat conversations as reply trees: each turn answers the one before; equal turns go by role, then text. The turns of one conversation
    are sorted in one task, as they are one row of text in the end."""
    order = Window.partitionBy(conversation).orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(F.col(conversation).alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
