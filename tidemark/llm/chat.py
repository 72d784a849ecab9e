"""Chat formatting over reply trees, in DataFrame functions only.

Root-to-leaf paths come from iterative self-joins on jump pointers: after round ``k`` a leaf
knows its ancestors up to distance ``2**k``, so depth ``d`` takes ``log2(d)`` rounds and the
rows are those of the paths themselves. The pointers are made first, one row for each node, so
nodes on or below a cycle are known and set aside before any path grows. Branches are ranked by
the sum of their scores.

The template writes each turn as ``### role:`` + line end + text + ``</turn>`` + line end. In texts and roles a
backslash, ``#`` and ``<`` are written as ``\\b``, ``\\h`` and ``\\l`` (in roles ``:`` as ``\\c``), so no text can
hold a control string, and undoing the escapes one after another gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, save

OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(x: Column, role: bool = False) -> Column:
    for plain, code in (*_ESCAPES, *[(":", "\\c")] * role):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in ((":", "\\c"), *_ESCAPES[::-1]):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def reply_paths(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parent)`` to ``(leaf, node, dist)``: each leaf with all its ancestors, itself at 0.

    A parent that is not among the nodes makes a root. Nodes on a cycle or below one have no
    path from a root; such leaves are left out.
    """
    known = nodes.select(F.col("node").alias("parent"))
    kept: list[str] = []
    jumps = [save(nodes.select("node", "parent").join(known, "parent", "left_semi").select("node", F.col("parent").alias("up")), kept)]
    left = jumps[0].count()
    while left:
        # Nodes with an ancestor at distance 2**k: of the rooted ones some leave each round, so those that stay when none leaves have no root.
        onward = jumps[-1].select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = save(jumps[-1].join(onward, "up").select("node", F.col("next").alias("up")), kept)
        n = jump.count()
        if n == left:
            break
        jumps.append(jump)
        left = n
    leaves = nodes.select("node").join(jumps[0].select(F.col("up").alias("node")), "node", "left_anti")
    if left:
        leaves = leaves.join(jumps[-1].select("node"), "node", "left_anti")
    done: list[str] = []
    path = save(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), done)
    for k, jump in enumerate(jumps[:-1]):
        more = path.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        path = save(path.unionByName(more), done)
        drop_path(nodes.sparkSession, done.pop(0))
    for old in kept:
        drop_path(nodes.sparkSession, old)
    return path


def format_chats(nodes: DataFrame, *, top_k: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Format root-to-leaf paths of ``nodes(tree, node, parent, role, text, score)``.

    Returns ``(tree, leaf, rank, score, n_turns, formatted, loss_spans)``, the spans in code
    points of ``formatted``, end exclusive, one for each text of ``loss_role``. ``top_k`` keeps
    the best branches of each tree; None keeps all. Ties in score rank by leaf. Null role or
    text: empty; null score: 0; null tree: trees of one null key rank together; a null node: a
    leaf of its own without a path, left out. A repeated node counts once, with its least row.
    Empty input: no rows. Extra columns are not read.
    """
    one = nodes.where("node is not null").groupBy("node").agg(
        F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "tree")).alias("x")
    )
    one = save(one.select("node", "x.*"))
    path = reply_paths(one)
    light = path.join(one.select("node", "score", "tree"), "node")
    branch = light.groupBy("leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.max("dist").alias("deep"), F.max_by("tree", F.struct("dist")).alias("tree"))
    branch = branch.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top_k is not None:
        branch = branch.where(F.col("rank") <= top_k)
        path = path.join(branch.select("leaf"), "leaf", "left_semi")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(AFTER_ROLE))
    body = escape(F.col("text"))
    turns = path.join(one.select("node", "role", head.alias("head"), body.alias("body")), "node")
    whole = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    before = F.coalesce(F.sum(whole).over(W.partitionBy("leaf").orderBy(F.desc("dist")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.length("head"))
    turn = F.struct((-F.col("dist")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("block"), "start", (F.col("start") + F.length("body")).alias("end"), (F.col("role") == loss_role).alias("loss"))
    done = turns.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    done = done.select("leaf", F.array_join(F.transform("t", lambda x: x["block"]), "").alias("formatted"), F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"))
    return done.join(branch, "leaf").select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss_spans")


def linear(rows: DataFrame) -> DataFrame:
    """Nodes of conversations without branches, ``rows(conv_id, turn, role, text)``: each row answers the one before.

    Rows go by turn, ties by role and then text, nulls first; repeated rows stay as turns of
    their own. A conversation scores 0. Null ids are one conversation.
    """
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n)
    at = rows.withColumn("at", at)
    return at.select(F.col("conv_id").alias("tree"), name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_turns(formatted: Column) -> Column:
    """The ``array<struct<role, text>>`` that a formatted text was made of."""
    blocks = F.split(formatted, CLOSE, -1)
    at = lambda x: F.locate(AFTER_ROLE, x)
    turn = lambda x: F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), at(x) - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, at(x) + len(AFTER_ROLE), F.length(x))).alias("text"))
    return F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
