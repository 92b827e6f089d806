"""Chat formatting of reply trees.

Messages name the message they reply to. Self-joins that double the reach of each step give every message its ancestor 1, 2,
4, ... replies up, with depth and the sum of scores on the way; walking those tables back from the leaves enumerates the
root-to-leaf paths in a logarithm of their length, one row for each message on a path. Paths of a tree are ranked by score,
and each chosen one is written as one conversation with a mask of what counts as loss. Built from DataFrame functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import materialize

HEAD, MIDDLE, TAIL = "<turn>### ", ":\n", "</turn>\n"
_TURN = r"<turn>### ([^<#:]*):\n([^<#]*)</turn>\n"
#: What can be part of a control string, and what stands for it inside texts; the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _role(text: Column) -> Column:
    return F.replace(escape(text), F.lit(":"), F.lit("&colon;"))


def _unrole(text: Column) -> Column:
    return unescape(F.replace(text, F.lit("&colon;"), F.lit(":")))


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) of the ``keep`` best paths of each tree, from messages (tree, node, parent, score).

    ``node`` is unique. A message whose parent is null or absent is a root. The rank goes by the sum of scores (null: 0), higher
    first, then by the leaf. Messages on a cycle of replies, and those below one, have no root and are on no path.
    """
    own = materialize(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    nodes = own.select(F.col("node").alias("parent2"))
    tied = own.join(nodes, F.col("parent") == F.col("parent2"), "left")
    # up: the message so many replies above (null: the root has been passed); steps and score: of the messages on the way
    step = materialize(tied.select("tree", "node", F.col("parent2").alias("up"), F.lit(1).cast("long").alias("steps"), "score"), "replies")
    n, steps, rooted = own.count(), [], step.filter("up is null")
    step = step.filter("up is not null")
    while not step.isEmpty() and 2 ** len(steps) <= 2 * max(n, 1):
        steps.append(step)
        above = step.unionByName(rooted).select(F.col("node").alias("node2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        both = step.join(above, F.col("up") == F.col("node2"))
        step = materialize(both.select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score")), "replies")
        rooted = rooted.unionByName(step.filter("up is null"))
        step = step.filter("up is not null")
    answered = own.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    found = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("steps") - 1).alias("depth"))
    for i in range(len(steps) - 1, -1, -1):
        up = steps[i].select(F.col("node").alias("node2"), "up")
        higher = found.join(up, F.col("node") == F.col("node2")).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - 2**i).alias("depth"))
        found = materialize(found.unionByName(higher), "paths")
    return found


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_mask) of the chosen paths, from messages (tree, node, parent, score, role, text).

    ``loss_mask`` holds (start, length) in code points of each text by the role "assistant", as escaped. Null roles and texts
    count as empty; an empty table gives an empty result. A path is one row, so it must fit in a task; a tree may be any size.
    """
    texts = messages.select(F.col("node").alias("node2"), _role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), (F.col("role") == "assistant").alias("loss"))
    on = paths(messages, keep).join(texts, F.col("node") == F.col("node2"))
    head = F.concat(F.lit(HEAD), F.col("role"), F.lit(MIDDLE))
    on = on.withColumn("head", F.length(head)).withColumn("turn", F.concat(head, F.col("text"), F.lit(TAIL)))
    ahead = F.sum(F.length("turn")).over(Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    on = on.withColumn("at", F.coalesce(ahead, F.lit(0)) + F.col("head"))
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn", "loss", "at", F.length("text").alias("length"))))
    paths_ = on.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), turns.alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["at"].alias("start"), t["length"].cast("long").alias("length")))
    return paths_.select("tree", "leaf", "rank", F.array_join("turns.turn", "").alias("formatted"), mask.alias("loss_mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """The given columns with roles, texts and loss_text as read from ``formatted`` and ``loss_mask`` alone."""
    part = lambda i, undo: F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(i)), undo)
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return conversations.select("*", part(1, _unrole).alias("roles"), part(2, unescape).alias("texts"), F.array_join(loss, "").alias("loss_text"))


def chains(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before it. Rows of a conversation go by turn (null first),
    those of the same turn by role and text, so repeated rows follow each other; rows without a conversation form one."""
    rows = conversations.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    nr = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    # a conversation without an id has names of its own, which no id can give
    name = lambda n: F.concat(F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")), F.lit(":"), n.cast("string"))
    return rows.withColumn("nr", nr).select("tree", name(F.col("nr")).alias("node"), F.when(F.col("nr") > 1, name(F.col("nr") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
