"""Operator 8: chat formatting of reply trees, in DataFrame operations only.

Messages are nodes of trees. Root-to-leaf paths are found by self-joins that double the reach of each ancestor pointer, so their
number follows the logarithm of the depth. Branches are ranked by the mean score of their messages; the best of each tree are
formatted, each as one conversation. A turn is written as

    <|start|>role\\ntext<|end|>\\n

and control strings inside roles and texts are escaped: after the first character of anything that reads like one, with any number of
backslashes behind that character, one more backslash is put. Taking one away restores the text, and no escaped text holds a turn mark
of the template (of `<</SYS>>`, a control string of others, the inner `</SYS>>` stays readable). The loss mask is a list of byte ranges (start, length) of the UTF-8 formatted conversation: the escaped assistant texts.

Defined cases: a null text is empty and a null role is the empty role; messages with the same place in a conversation follow one
another by role and text; a message whose parent is missing is a root; messages on a cycle have no root and are left out; a conversation
without an assistant has an empty mask; a null tree id is a tree of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

START, END = "<|start|>", "<|end|>"
#: Control strings of this and of other common templates, each as its first character and the rest, in regular expressions.
CONTROL = r"(<)(\\*)(\|[a-z_]+\|>|/?s>|</?SYS>>|/SYS>>)|(\[)(\\*)(/?INST\])"
QUOTED = r"(<)\\(\\*)(\|[a-z_]+\|>|/?s>|</?SYS>>|/SYS>>)|(\[)\\(\\*)(/?INST\])"


def escape(text: F.Column) -> F.Column:
    """Reversible: no turn mark is left."""
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, QUOTED, r"$1$4$2$5$3$6")


def linear_tree(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of conversations as trees without branches: (tree, node, parent, role, text, score); node numbers are places."""
    turns = rows.select(F.col(tree).alias("tree"), F.col(order).alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("place", "role", "text")).cast("long")
    numbered = turns.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, node, depth) of the messages on the chosen paths, depth 0 at the leaf. best: paths kept of a tree (None: all), by falling
    mean score, then by leaf. messages: a written table."""
    own = messages.select(F.struct("tree", "node").alias("node"), F.struct("tree", F.col("parent").alias("node")).alias("parent"), "score")
    known = messages.select(F.struct("tree", "node").alias("parent"), F.lit(True).alias("there"))
    parent = F.when(F.col("there"), F.col("parent"))
    rooted = written(own.join(known, "parent", "left").select("node", parent.alias("parent"), "score"))
    # reach: for each node its ancestor 2 ** k above, and the number and the score of the nodes below that ancestor
    reach = written(rooted.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), "score"))
    jumps, depth = [], reach.count().bit_length()
    while True:
        live = reach.where("up IS NOT NULL")
        if live.isEmpty():
            break
        jumps.append(live.select("node", "up", "n"))
        above = reach.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("n").alias("n2"), F.col("score").alias("s2"))
        grown = live.join(above, "up").select("node", F.col("next").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("score") + F.col("s2")).alias("score"))
        reach = written(reach.where("up IS NULL").unionByName(grown))
        if len(jumps) >= depth:  # only cycles are left: their nodes never reach a root
            break
    reach = reach.where("up IS NULL")
    leaves = reach.join(rooted.where("parent IS NOT NULL").select(F.col("parent").alias("node")), "node", "left_anti")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("node.tree").orderBy(F.desc(F.col("score") / F.col("n")), "node"))
        leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= best)
    path = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    for jump in reversed(jumps):  # from the longest jump to the shortest, each place is met once
        longer = path.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("depth") + F.col("n")).alias("depth"))
        path = written(path.unionByName(longer))  # else the plan doubles with each jump
    return path.select("node.tree", F.col("leaf.node").alias("leaf"), "node.node", "depth")


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, formatted, mask array<struct<start, length>>): one row for each chosen path of messages (tree, node, parent, role,
    text, score)."""
    kept = written(messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    paths = chosen_paths(kept.select("tree", "node", "parent", "score"), best)
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    turns = kept.select(F.struct("tree", "node").alias("key"), "role", head.alias("head"), escape(F.col("text")).alias("body"))
    met = paths.withColumn("key", F.struct("tree", "node")).join(turns, "key").withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = F.sum(F.octet_length("turn")).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("depth"))) - F.octet_length("turn")
    span = F.when(F.col("role") == "assistant", F.struct((before + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length")))
    laid = met.withColumn("span", span).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "turn", "span"))).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull())
    return laid.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("mask"))


def read_turns(formatted: F.Column) -> F.Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.split(formatted, r"<\|end\|>\n")
    marked = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bodies = F.transform(marked, lambda x: F.substring(x, len(START) + 1, 2**31 - 1))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(bodies, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))


def read_loss(formatted: F.Column, mask: F.Column) -> F.Column:
    """The texts under the mask: array<string>."""
    raw = F.encode(formatted, "UTF-8")
    return F.transform(mask, lambda m: unescape(F.decode(F.substr(raw, (m["start"] + 1).cast("int"), m["length"].cast("int")), "UTF-8")))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formats conversations and reads them back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    made = written(format_trees(linear_tree(conversations), best=1))  # a conversation's best branch is all of it
    read = made.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(read_loss(F.col("formatted"), F.col("mask")), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*)(\|[a-z_]+\|>|/?s>|</?SYS>>|/SYS>>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS x FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(x) + 18)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
