"""Chat formatting over reply trees (DataFrame functions only).

Messages form trees through ``parent_id``.  Self-joins that double the reach of
each message's ancestor pointer give depth, root and branch score of every
message in log2(depth) rounds; a second run of self-joins halves each
root-to-leaf path into its messages.  Work is proportional to the paths put out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import scratch, written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Make ``text`` free of control strings: backslash doubled, ``<|`` cut by a backslash."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths: (tree_id, leaf_id, branch_rank, branch_score, msg_id, depth).

    ``messages`` has tree_id, msg_id (unique in its tree, not null), parent_id
    and score.  A parent that does not exist makes a message a root; messages
    that only lead into a ring of parents have no root and give no path.  Leaves
    of a tree are ranked by the mean score of their path (null scores count 0),
    ties by msg_id; ``branches`` keeps the best so many, None all.
    """
    with scratch(messages.sparkSession) as keep:
        ids = messages.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_p"))
        base = messages.select("tree_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
        nodes = (
            base.join(ids, base.tree_id.eqNullSafe(ids._t) & (base.parent_id == ids._p), "left")
            .select("tree_id", "msg_id", F.array("_p").alias("jumps"), "total", F.lit(1).cast("long").alias("size"))
        )
        nodes = written(nodes, "chat-nodes")
        limit = max(2, nodes.count())
        k = 0
        # After round k a message knows its ancestor 2^k steps up and the sums up to it.
        while (1 << k) < 2 * limit and not nodes.where(F.col("jumps")[k].isNotNull()).isEmpty():
            up = nodes.select(
                F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("jumps")[k].alias("_up"),
                F.col("total").alias("_total"), F.col("size").alias("_size"),
            )
            nodes = (
                nodes.join(up, nodes.tree_id.eqNullSafe(up._t) & (F.col("jumps")[k] == up._m), "left")
                .select(
                    "tree_id", "msg_id", F.concat("jumps", F.array("_up")).alias("jumps"),
                    (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
                    (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
                )
            )
            nodes = written(nodes, "chat-nodes")
            k += 1
        rooted = nodes.where(F.col("jumps")[k].isNull())
        parents = nodes.select(F.col("tree_id").alias("_t"), F.col("jumps")[0].alias("_m")).where("_m is not null").distinct()
        leaves = rooted.join(parents, rooted.tree_id.eqNullSafe(parents._t) & (rooted.msg_id == parents._m), "left_anti")
        best = Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf_id")
        leaves = leaves.select(
            "tree_id", F.col("msg_id").alias("leaf_id"), (F.col("total") / F.col("size")).alias("branch_score"), "size"
        ).withColumn("branch_rank", F.row_number().over(best))
        if branches is not None:
            leaves = leaves.where(F.col("branch_rank") <= branches)
        pieces = leaves.select("tree_id", "leaf_id", "branch_rank", "branch_score", F.col("leaf_id").alias("msg_id"), "size", F.col("size").alias("depth"))
        pieces = written(pieces, "chat-pieces")
        for j in range(k - 1, -1, -1):
            half = 1 << j
            jump = nodes.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("jumps")[j].alias("_up"))
            long = pieces.where(F.col("size") > half)
            cut = long.join(jump, long.tree_id.eqNullSafe(jump._t) & (long.msg_id == jump._m)).select(
                "tree_id", "leaf_id", "branch_rank", "branch_score",
                F.explode(F.array(
                    F.struct(F.col("msg_id").alias("m"), F.lit(half).cast("long").alias("s"), F.col("depth").alias("d")),
                    F.struct(F.col("_up").alias("m"), (F.col("size") - half).alias("s"), (F.col("depth") - half).alias("d")),
                )).alias("x"),
            ).select("tree_id", "leaf_id", "branch_rank", "branch_score", F.col("x.m").alias("msg_id"), F.col("x.s").alias("size"), F.col("x.d").alias("depth"))
            pieces = written(pieces.where(F.col("size") <= half).unionByName(cut), "chat-pieces")
        keep(pieces)
        return pieces.drop("size")


def format_chats(messages: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, branch_rank, formatted, loss_spans.

    Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` with control strings
    inside role and text escaped.  ``loss_spans`` holds [start, end) code point
    offsets of the texts of ``loss_role``.  Null text or role counts as empty, texts
    may be of any length, other columns are not read.  Messages that repeat tree and
    id are each formatted, in no defined order; ``linear_messages`` numbers rows
    anew, so there ties and repeated rows have a place.  An empty table gives an
    empty result.
    """
    paths = reply_paths(messages.select("tree_id", "msg_id", "parent_id", "score"), branches)
    body = messages.select(
        F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = paths.join(body, paths.tree_id.eqNullSafe(body._t) & (paths.msg_id == body._m)).select(
        "tree_id", "leaf_id", "branch_rank", "depth",
        F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("said"),
        (F.col("role") == loss_role).alias("learn"),
    )
    # Offsets by running sums, so a path of many turns takes no more than their sort.
    tail = END + "\n"
    size = F.char_length("head") + F.char_length("said") + F.lit(len(tail))
    before = Window.partitionBy("tree_id", "leaf_id", "branch_rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")).cast("int")
    turns = turns.withColumn("span", F.when(F.col("learn"), F.struct(start.alias("start"), (start + F.char_length("said")).cast("int").alias("end"))))
    told = turns.groupBy("tree_id", "leaf_id", "branch_rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "said", F.lit(tail)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"),
    )
    return told.select("tree_id", "leaf_id", "branch_rank", F.concat_ws("", "turns.turn").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """Parse a formatted conversation into array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    body = F.filter(pieces, lambda p: p != "")
    head = lambda p: F.regexp_extract(p, r"^<\|im_start\|>((?:[^\\\n]++|(?s:\\.))*+)\n", 1)
    return F.transform(body, lambda p: F.struct(
        unescape(head(p)).alias("role"),
        unescape(F.substring(p, F.lit(len(START) + 2) + F.char_length(head(p)), F.char_length(p))).alias("text"),
    ))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, pieces joined with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations stored by turn as one-branch trees.

    Turns are numbered anew by (turn, role, text), nulls first, so ties and
    repeated rows have a defined place; a null conv_id is one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col("conv_id").alias("tree_id"), F.col("_n").alias("msg_id"),
        F.when(F.col("_n") > 1, F.col("_n") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"),
    )
