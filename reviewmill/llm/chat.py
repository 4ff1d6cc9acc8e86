"""Chat formatting of reply trees, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.scratch import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Strings that mark turns in this or other common templates; inside texts they get a backslash after their first character.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
_MOST_LEVELS = 62


def escaped(text: Column) -> Column:
    """Double every backslash, then put one inside every control string; no control string is left."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, depth, id): the root-to-leaf paths of the `branches` leaves of highest score of each tree.

    `messages`: tree, id, parent, score. A path's score is the sum of its messages' scores (null: 0), ties go to the
    smaller leaf. A parent that is null or absent makes a root; every root's leaves compete within the tree. Rows that repeat
    an id count once, with the smallest parent. A circle of replies raises an error.

    Self-joins double the reach of every row's ancestor pointer, so a path of n messages takes about log2 n of them, and
    as many to gather the ancestors of the chosen leaves. Each round is a written table keyed by (tree, id): a tree of any
    size is spread over the tasks.
    """
    nodes = stored(
        messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")),
        "nodes",
    )
    same_tree = F.col("c.tree").eqNullSafe(F.col("p.tree"))
    reach = nodes.alias("c").join(nodes.alias("p"), same_tree & (F.col("c.parent") == F.col("p.id")), "left").select(
        "c.tree", "c.id", F.col("p.id").alias("ancestor"), F.col("c.score").alias("total"), F.lit(1).cast("long").alias("depth")
    )
    levels, whole = [stored(reach, "reach")], None
    while True:
        here = levels[-1]
        rooted, open_ = here.where("ancestor is null"), here.where("ancestor is not null")
        whole = rooted if whole is None else whole.unionByName(rooted)
        if open_.isEmpty():
            break
        if len(levels) > _MOST_LEVELS or (len(levels) > 1 and 2 ** (len(levels) - 1) > nodes.count()):
            raise ValueError("replies form a circle")
        # only rows that have not come to their root go on, each to where its ancestor has come to
        joined = open_.alias("c").join(
            whole.unionByName(open_).alias("p"), same_tree & (F.col("c.ancestor") == F.col("p.id")), "left"
        )
        levels.append(stored(joined.select(
            "c.tree", "c.id", "p.ancestor", (F.col("c.total") + F.col("p.total")).alias("total"),
            (F.col("c.depth") + F.col("p.depth")).alias("depth"),
        ), "reach"))
    leaves = whole.alias("c").join(
        levels[0].where("ancestor is not null").select("tree", F.col("ancestor").alias("id")).distinct().alias("p"),
        same_tree & (F.col("c.id") == F.col("p.id")), "left_anti",
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "id"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    path = chosen.select("tree", F.col("id").alias("leaf"), "branch", "id")
    for level in reversed(levels[:-1]):
        up = path.alias("c").join(
            level.where("ancestor is not null").select("tree", "id", "ancestor").alias("p"),
            same_tree & (F.col("c.id") == F.col("p.id")),
        ).select("c.tree", "c.leaf", "c.branch", F.col("p.ancestor").alias("id"))
        path = stored(path.unionByName(up), "path")
    return path.alias("c").join(
        whole.alias("p"), same_tree & (F.col("c.id") == F.col("p.id"))
    ).select("c.tree", "c.leaf", "c.branch", "p.depth", "c.id")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, branch, turns, formatted, loss): each chosen path as one conversation.

    Every turn is START role newline text END newline, with role and text escaped and newlines of the role preceded by a
    backslash; null role and text are empty. `loss` has (start, length) in code points of each assistant text. Texts are
    taken whole, however long; without paths there are no rows.
    """
    same = F.col("c.tree").eqNullSafe(F.col("p.tree")) & (F.col("c.id") == F.col("p.id"))
    turns = paths.alias("c").join(messages.select("tree", "id", "role", "text").alias("p"), same).select(
        "c.tree", "c.leaf", "c.branch", "c.depth",
        F.coalesce("p.role", F.lit("")).alias("role"), F.coalesce("p.text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    turns = turns.select("*", head.alias("head"), escaped(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(END + "\n"))
    order = Window.partitionBy("tree", "leaf", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(piece)).over(order), F.lit(0)) + F.length("head")
    span = F.when((F.col("role") == LEARNED_ROLE), F.struct(start.alias("start"), F.length("body").alias("length")))
    turns = turns.select("tree", "leaf", "branch", "depth", piece.alias("piece"), span.alias("span"))
    grouped = turns.groupBy("tree", "leaf", "branch").agg(
        F.array_sort(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns")
    )
    return grouped.select(
        "tree", "leaf", "branch", F.size("turns").cast("long").alias("turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>\n")), lambda p: p != "")
    role_end = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.regexp_extract(p, role_end, 1)).alias("role"),
        unescaped(F.regexp_extract(p, role_end, 2)).alias("text"),
    ))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(
        loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))
    ), "")


def as_trees(conversations: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn, role and text, nulls first.
    Repeated rows are messages each; an empty table gives no messages."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(turn, "role", "text"))
    rows = conversations.select(F.col(key).alias("tree"), place.cast("long").alias("id"), "role", "text")
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select("tree", "id", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")
