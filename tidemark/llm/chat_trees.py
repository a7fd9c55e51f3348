"""Chat formatting of reply trees: the best root-to-leaf paths of each tree as one conversation each.

``branches`` finds depth and score of every leaf by pointer doubling: each pass joins the table of
(node, ancestor 2**k steps up) to itself, so a chain of n replies takes log2(n) self-joins and n rows
in each. ``paths`` ranks the leaves of a tree and walks down the same tables from the chosen leaves,
which gives every node of a path once, with its distance from the leaf. ``formatted`` marks turns.

Template: each turn is ``<|role|>text</s>``. In roles and texts ``&``, ``<``, ``[`` and ``|`` are
written as character references, so no text can hold a control string, and reading back is exact.

Defined cases: null text and null role are empty; a parent that is absent makes its child a root;
nodes on a cycle of parents reach no root and are left out; equal scores rank by depth, then by the
leaf's id; equal turns of a conversation are ordered by role, then text; repeated rows are turns
of their own; null trees are a tree of their own; an empty table gives no conversation; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .registry import query
from .support import stage, table, text_of

#: Characters of control strings and how texts write them; the ampersand first, read back last.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;")]
END = "</s>"
ASSISTANT = "assistant"
#: Passes after which a path would be longer than 2**40 replies.
MOST_PASSES = 40


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves with depth and summed score, and the doubling tables (node, up).

    ``nodes`` has tree, node, parent and score; node is unique and not null.
    """
    own = nodes.select("node", F.col("parent"))
    linked = own.join(own.select(F.col("node").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    up = linked.select("node", F.when(F.col("there"), F.col("parent")).alias("up"))
    state = stage(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")).join(up, "node").withColumn("depth", F.lit(1)), "reply-nodes")
    tables = []
    for _ in range(MOST_PASSES):
        step = state.filter(F.col("up").isNotNull()).select("node", "up")
        if not step.take(1):
            break
        before = tables[-1].count() if tables else None
        tables.append(step)
        if before is not None and before == step.count():
            break  # only nodes on cycles are left, which never reach a root
        above = state.select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("deeper")
        )
        state = stage(
            state.join(above, "up", "left").select(
                "tree", "node", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
                (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"), F.col("next").alias("up"),
            ),
            "reply-nodes",
        )
    inner = up.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
    return state.filter(F.col("up").isNull()).join(inner, "node", "left_anti").select("tree", "node", "score", "depth"), tables


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Rows (path, node, place) of the ``best`` branches of each tree; place counts from the root."""
    leaves, tables = branches(nodes)
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    walk = stage(chosen.select(F.col("node").alias("path"), "node", "depth", F.lit(0).alias("back")), "reply-paths")
    for k in range(len(tables) - 1, -1, -1):
        higher = walk.join(tables[k], "node").select("path", F.col("up").alias("node"), "depth", (F.col("back") + (1 << k)).alias("back"))
        walk = stage(walk.unionByName(higher), "reply-paths")
    return walk.select("path", "node", (F.col("depth") - F.col("back")).alias("place"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per path: the formatted text and the character spans (start, end) under the loss mask.

    ``turns`` has conv_id, path, place, role and text.
    """
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>"))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "path", F.struct(
        "place", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"),
        (F.col("role") == ASSISTANT).alias("loss"),
    ).alias("turn"))
    whole = rows.groupBy("path").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        here = acc["at"] + t["head"]
        span = F.array(F.struct(here.alias("start"), (here + t["body"]).alias("end")))
        return F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return whole.select(
        "conv_id", "path", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("turns", start, add)["spans"].alias("loss"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, taken from the formatted text and its spans alone."""
    pieces = F.filter(F.split(F.col("formatted"), END), lambda p: p != "")
    turn = lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, 3, F.length(p)), "|>", 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, "|>") + 2, F.length(p))).alias("text"),
    )
    under = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return conversations.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"))


def chat_format(messages: DataFrame, best: int = 1) -> DataFrame:
    """Format reply trees with columns conv_id, node, parent, score, role and text."""
    nodes = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("tree"), "node", "parent", "score")
    turns = messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    return formatted(turns.join(paths(nodes, best), "node"))


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each row replies to the one before; a branch's score is its length."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    at = lambda place: F.concat_ws("/", tree, F.lpad(place.cast("string"), 12, "0"))
    return rows.select(
        "conv_id", "role", "text", at(F.col("place")).alias("node"), F.when(F.col("place") > 1, at(F.col("place") - 1)).alias("parent"),
        F.length(text_of()).cast("double").alias("score"),
    )


# fixed values of the contract
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_SQL = """
WITH every AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every),
w AS (SELECT *, 8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'))
    + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0, t0)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, r0, t0) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars FROM w GROUP BY conv_id"""


@query("op6_chat_trees", _SQL)
def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    read = read_back(chat_format(as_tree(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
