"""Chat formatting of reply trees.

Messages name their parents. Self-joins that double the length of a jump each time give every message
its depth and the sum of scores on its path to the root; leaves are ranked by it, and the same jumps,
longest first, enumerate the chosen leaves' paths. Each path is formatted as one conversation, with a
mask of the assistants' texts, by a template whose control strings are escaped inside texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a chat template or its tokenizer gives a meaning to.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
MASKED_ROLE = "assistant"


def escape(text: str) -> str:
    """Double backslashes, and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of code points that a loss counts. Null is empty."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        out += [head, body, END]
        if role == MASKED_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation holds."""
    parts = [p.split(TEXT, 1) for p in formatted.removeprefix(TURN).removesuffix(END).split(END + TURN)] if formatted else []
    return [(unescape(role), unescape(text)) for role, text in parts]


def chosen_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, node, pos) of the `branches` best root-to-leaf paths of each tree.

    messages: (tree, node, parent, score), none of the first two null, nodes distinct in a tree. A
    parent that isn't there makes a root. Branches rank by their mean score (null counts as zero),
    then by length, the longer first, then by leaf. Messages whose ancestors go round in a circle
    have no root and are left out.
    """
    there = messages.select("tree", F.col("node").alias("parent"))
    inner = messages.where("parent is not null").join(there, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"))
    state = messages.join(inner, ["tree", "node"], "left").select(
        "tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")
    )
    state = scratch.write(state, "jump0")
    n, k = state.count(), 0
    jumps = [state]
    while (1 << k) <= n and not state.where("up is not null").isEmpty():
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("total").alias("total2"))
        going = state.where("up is not null").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("total") + F.col("total2")).alias("total"))
        k += 1
        state = scratch.write(state.where("up is null").union(going), f"jump{k}")
        jumps.append(state)
    leaves = state.where("up is null").join(inner.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("dist") + 1)), F.desc("dist"), "node")
    best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    path = best.select("tree", F.col("node").alias("leaf"), "branch", "node", F.col("dist").alias("pos"))
    path = scratch.write(path, "path0")
    for j in reversed(range(len(jumps))):
        step = jumps[j].where("up is not null").select("tree", "node", "up")
        more = path.join(step, ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("pos") - (1 << j)).alias("pos"))
        path = scratch.write(path.union(more), f"path{len(jumps) - j}")
        scratch.drop(f"path{len(jumps) - j - 1}")
    return path


def format_trees(messages: DataFrame, tree_col: str, node_col: str, parent_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, branches: int = 1) -> DataFrame:
    """(tree, branch, formatted, mask): each chosen path of each tree as one conversation.

    mask holds the spans (start, stop) of code points that a loss counts: the escaped texts of the
    assistants. A null role or text is empty; a null tree is a tree of its own; messages with a null
    node are left out, of repeated nodes the least row is kept. Extra columns are left out.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(
        messages[tree_col].alias("id"), F.coalesce(messages[tree_col].cast("string"), F.lit("\0")).alias("tree"), messages[node_col].alias("node"), messages[parent_col].alias("parent"),
        messages[role_col].alias("role"), messages[text_col].alias("text"), (messages[score_col] if score_col else F.lit(0.0)).cast("double").alias("score"),
    ).where("node is not null")
    rows = scratch.write(rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score", "id")).alias("r")).select("tree", "node", "r.*"), "messages")
    path = chosen_paths(rows.select("tree", "node", "parent", "score"), scratch, branches)
    turns = path.join(rows.select("tree", "node", "id", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    kind = messages.schema[tree_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in ts]) for ts in b.column(2).to_pylist()]
            mask = pa.array([[{"start": a, "stop": z} for a, z in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f for f, _ in made], pa.string()), mask], ["tree", "branch", "formatted", "mask"])

    return whole.select("id", "branch", "turns").mapInArrow(run, f"tree {kind}, branch int, formatted string, mask array<struct<start:long,stop:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, unescaped, both read from formatted and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, masks = b.column("formatted").to_pylist(), b.column("mask").to_pylist()
            turns = pa.array([[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            loss = pa.array(["".join(unescape(x[m["start"] : m["stop"]]) for m in ms) for x, ms in zip(texts, masks, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, turns, loss], [*b.schema.names, "turns", "loss_text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema)
    return formatted.mapInArrow(run, f"{kinds}, turns array<struct<role:string,text:string>>, loss_text string")


def chain(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as messages (conv_id, node, parent, role, text): each replies to the one before.

    Rows stand by turn, equal turns by role and text; repeated rows are turns of their own.
    """
    rows = conversations.select(*(conversations[c].alias(a) for c, a in ((id_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", place)
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
