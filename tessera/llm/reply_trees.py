r"""Operator 2: reply trees to training conversations.

Messages (tree, id, parent, role, text, score) form forests. Root-to-leaf
paths are enumerated by iterative self-joins with doubled steps: after turn k
every message knows its ancestor 2^k replies up, so a path of n messages takes
log2(n) joins; then each leaf's ancestors are filled in by the same steps from
large to small, each exactly once. Branches of a tree are ranked by the mean
score of their messages, and each chosen path becomes one conversation.

The template marks turns as

    <|im_start|>role<|im_sep|>text<|im_end|>\n

Inside roles and texts, a control string of this or another common template
gets ESCAPE after its first character, and ESCAPE itself is doubled. Inserted
ones stand alone and doubled ones in pairs, so `unescape` restores every text.
The loss mask is the code point spans of the assistant texts in the output.

Defined cases: null role or text is empty; a null or unknown parent makes a
root; null scores count 0; of repeated (tree, id) rows the least (role, text)
stays in `chosen_paths`, while `linear_messages` numbers all rows of a
conversation, ties of a turn by role and text; a null tree is one tree; replies
that hang on a cycle have no root and are no path. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut_lineage

from .exchange import NULL_ID

ESCAPE = "␛"
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_CONTROL = re.compile(r"(<(?=\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversation rows as chains of replies: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("tree"),
        (F.row_number().over(order) - 1).cast("long").alias("id"), "role", "text",
        F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("id") > 0, F.col("id") - 1))


def chosen_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """tree, leaf, score, rank, messages (array of step, role, text from the root); all branches unless a top is asked for."""
    rows = messages.groupBy("tree", "id").agg(
        F.min(F.struct("role", "text", "parent", "score")).alias("m")).select(
        "tree", "id", F.col("m.parent").alias("parent"),
        F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"),
        F.coalesce("m.score", F.lit(0.0)).alias("score"))
    rows = cut_lineage(rows)
    known = rows.select("tree", F.col("id").alias("up"))
    jump = cut_lineage(rows.select("tree", "id", F.col("parent").alias("up")).join(known, ["tree", "up"], "left_semi")
                       .select("tree", "id", "up"))
    jumps, turns = [], max(1, rows.count()).bit_length()
    while len(jumps) <= turns and not jump.isEmpty():
        jumps.append(jump)
        far = jump.select("tree", F.col("id").alias("up"), F.col("up").alias("upper"))
        jump = cut_lineage(jump.join(far, ["tree", "up"]).select("tree", "id", F.col("upper").alias("up")))
    nodes = rows.select("tree", "id")
    if not jump.isEmpty():  # still climbing after more turns than any chain has: on or behind a cycle
        nodes = nodes.join(jump.select("tree", "id"), ["tree", "id"], "left_anti")
    parents = rows.select("tree", F.col("parent").alias("id"))
    walk = nodes.join(parents, ["tree", "id"], "left_anti").select(
        "tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up_steps"))
    for k in reversed(range(len(jumps))):
        higher = walk.join(jumps[k], ["tree", "id"]).select(
            "tree", "leaf", F.col("up").alias("id"), (F.col("up_steps") + (1 << k)).alias("up_steps"))
        walk = cut_lineage(walk.unionByName(higher))
    path = (walk.join(rows.drop("parent"), ["tree", "id"]).groupBy("tree", "leaf")
            .agg(F.avg("score").alias("score"),
                 F.sort_array(F.collect_list(F.struct((-F.col("up_steps")).alias("step"), "role", "text"))).alias("messages")))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = path.withColumn("rank", F.row_number().over(best))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1" + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def format_messages(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_messages(formatted: str) -> list[tuple[str, str]]:
    """Inverse of format_messages."""
    turns = formatted.split(END)[:-1]
    pairs = (t[len(START):].split(SEPARATOR, 1) for t in turns)
    return [(unescape(role), unescape(text)) for role, text in pairs]


def format_paths(paths: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, loss (array of start, end)."""
    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            done = [format_messages([(m["role"], m["text"]) for m in ms]) for ms in batch.column("messages").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("tree"), batch.column("leaf"), batch.column("rank"), pa.array([d[0] for d in done], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], span)],
                names=["tree", "leaf", "rank", "formatted", "loss"])
    return paths.select("tree", "leaf", "rank", "messages").mapInArrow(
        run, "tree long, leaf long, rank int, formatted string, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output alone."""
    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = read_messages(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                learnt = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                out.append((len(turns), _hex(told), len(learnt), _hex(learnt), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("rank"),
                 *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))],
                names=["tree", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return formatted.select("tree", "rank", "formatted", "loss").mapInArrow(
        run, "tree long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
