"""Chat formatting from reply trees.

Messages point to the message they answer. Self-joins by doubling (the ancestor 2^k steps up) give each leaf its depth
and score and then its whole path: as many joins as the depth has binary digits, and one row for each message of a
chosen path. Paths are written as turns of a template.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>"
MAX_LEVELS = 40


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations without branches as messages: each row answers the row before it (by turn, then role and text)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    along = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(along).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branch_paths(messages: DataFrame, best: int = 1, stages: Stages | None = None) -> DataFrame:
    """``conv_id, rank, leaf, pos, node`` of the ``best`` root-to-leaf paths of each conversation.

    Branches rank by mean score of their messages, then length (longer first), then leaf. Messages whose parent is
    missing are roots. Messages that lead into a cycle reach no root and lie on no path.
    """
    st = stages or Stages(messages.sparkSession, "trees")
    nodes = st.save(
        messages.groupBy("conv_id", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0)).cast("double")).alias("score")), "nodes"
    )
    known = nodes.select("conv_id", F.col("node").alias("up"))
    up = nodes.select("conv_id", "node", F.col("parent").alias("up"), "score").join(known.withColumn("is", F.lit(True)), ["conv_id", "up"], "left")
    # steps and score of the part of the path from the node to below "up"
    up = st.save(up.select("conv_id", "node", F.when(F.col("is"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "up0")
    levels = [up]
    while len(levels) <= MAX_LEVELS:
        far = up.select(F.col("conv_id").alias("c"), F.col("node").alias("mid"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("total").alias("t2"))
        nxt = up.join(far, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("up") == F.col("mid")), "left").select(
            "conv_id", "node", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total")
        )
        if up.where("up is not null").isEmpty():
            break
        up = st.save(nxt, f"up{len(levels)}")
        levels.append(up)
    whole = up.where("up is null")  # the rest is in cycles
    parents = nodes.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = whole.join(parents, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    paths = st.save(chosen.select("conv_id", "rank", F.col("node").alias("leaf"), F.col("steps").alias("len"), "node", F.lit(0).cast("long").alias("off")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        hop = levels[k].where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        more = paths.join(hop, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("node") == F.col("n"))).select(
            "conv_id", "rank", "leaf", "len", F.col("up").alias("node"), (F.col("off") + (1 << k)).alias("off")
        )
        paths = st.save(paths.union(more), f"paths{k}")
    return paths.select("conv_id", "rank", "leaf", (F.col("len") - F.col("off") - 1).alias("pos"), "node")


def escape_text(text: Column) -> Column:
    """Control strings inside a text lose their form: ``<`` and a bar get one more backslash between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape_text(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def chat_format(messages: DataFrame, best: int = 1, stages: Stages | None = None) -> DataFrame:
    """Turns of the ``best`` branches of each conversation: ``conv_id, rank, pos, segment, loss_start, loss_chars``.

    ``segment`` is the formatted turn (a conversation is its segments in order of ``pos``); the loss mask of an assistant's turn
    covers ``loss_chars`` code points from ``loss_start`` on, the escaped text alone. ``messages``: ``conv_id, node,
    parent, role, text, score``.

    Defined cases: null text or role is empty; a null score counts 0; a null conv_id is a conversation; rows that
    repeat a node count once (smallest role and text); an empty table gives no rows; other columns are not read.
    """
    st = stages or Stages(messages.sparkSession, "chat")
    paths = branch_paths(messages, best, st)
    said = messages.groupBy(F.col("conv_id").alias("c"), F.col("node").alias("n")).agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")
    )
    rows = paths.join(said, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), escape_role(F.col("m.role")), F.lit("\n"))
    body = escape_text(F.col("m.text"))
    ours = F.col("m.role") == "assistant"
    return rows.select(
        "conv_id", "rank", "pos", F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(ours, F.length(head)).cast("long").alias("loss_start"), F.when(ours, F.length(body)).cast("long").alias("loss_chars"),
    )


def read_back_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over segments sorted by (conv_id, rank, pos): digests of what the formatted conversations say. Holds the
    running hashes of one conversation."""
    turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.S)
    names = ["conv_id", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, done = None, []

    def close():
        done.append((*key, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

    def out():
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
        done.clear()
        return rows

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "rank", "segment", "loss_start", "loss_chars")]
        for conv, rank, seg, at, size in zip(*cols):
            if key != (conv, rank):
                if key is not None:
                    close()
                key, n, loss_n, chars = (conv, rank), 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            m = turn.fullmatch(seg)
            if m is None or START in m[2] or END in m[2]:
                raise ValueError(f"conversation {conv}: not one turn: {seg[:80]!r}")
            n, chars = n + 1, chars + len(seg)
            turns.update(f"{unescape_role(m[1])}\n{unescape_text(m[2])}\n".encode())
            if size is not None:
                part = unescape_text(seg[at : at + size])
                loss_n += len(part)
                loss.update(part.encode())
        if done:
            yield out()
    if key is not None:
        close()
        yield out()


def read_back(segments: DataFrame) -> DataFrame:
    """``conv_id, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read from the formatted turns."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        segments.repartition(parts, "conv_id", "rank").sortWithinPartitions("conv_id", "rank", "pos")
        .mapInArrow(read_back_rows, "conv_id long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
