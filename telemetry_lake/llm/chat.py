"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the distance of each message's known ancestor, so a
tree of depth d takes log2(d) rounds; they give every message its depth and the sum of scores from the root.  Root-to-leaf
paths are ranked within their tree by mean score (ties: the longer, then the smaller leaf), the best ``top`` are kept, and the
same tables of ancestors, read from the farthest to the nearest, enumerate the messages of the kept paths, each once.  The
messages are joined to their texts, dealt by path, sorted by position and written as one conversation.

The template marks turns with control strings; where a text holds one, a backslash is put after its first character, and
every backslash is doubled, so texts can be read back exactly.  The loss mask covers the assistants' texts and nothing else.

Defined cases: NULL texts and roles are empty; a message whose parent is missing is a root; messages on a cycle belong to no
tree; repeated rows are messages of their own; an empty table gives no rows; other columns are ignored.  In a table of
conversations, rows follow by turn (NULL turns last), then role and text, and rows without conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

# The template's control strings.
OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": "\n<</SYS>>\n", "user": " [/INST]", "assistant": " </s>"}
OTHER_ROLE, OTHER_OPEN, OTHER_CLOSE = "[ROLE]", "[TURN]", "[/TURN]"
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TURN]", "[/TURN]")

to_escape = re.compile("|".join([re.escape(c) for c in CONTROL] + [r"\\"]))
escaped = re.compile(r"\\(.)", re.S)
turn = re.compile("|".join(
    [f"{re.escape(OPEN[r])}(?P<{r}>.*?){re.escape(CLOSE[r])}" for r in OPEN]
    + [rf"{re.escape(OTHER_ROLE)}(?P<role>.*?){re.escape(OTHER_OPEN)}(?P<other>.*?){re.escape(OTHER_CLOSE)}"]), re.S)

FORMATTED = "conv_id long, formatted string, loss array<struct<start: long, length: long>>"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escape(text: str) -> str:
    return to_escape.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return escaped.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """(the conversation, spans of the assistants' texts in it) from (role, text) in order."""
    out, at, loss = [], 0, []
    for role, text in turns:
        body = escape(text)
        before = OPEN.get(role) or f"{OTHER_ROLE}{escape(role)}{OTHER_OPEN}"
        if role == "assistant":
            loss.append({"start": at + len(before), "length": len(body)})
        whole = before + body + (CLOSE.get(role) or OTHER_CLOSE)
        out.append(whole)
        at += len(whole)
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) that ``format_turns`` wrote."""
    out = []
    for m in turn.finditer(formatted):
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if role == "other" else (role, unescape(m[role])))
    return out


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(path, node, position) of the messages on the best ``top`` root-to-leaf paths of each tree.

    ``messages``: tree, node (unique), parent (NULL at a root), score.
    """
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent"))
    up = messages.select("node", "score").join(
        nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("far")), "node", "left")
    up = written(up.select("node", "far", F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"),
                           F.lit(1).cast("long").alias("depth")), "ancestors")
    total = up.count()
    jumps = []
    while (1 << len(jumps)) <= 2 * total:
        open_ = up.where(F.col("far").isNotNull())
        if open_.isEmpty():
            break
        jumps.append(open_.select("node", "far"))
        onward = up.select(F.col("node").alias("far"), F.col("far").alias("farther"), F.col("sum").alias("sum2"),
                           F.col("depth").alias("depth2"))
        moved = open_.join(onward, "far").select(  # only messages that have not met their root move on
            "node", F.col("farther").alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"),
            (F.col("depth") + F.col("depth2")).alias("depth"))
        up = written(up.where(F.col("far").isNull()).unionByName(moved), "ancestors")
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    leaves = (up.where(F.col("far").isNull()).join(parents, "node", "left_anti")
              .join(messages.select("node", "tree"), "node"))
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("depth")), F.desc("depth"), "node")
    kept = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    on_path = kept.select(F.col("node").alias("path"), "node", F.col("depth").alias("position"))
    for k in range(len(jumps) - 1, -1, -1):
        farther = (on_path.join(jumps[k], "node")
                   .select("path", F.col("far").alias("node"), (F.col("position") - (1 << k)).alias("position")))
        on_path = written(on_path.union(farther), "paths")
    return on_path


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """One ``FORMATTED`` row per kept path of ``messages``: tree, node, parent, score, role, text."""
    paths = best_paths(messages, top)
    rows = paths.join(messages.select("node", F.col("tree").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
                                      F.coalesce("text", F.lit("")).alias("text")), "node")
    ordered = rows.repartition("path").sortWithinPartitions("path", "position")
    return ordered.select("path", "conv_id", "role", "text").mapInArrow(joined, FORMATTED)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over turns sorted by path: holds one conversation at a time."""
    def row(conv, turns) -> pa.RecordBatch:
        text, loss = format_turns(turns)
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": text, "loss": loss}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    path, conv, turns = None, None, []
    for batch in batches:
        done = []
        for p, c, role, text in zip(*(batch.column(x).to_pylist() for x in ("path", "conv_id", "role", "text"))):
            if p != path and turns:
                done.append(row(conv, turns))
                turns = []
            path, conv = p, c
            turns.append((role, text))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if turns:
        yield row(conv, turns)


def read_back(formatted: DataFrame) -> DataFrame:
    """``DIGESTS`` of each conversation, from the formatted text and its loss mask alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = read_turns(r["formatted"])
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned = "".join(unescape(r["formatted"][s["start"]:s["start"] + s["length"]]) for s in r["loss"])
                rows.append((r["conv_id"], len(turns), whole.hexdigest(), len(learned),
                             hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(r["formatted"])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 [c.split()[0] for c in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row answers the row before it."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                                F.monotonically_increasing_id().alias("node"))
    rows = written(rows, "messages")  # the row numbers hold from here on
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_last("turn"), "role", F.xxhash64("text"), "node")
    links = rows.select("node", F.lag("node").over(order).alias("parent"))
    return rows.join(written(links, "links"), "node").withColumn("score", F.lit(0.0))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_paths(chained(talks)))
