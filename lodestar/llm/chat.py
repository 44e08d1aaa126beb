"""Chat formatting over reply trees.

Messages form trees by ``parent``. Iterative self-joins with doubled steps give every message its root and depth (as
many rounds as the logarithm of the longest chain); leaves are ranked by branch score and the best path of each root is
formatted as one conversation. A plain table of turns is the tree in which each turn replies to the one before.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. Control strings inside roles and texts, and the
escape character itself, are written as ``\\c<number>;``, so no control string is left inside a turn and reading
back restores it. The loss mask lists the spans (code points, end exclusive) of assistant texts.

Defined results: null text is empty, a null role is the empty role; turns with equal numbers are ordered by role,
then text; repeated rows are repeated turns; rows with a null turn come first; an empty table gives no rows; extra columns
are ignored; messages whose parent is missing are roots, and a cycle of parents is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that common chat templates give a meaning.
CONTROL = ["\\", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CODE = {s: f"\\c{i};" for i, s in enumerate(CONTROL)}
_FIND = re.compile("|".join(re.escape(s) for s in sorted(CONTROL, key=len, reverse=True)))
_CODED = re.compile(r"\\c([0-9]+);")


def escape(text: str) -> str:
    return _FIND.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: CONTROL[int(m[1])], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask; a role's line breaks are escaped by doubling the code."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\c10;") + MIDDLE
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(MIDDLE)
        turns.append((unescape(role.replace("\\c10;", "\n")), unescape(text)))
    return turns


def best_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, root, depth, role, text) of the best root-to-leaf path of every tree.

    ``messages``: node, parent, conv_id, role, text, score. A branch's score is the mean of its messages' scores;
    ties go to the longer branch, then to the leaf with the smaller node id. Every tree yields one conversation.
    """
    nodes = Saved(messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes").df
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_has"))
    hops = Saved(nodes.join(known, "parent", "left").select("node", F.when(F.col("_has"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), F.col("node").alias("root")), "hops").df
    # only chains that haven't reached their root take part in a round; the others are set aside
    done: list[DataFrame] = []
    columns = ["node", "up", "depth", "total", "root"]
    for _ in range(nodes.count().bit_length() + 1):  # steps double, so a longer walk has met a node twice
        done.append(hops.where("up IS NULL"))
        hops = hops.where("up IS NOT NULL")
        if hops.isEmpty():
            break
        every = hops
        for d in done:
            every = every.union(d)
        above = every.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"), F.col("root").alias("r2"))
        step = hops.join(above, "up")
        hops = Saved(step.select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"), F.col("r2").alias("root")), "hops").df.select(columns)
    else:
        raise ValueError("parents form a cycle")
    hops = done[0]
    for d in done[1:]:
        hops = hops.union(d)
    parents = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = hops.join(parents, "node", "left_anti")
    best = leaves.groupBy("root").agg(F.max(F.struct((F.col("total") / F.col("depth")).alias("mean"), "depth", (-F.col("node")).alias("neg"))).alias("b"))
    chosen = best.select((-F.col("b.neg")).alias("node"), F.col("root"))
    # walk from the chosen leaves to their roots, doubling the steps as well
    path = Saved(chosen.select("root", "node", F.lit(True).alias("new")), "path").df
    jump = nodes.join(known, "parent", "left").where("_has").select("node", F.col("parent").alias("to"))
    while not path.where("new").isEmpty():
        more = path.join(jump, "node").select("root", F.col("to").alias("node"))
        grown = path.select("root", "node", F.lit(False).alias("new")).union(more.select("root", "node", F.lit(True)))
        path = Saved(grown.groupBy("root", "node").agg(F.min("new").alias("new")), "path").df
        jump = Saved(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to").select("node", F.col("to2").alias("to")), "jump").df
    whole = messages.select("node", "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.join(path.select("root", "node"), "node").join(hops.select("node", "depth"), "node").select("conv_id", "root", "depth", "role", "text")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as chains of replies."""
    saved = Saved(conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.monotonically_increasing_id()), "turns").df
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return saved.select("conv_id", "node", "role", "text", F.lag("node").over(order).alias("parent"), F.lit(1.0).alias("score"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of the best path of each tree of ``messages`` (as ``best_paths`` takes them): a row for each root, with the root's conv_id."""
    turn = F.struct("depth", "role", "text")
    grouped = best_paths(messages).groupBy("root").agg(F.min_by("conv_id", "depth").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in x.as_py()]) for x in batch.column(1)]
            mask = [[{"start": a, "end": b} for a, b in m] for _, m in made]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.string()), pa.array(mask, kind)], names=["conv_id", "formatted", "mask"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, mask array<struct<start:long,end:long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold when they are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h, lc, lh, fc = [], [], [], [], []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                learned = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                n.append(len(turns))
                h.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
                lc.append(len(learned))
                lh.append(hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest())
                fc.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(lc, pa.int64()), pa.array(lh, pa.string()), pa.array(fc, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    every = conversations.select("conv_id", "turn", "role", "text").union(probe)
    return digest(format_conversations(as_tree(every)))


_ESCAPED = "coalesce({}, '')"
for _s in CONTROL:  # the backslash comes first, so later codes stay as they are
    _ESCAPED = "replace({}, '{}', '{}')".format(_ESCAPED, _s, _CODE[_s])

ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ESCAPED.format('text')} AS body, replace({_ESCAPED.format('role')}, chr(10), '\\c10;') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('{START}') + length(head) + 1 + length(body) + length('{END.strip()}') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
