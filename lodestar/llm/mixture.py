"""Packing to a mixture: deficit round-robin over one queue a source, cut freely, without padding.

Documents stand in their source's queue in an order of hash buckets. A fluid schedule says how many tokens of each queue
are due when a given number of tokens of all has been dealt: queues flow at their target rates until they are empty. The
default targets are the sources' own shares, so that all queues end together.

A window is a sequence of ``capacity`` tokens. What a queue is due at a window's end, less what it has sent, is its deficit.
Queues whose deficit is at least ``LEAST`` send that many tokens, in turn; what room is left goes to the largest deficits, at
least ``LEAST`` tokens each, so pieces don't get tiny; what is sent too much or too little is carried to the next window.

Windows are dealt by many tasks. The fluid schedule is cut at points of equal advance; each queue is cut where it would be by
then, rounded down, so a part knows its tokens, its place in the whole and each queue's carried deficit from the plan alone. A
part begins in the middle of the window that the one before it leaves unfinished. All windows but the last are full; the rest
is laid out in sequences of descending powers of two, which need no padding.

The plan holds two numbers a queue and two a part. Sources beyond the ``QUEUES`` with the most tokens share ``POOLS`` queues.

Defined results: null and empty texts hold the end token alone; a null source is ''; documents with equal or null ids stay
apart (told by the row, not the id); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, shared_path, small_batches
from .packing import default_vocabulary, encoder

CAPACITY, END_ID = 2048, 1
LEAST = 32
QUEUES, POOLS = 10_000, 256
PART_TOKENS, MOST_PARTS = 1 << 20, 1 << 20
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256


@dataclass
class Plan:
    """Tokens and rate of each queue, and the points in fluid time at which the parts begin and end."""

    tokens: np.ndarray
    rates: np.ndarray
    times: np.ndarray
    starts: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]  # fluid time and tokens dealt by then, where a queue ends

    def due(self, time: float, queue=slice(None)) -> np.ndarray:
        return np.minimum(self.tokens[queue], self.rates[queue] * time)

    def at(self, position: float) -> float:
        """The fluid time at which so many tokens are dealt."""
        return float(np.interp(position, self.knots[1], self.knots[0]))

    def sent(self, queue: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Tokens of a queue in the parts before this one."""
        whole = np.minimum(self.tokens[queue], np.floor(self.rates[queue] * self.times[part])).astype(np.int64)
        return np.where(part >= len(self.times) - 1, self.tokens[queue], whole)

    def part_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The part that holds the token: the first whose end is beyond it."""
        part = np.clip(np.searchsorted(self.times, (token + 1) / self.rates[queue]) - 1, 0, len(self.times) - 2)
        while (late := self.sent(queue, part) > token).any():  # rounding of the quotient
            part = part - late
        while (early := self.sent(queue, part + 1) <= token).any():
            part = part + early
        return part


def plan(tokens: list[int], rates: list[float], part_tokens: int = PART_TOKENS, most_parts: int = MOST_PARTS) -> Plan:
    t, r = np.array(tokens, np.int64), np.array(rates, np.float64)
    total, ends = int(t.sum()), t / r
    order = np.argsort(ends, kind="stable")
    ended = np.concatenate([[0], np.cumsum(t[order])])[:-1]
    flowing = np.cumsum(r[order][::-1])[::-1]
    knots = np.concatenate([[0.0], ends[order]]), np.concatenate([[0.0], ended + flowing * ends[order]])
    parts = max(1, min(most_parts, -(-total // part_tokens)))
    times = np.interp(np.arange(parts + 1) * (total / parts), knots[1], knots[0])
    out = Plan(t, r, times, np.zeros(parts + 1, np.int64), knots)
    every = np.arange(parts + 1)
    for q in range(len(t)):
        out.starts += out.sent(np.full(parts + 1, q), every)
    return out


def place(position: int, total: int, capacity: int = CAPACITY) -> tuple[int, int, int]:
    """(sequence, offset, length of the sequence) of a place among all dealt tokens."""
    full = total // capacity
    if position < full * capacity:
        return position // capacity, position % capacity, capacity
    sequence, start, rest = full, full * capacity, total % capacity
    while True:
        size = 1 << (rest.bit_length() - 1)
        if position < start + size:
            return sequence, position - start, size
        sequence, start, rest = sequence + 1, start + size, rest - size


def deal(part: int, p: Plan, queues: dict[int, list[tuple[int, int, int]]], capacity: int = CAPACITY, least: int = LEAST) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of the pieces of a part. queues: (row, start, length) in order."""
    total, position, last = int(p.tokens.sum()), int(p.starts[part]), int(p.starts[part + 1])
    names = np.array(sorted(queues), np.int64)
    left = np.array([sum(x[2] for x in queues[q]) for q in names.tolist()], np.int64)
    sent = p.sent(names, np.full(len(names), part))
    items, heads, used = [queues[q] for q in names.tolist()], [0] * len(names), [0] * len(names)
    turn = 0
    while position < last:
        sequence, offset, size = place(position, total, capacity)
        room = min(size - offset, last - position)
        deficit = p.due(p.at(position + room), names) - sent
        position += room

        def send(q: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
            nonlocal offset, room
            deficit[q] -= n
            sent[q] += n
            left[q] -= n
            room -= n
            while n:
                row, start, length = items[q][heads[q]]
                k = min(n, length - used[q])
                yield row, start + used[q], k, sequence, offset
                offset, n, used[q] = offset + k, n - k, used[q] + k
                if used[q] == length:
                    heads[q], used[q] = heads[q] + 1, 0

        ready = np.flatnonzero((deficit >= least) & (left > 0))
        first = int(np.searchsorted(ready, turn))
        for q in (*ready[first:].tolist(), *ready[:first].tolist()):
            if room:
                yield from send(q, min(int(deficit[q]), int(left[q]), room))
                turn = q + 1
        while room:
            q = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            yield from send(q, min(max(least, int(deficit[q])), int(left[q]), room))


def tokenised(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(row, id, source, n, ids) of every document, saved: its ids as little-endian 32-bit numbers."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or default_vocabulary())
        for batch in batches:
            ids = [np.array([*enc.ids(text.as_py() or ""), end_id], "<u4") for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["row", "id", "source", "n", "ids"])

    made = rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, source string, n long, ids binary")
    path = shared_path(spark, "tokens")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def queued(lengths: DataFrame) -> DataFrame:
    """Adds ``at``, the tokens of a row's queue that stand before it: a running sum over buckets and one inside each, so a long queue is no single task."""
    buckets = max(LEAST_BUCKETS, lengths.count() // BUCKET_ROWS)
    dealt = lengths.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("queue", "bucket").agg(F.sum("n").alias("first")).withColumn("first", F.coalesce(F.sum("first").over(before), F.lit(0)))
    within = Window.partitionBy("queue", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(first, ["queue", "bucket"]).select("row", "queue", "n", (F.col("first") + F.col("inside")).alias("at"))


def rates(sources: list[tuple[str | None, int]], targets: dict[str, float] | None) -> list[float]:
    """Tokens of each queue in a fluid time of one; sources that ``targets`` doesn't name share what it leaves by their tokens."""
    total = sum(n for _, n in sources)
    if not targets:
        return [n / total for _, n in sources]
    if any(x <= 0 for x in targets.values()):
        raise ValueError("target shares must be above 0")
    others = sum(n for s, n in sources if s not in targets)
    rest = 1 - sum(targets[s] for s, _ in sources if s in targets)
    if others and rest <= 0:
        raise ValueError("target shares must leave something to the other sources")
    return [targets[s] if s in targets else rest * n / others for s, n in sources]


def mix(docs: DataFrame, *, targets: dict[str, float] | None = None, capacity: int = CAPACITY, least: int = LEAST, queues: int = QUEUES, part_tokens: int = PART_TOKENS, **columns) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    tokens = tokenised(docs, **columns)
    sums = tokens.groupBy("source").agg(F.sum("n").alias("tokens"))
    largest = [(r["source"], r["tokens"]) for r in sums.orderBy(F.desc("tokens"), "source").limit(queues).collect()]
    named = F.broadcast(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(largest)], "source string, queue int"))  # at most ``queues`` rows
    pooled = (F.lit(queues) + F.pmod(F.xxhash64("source"), F.lit(POOLS))).cast("int")
    in_queue = lambda df: df.join(named, "source", "left").withColumn("queue", F.coalesce("queue", pooled))
    pools = {r["queue"]: r["tokens"] for r in in_queue(sums).where(F.col("queue") >= queues).groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()} if len(largest) == queues else {}
    everyone = [*largest, *((None, n) for n in pools.values())]
    number = {q: len(largest) + i for i, q in enumerate(pools)}
    flow = rates(everyone, targets)
    sent = spark.sparkContext.broadcast((plan([n for _, n in everyone], flow, part_tokens) if everyone else None, number))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's tokens by the parts that they fall into; most documents lie in one."""
        p, pool = sent.value
        for batch in batches:
            row, queue, n, at = (c.to_numpy() for c in batch.columns)
            queue = np.array([pool.get(q, q) for q in queue.tolist()], np.int64)
            first, last = p.part_of(queue, at), p.part_of(queue, at + n - 1)
            times = last - first + 1
            i = np.repeat(np.arange(len(row)), times)
            part = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            start, end = np.maximum(at[i], p.sent(queue[i], part)), np.minimum((at + n)[i], p.sent(queue[i], part + 1))
            some = end > start
            names = ["part", "queue", "at", "row", "start", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (part, queue[i], start, row[i], start - at[i], end - start)], names=names)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, _ = sent.value
        rows = rows.sort_values(["queue", "at"])
        mine = {int(q): list(zip(g["row"].tolist(), g["start"].tolist(), g["length"].tolist(), strict=True)) for q, g in rows.groupby("queue")}
        return pd.DataFrame(list(deal(int(key[0]), p, mine, capacity, least)), columns=["row", "start", "length", "sequence_id", "offset"]).astype("int64")

    lengths = in_queue(tokens.select("row", "source", "n")).select("row", "queue", "n")
    parts = queued(lengths).select("row", "queue", "n", "at").mapInArrow(cut, "part long, queue long, at long, row long, start long, length long")
    pieces = parts.groupBy("part").applyInPandas(run, "row long, start long, length long, sequence_id long, offset long")
    pieces = Saved(pieces, "pieces").df
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("p"))  # of one document
    piece = by_row.join(tokens.select("row", "id", "n", "ids"), "row").select("id", "n", "ids", F.explode("p").alias("p"))
    ids = F.substring("ids", (F.col("p.start") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return piece.select("id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


def op13(docs: DataFrame) -> DataFrame:
    return mix(docs).withColumnRenamed("id", "doc_id")
