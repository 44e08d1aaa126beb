"""Best-fit packing planned on the histogram of piece lengths.

Pieces are counted by length; best-fit decreasing runs over those counts on the driver (at most ``capacity``
numbers, however many documents there are) and yields a plan of slot ranges. Pieces then take planned slots by
joining on their rank within their length. Ranks are dealt by (length, bucket of the id), so that a length shared by a
third of all pieces is spread over many tasks, and a bucket's first rank is a running sum of bucket counts.

Defined results: null and empty texts hold the end token alone; an empty table gives no rows; documents with equal
ids stay separate rows (their pieces are then told apart by rank only); extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, small_batches

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256  # pieces of one rank bucket, all lengths together; buckets of a small table

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encodes with the vocabulary of a tokenizers JSON file.

    The same merges run in the faster of two libraries; what that one refuses goes to ``tokenizers`` itself.
    Special-token strings inside a text are ordinary text in both.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(map(to_byte.__getitem__, k)): v for k, v in model["vocab"].items() if all(c in to_byte for c in k) and k != "<|endoftext|>"}
        self.fast = tiktoken.Encoding("lodestar", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the Rust side reports a refusal of a pathological text as a panic, or as a ValueError
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids


_LOADED: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then full pieces."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    source = small_batches(docs).select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or default_vocabulary())
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.array([*enc.ids(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    part = tokens[s : s + n]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slot ranges (length, first rank, n, first sequence, offset): the pieces of that length with ranks from
    the first rank on take, in order, the sequences from the first sequence on, each at that offset. Sequences with
    the same filling are one entry, so the work depends on the number of lengths, never on the number of pieces.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, n)
    rooms: list[int] = []
    next_sequence = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_bins[room]:
                bisect.insort(rooms, room)
            open_bins[room].append((first, n))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(k)
                fit = min(room // length, max(1, left // n))
                take = min(left, n)
            else:
                room = capacity
                fit = min(capacity // length, left)
                first, n = next_sequence, -(-left // fit)
                if fit * n > left and n > 1:
                    n -= 1  # the last one, not full of this length, comes in the next turn
                next_sequence += n
                take = n
            if take < n:
                put(room, first + take, n - take)
            for j in range(fit):
                ranges.append((length, rank, take, first, capacity - room + j * length))
                rank += take
            left -= fit * take
            put(room - fit * length, first, take)
    return ranges


def pack(pieces: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces (a stable, saved DataFrame) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranges = best_fit(histogram, capacity)
    order = sorted(ranges)
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*order, strict=True)) if order else None)
    buckets = max(LEAST_BUCKETS, sum(histogram.values()) // bucket_rows)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col), "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(first, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first") - 1).drop("_bucket", "_first")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, offset = plan.value or (np.zeros(0, np.int64),) * 5
        key = (length << np.int64(44)) | rank
        for batch in batches:
            mine = batch.column("length").to_numpy()
            r = batch.column("_rank").to_numpy()
            k = np.searchsorted(key, (mine << np.int64(44)) | r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence[k] + r - rank[k]), pa.array(offset[k])], names=[*names, "sequence_id", "offset"])

    schema = pieces.schema.simpleString()[7:-1]
    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenises ``docs`` once into a table in the shared folder, then packs its pieces."""
    return pack(Saved(tokenize(docs, **options), "pieces").df, id_col=options.get("id_col", "doc_id"), capacity=options.get("capacity", CAPACITY))


def op5(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
