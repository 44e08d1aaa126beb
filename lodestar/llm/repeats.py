"""Removal of long repeated substrings by prefix-free parsing of the corpus.

A rolling hash over ``GRAM`` bytes picks triggers: the smallest hash (leftmost if equal) of every window of ``length``
bytes. The rule looks at content only, so equal windows have their trigger at the same place, and no phrase is longer
than a window. Each trigger's phrase, with as much text on both sides as any window through the trigger can reach, is an
entry of the dictionary; the parse is the list of entries by document and position.

* The parse: only order up to ``length`` bytes matters, and an entry reaches that far, so one symbol of the parse's suffixes
  decides. A phrase that the parse holds twice or more is repeated as a whole; nothing in it needs to be compared.
* The dictionary: suffixes from the triggers on are put in order by their bytes, and so are the prefixes up to the
  triggers, read backwards; each order comes with the lengths of the common prefixes of neighbours. A window that begins b bytes
  before a trigger occurs in another phrase if both share b bytes before it and ``length - b`` from it on, so it is looked up
  in both orders at once: phrases that lie in the same run of either order at these depths. No fingerprint decides here.

Only distinct phrases of repeated grams are ordered; copies of a document, however many, cost one phrase each. A task orders
the phrases of a gram if there are at most ``CROWD``. Larger groups are halved by content instead, so that no task holds all
phrases of a gram at any size: cuts are taken in runs of ``RUN``. Two phrases with a common window in a run share the core that
all its windows have, and if they share all that its windows reach, all windows are common. Spark counts (core, reach), and only
phrases that share a core and not the reach go on, one for each reach, to single cuts.

Fingerprints have 64 bits. Equality of whole phrases rests on two of them (gram and phrase), and so does that of cut
suffixes in crowded grams (core and reach). Rows are known by 128 bits of a digest of id and text.

Defined results: null and empty texts have no bytes; a row repeated exactly is another document with the same text, so
both lose all bytes in windows; texts under ``length`` bytes lose none; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, Scratch, blocks, hot_from, joined_apart, mix64, prefix_hash, row_key, shuffle_partitions, small_batches, span_hash

LENGTH = 200
GRAM = 32
SEGMENT = 256 << 10  # bytes that are hashed at once
CROWD = 8192
RUN = 22  # cuts that are judged at once in crowded grams


def window_triggers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of the smallest (top 32 bits), leftmost if equal."""
    n = len(hashes)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _segments(raw: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first index, end, row, offset in the row) of pieces of the texts that are handled together."""
    margin = 2 * length
    for i, j in blocks(raw):
        if j - i == 1 and len(raw[i]) > SEGMENT:
            for a in range(0, len(raw[i]), SEGMENT):
                lo, hi = max(0, a - margin), min(len(raw[i]), a + SEGMENT + margin)
                yield np.frombuffer(raw[i], np.uint8)[lo:hi], np.array([0]), np.array([hi - lo]), np.array([i]), np.array([lo])
        else:
            sizes = np.array([len(x) for x in raw[i:j]])
            ends = np.cumsum(sizes)
            yield np.frombuffer(b"".join(raw[i:j]), np.uint8), ends - sizes, ends, np.arange(i, j), np.zeros(j - i, np.int64)


def parse(raw: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, gram, phrase) of the triggers of each text; phrases are hashed with their reach on both sides."""
    width = length - GRAM + 1
    for data, start, end, row, base in _segments(raw, length):
        if len(data) < length:
            continue
        prefix = prefix_hash(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = span_hash(prefix, at, at + GRAM)
        trigger = window_triggers(grams, width)
        owner = np.repeat(np.arange(len(start)), end - start)[: len(trigger)]
        whole = np.arange(len(trigger)) + length <= end[owner]
        places = np.unique(trigger[whole])
        if not len(places):
            continue
        # a trigger found from this side of a segment cut is found again from the other; the caller drops the copy
        doc = np.searchsorted(end, places, side="right")
        left, right = np.maximum(places - (width - 1), start[doc]), np.minimum(places + length, end[doc])
        phrase = mix64(span_hash(prefix, left, right) + (places - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (right - left).astype(np.uint64))
        yield row[doc], places - start[doc] + base[doc], grams[places], phrase


def _kind(docs: DataFrame) -> str:
    return docs.schema["key"].dataType.simpleString()


def _parse_rows(docs: DataFrame, length: int) -> DataFrame:
    """The parse: key, pos, gram and phrase of every trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            got = list(parse(raw, length))
            if not got:
                continue
            row, pos, gram, phrase = (np.concatenate(x) for x in zip(*got, strict=True))
            if any(len(x) > SEGMENT for x in raw):
                _, first = np.unique(np.stack([row, pos]), axis=1, return_index=True)
                row, pos, gram, phrase = row[first], pos[first], gram[first], phrase[first]
            for i in range(0, len(row), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[s])), pa.array(pos[s]), pa.array(gram[s].view(np.int64)), pa.array(phrase[s].view(np.int64))], names=["key", "pos", "gram", "phrase"])

    return docs.select("key", "text").mapInArrow(run, f"key {_kind(docs)}, pos long, gram long, phrase long")


def _packed(docs: DataFrame) -> DataFrame:
    """(key, z): texts compressed, for the joins that carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["key", "z"])

    return docs.select("key", "text").mapInArrow(run, f"key {_kind(docs)}, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _phrases(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted dictionary entries, each taken from one of its places."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "gram", "phrase", "n", "k")).alias("w"))
    width = length - GRAM + 1

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "phrase", "n", "k", "left", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for z, ws in zip(batch.column(0), batch.column(1), strict=True):
                text = _unpack(z.as_py())
                for w in ws.as_py():
                    lo = max(0, w["pos"] - width + 1)
                    rows.append((w["gram"], w["phrase"], w["n"], w["k"], w["pos"] - lo, text[lo : w["pos"] + length]))
                if len(rows) >= 20_000:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    # equal rows have equal keys: one of them is enough here
    joined = _packed(docs).join(lists, "key").select("z", "w")
    return joined.mapInArrow(run, "gram long, phrase long, n long, k long, left int, data binary").dropDuplicates(["gram", "phrase"])


def _ordered(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows in the order of (group, bytes), and at each place the bytes in common with the one before it.

    -1 where the group is another one.
    """
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    inside, near = rows[order], group[order]
    differ = inside[1:] != inside[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[near[1:] != near[:-1]] = -1
    return place, np.concatenate([[-1], common])


def _cut_suffixes(gram: np.ndarray, left: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per phrase the smallest and largest number of bytes before the trigger of a window that another phrase has too.

    -1 and -2 where there is none. Rows are sorted by gram.
    """
    n, most = len(gram), length - GRAM + 1
    low, high = np.full(n, -1), np.full(n, -2)
    if n < 2:
        return low, high
    ends = np.cumsum([len(x) for x in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    trigger = np.concatenate([[0], ends[:-1]]) + left
    right = ends - trigger

    def context(step: int, size: np.ndarray, width: int) -> np.ndarray:
        """The bytes of each phrase from its trigger on (step 1) or before it, backwards (step -1), zeros beyond its end."""
        away = np.arange(width)
        at = trigger[:, None] + (away if step > 0 else -1 - away)
        return np.where(away < size[:, None], flat[np.clip(at, 0, len(flat) - 1)], 0)

    group = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sides = []
    for step, size, width in ((1, right, length), (-1, left, most)):
        place, common = _ordered(context(step, size, width), group)
        sides.append((place, common, np.maximum(common, np.concatenate([common[1:], [-1]]))[place]))
    (at_right, by_right, best_right), (at_left, by_left, best_left) = sides
    for b in range(most):  # b bytes before the trigger
        ok = np.flatnonzero((left >= b) & (best_left >= b) & (right >= length - b) & (best_right >= length - b))
        if len(ok) < 2:
            continue
        run = np.cumsum(by_left < b)[at_left[ok]] * (n + 1) + np.cumsum(by_right < length - b)[at_right[ok]]
        order = np.argsort(run, kind="stable")
        same = run[order][1:] == run[order][:-1]
        twice = np.zeros(len(ok), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = ok[twice]
        low[hit] = np.where(low[hit] < 0, b, low[hit])
        high[hit] = b
    return low, high


def _compare(phrases: DataFrame, length: int, crowd: int) -> DataFrame:
    """(gram, phrase, low, high) for phrases of one place whose windows occur in another phrase of the gram."""
    dealt = phrases.repartition(shuffle_partitions(phrases.sparkSession), "gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(t: pa.Table) -> pa.RecordBatch:
            gram, phrase = t.column("gram").to_numpy(), t.column("phrase").to_numpy()
            low, high = _cut_suffixes(gram, t.column("left").to_numpy().astype(np.int64), t.column("data").to_pylist(), length)
            keep = (high >= 0) & (t.column("n").to_numpy() == 1)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, phrase, low, high)], names=["gram", "phrase", "low", "high"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < crowd:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            if cut:
                yield answer(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(t) - cut
        if rows:
            yield answer(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "gram long, phrase long, low long, high long")


def _pieces(phrases: DataFrame, length: int, width: int) -> DataFrame:
    """The windows of each phrase in runs of ``width`` cuts: which cuts a run has, its core and its reach.

    If there is a column ``runs``, only within the runs of ``RUN`` cuts that begin there.
    """
    most, odd = length - GRAM + 1, np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, phrase, n, left = (batch.column(c).to_numpy() for c in ("gram", "phrase", "n", "left"))
            left = left.astype(np.int64)
            data = batch.column("data").to_pylist()
            ends = np.cumsum([len(x) for x in data])
            trigger = np.concatenate([[0], ends[:-1]]) + left
            right = ends - trigger
            prefix = prefix_hash(np.frombuffer(b"".join(data), np.uint8))
            asked = np.ones((len(gram), -(-most // RUN)), bool)
            if "runs" in batch.schema.names:
                asked[:] = False
                for i, starts in enumerate(batch.column("runs").to_pylist()):
                    asked[i, [x // RUN for x in starts]] = True
            for first in range(0, most, width):
                last = min(first + width, most) - 1
                low, high = np.maximum(first, length - right), np.minimum(last, left)
                ok = np.flatnonzero((low <= high) & asked[:, first // RUN])
                if not len(ok):
                    continue
                at, before, after = trigger[ok], np.minimum(left[ok], last), np.minimum(right[ok], length - first)
                core = mix64(span_hash(prefix, at - first, at + length - last) ^ (gram[ok].view(np.uint64) + np.uint64(first)) * odd)
                reach = mix64(span_hash(prefix, at - before, at + after) + (before * (2 * length) + after).astype(np.uint64) * odd)
                cols = [gram[ok], phrase[ok], n[ok], low[ok], high[ok], np.full(len(ok), first), core.view(np.int64), reach.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["gram", "phrase", "n", "low", "high", "run", "core", "reach"])

    return phrases.mapInArrow(run, "gram long, phrase long, n long, low long, high long, run long, core long, reach long")


def _compare_crowded(phrases: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """As ``_compare``, for grams with any number of phrases; a phrase can have several rows."""
    saved, on = scratch.save(phrases, "crowded"), ["core", "reach"]

    def counted(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """How many phrases have each reach, with one of them; and the cuts that a phrase of one place has in common with others."""
        one = F.min(F.struct("gram", "phrase", "run", "n")).alias("one")
        shared = scratch.save(pieces.groupBy(*on).agg(F.count("*").alias("c"), one), "reaches")
        hot = hot_from(pieces.count())
        again = shared.where("c > 1").select(*on)
        return shared, joined_apart(pieces.where("n = 1"), again, shared.where(F.col("c") >= hot).select(*on), on).select("gram", "phrase", "low", "high")

    pieces = scratch.save(_pieces(saved, length, RUN), "runs")
    shared, found = counted(pieces)
    # cores with several reaches, one of which only one phrase of one place has
    cores = scratch.save(shared.groupBy("core").agg(F.count("*").alias("k"), F.min(F.greatest("c", "one.n")).alias("least")).where("k > 1 AND least = 1"), "cores")
    hot = hot_from(shared.count())
    unsure = joined_apart(shared.select("core", "one.*"), cores.select("core"), cores.where(F.col("k") >= hot).select("core"), ["core"])
    runs = unsure.groupBy("gram", "phrase").agg(F.collect_set("run").alias("runs"))
    single = scratch.save(_pieces(saved.join(runs, ["gram", "phrase"]), length, 1), "cuts")
    return found.unionByName(counted(single)[1])


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, spans) with the covered [start, end) intervals, overlapping ones included; ``docs``: key, text."""
    width = length - GRAM + 1
    scratch = Scratch()
    rows = Saved(_parse_rows(docs, length), "parse")
    hot = hot_from(rows.df.count())
    again = rows.df.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    few = Saved(joined_apart(rows.df, again.select("gram"), again.where(F.col("c") >= hot).select("gram"), ["gram"]), "parse")
    rows.drop()
    entry = few.df.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at"))
    entry = scratch.save(entry.select("gram", "phrase", "n", "at.key", "at.pos"), "dictionary")
    whole = entry.where("n > 1").select("gram", "phrase", "n", F.lit(0).cast("long").alias("low"), F.lit(width - 1).cast("long").alias("high"))
    # a gram's entries are compared only if one of them has a single place and there is another one
    mixed = entry.groupBy("gram").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("gram", "k")
    mixed = scratch.save(mixed, "mixed")
    most = mixed.where(F.col("k") >= hot_from(entry.count()))
    phrases = _phrases(docs, joined_apart(entry, mixed, most, ["gram"]), length)
    if mixed.where(F.col("k") > crowd).isEmpty():
        found = _compare(phrases, length, crowd)
    else:
        phrases = scratch.save(phrases, "phrases")
        found = _compare(phrases.where(F.col("k") <= crowd), length, crowd).unionByName(_compare_crowded(phrases.where(F.col("k") > crowd), length, scratch))
        found = found.groupBy("gram", "phrase").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    verdict = Saved(whole.drop("n").unionByName(found), "repeats").df
    common = Saved(whole.where(F.col("n") >= hot).drop("n"), "common").df
    scratch.drop()
    judged = joined_apart(few.df, verdict, common, ["gram", "phrase"])
    spans = judged.select("key", F.greatest(F.col("pos") - F.col("high"), F.lit(0)).alias("start"), (F.col("pos") - F.col("low") + length).alias("end"))
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the rest, and the rest itself if asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = small_batches(docs).select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", row_key("id", "text"))
    spans = repeated_spans(keyed.select("key", "text"), length=length)
    packed = keyed.select("id", "key", "text")
    kind = packed.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["id", "key", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, digest, rest = [], [], [], [], []
            for z, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _unpack(z)
                out = merged([(x["start"], x["end"]) for x in s or ()], len(raw))
                edges = [0, *(x for ab in out for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(raw))
                removed.append(len(raw) - len(kept))
                runs.append(len(out))
                digest.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept if with_kept else None)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = packed.mapInArrow(pack, f"id {kind}, key binary, z binary").join(spans, "key", "left").select("id", "z", "spans")
    out = joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_kept else out.drop("kept")


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
