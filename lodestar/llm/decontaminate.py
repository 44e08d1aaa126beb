"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton of the items is built once in each worker. Document tokens are streamed through it; the length of the longest
match that ends at each token is tracked, and tokens inside a match of at least the window length are hit. Documents whose hit
words exceed the coverage limit are contaminated; ``clean_documents`` takes them out, and ``without_spans`` cuts the
matched spans out of the texts of the others as well.

The benchmark is broadcast in shards of at most ``MAX_ITEM_WORDS`` words (an item that is longer is a shard of its own, up to
``MAX_SHARD_BYTES``, beyond which an error is raised). One shard is the usual case; with more, the documents stream past one shard
after the other, and what each found is written in between, so that a worker never holds two.

Defined results: null text has no words; an empty benchmark hits nothing; items shorter than the window are one
window; items without words are ignored; repeated item rows and repeated document rows are kept as they are
(``n_items`` counts distinct ids; a null item id takes part in hits but has no id to list); a null document id stays null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, small_batches, unused


WINDOW = 13
COVER = 20  # contaminated: at least one hit word in twenty
MAX_ITEM_WORDS = 300_000  # words of one automaton (at most 600,000 states, about 0.3 GB as Python objects)
MAX_SHARD_BYTES = 64 << 20

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters, digits and all code points above 0x7F make words; A-Z are lower-cased."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over integer tokens; ``length`` and ``link`` as usual."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens: list[int]) -> None:
        last = 0
        for c in tokens:
            last = self._extend(last, c)

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this prefix already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def stream(self, tokens: list[int]) -> list[int]:
        """The length of the longest suffix of tokens[:i + 1] that occurs in an item, for each i."""
        out, state, m = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for c in tokens:
            while state and c not in nxt[state]:
                state = link[state]
                m = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = m = 0
            else:
                state, m = to, m + 1
            out.append(m)
        return out


class Items:
    """One shard: vocabulary, automaton, and the items of every window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.vocab, self.automaton = window, {}, SuffixAutomaton()
        self.owners: dict[tuple[int, ...], set] = {}
        for item, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            self.automaton.add(ids)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                self.owners.setdefault(tuple(ids[i : i + n]), set()).add(item)
        #: Window lengths that occur, shortest first; a run of fewer known words can't be hit.
        self.sizes = sorted({len(k) for k in self.owners})

    def match(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        hit, found = np.zeros(len(ws) + 1, np.int32), set()
        if not self.sizes or len(ws) < self.sizes[0]:
            return hit[:-1], found
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s < self.sizes[0]:
                continue
            run = ids[s:e].tolist()
            for i, m in enumerate(self.automaton.stream(run)):
                if m < self.sizes[0]:
                    continue
                for n in self.sizes:
                    if n > m:
                        break
                    if owners := self.owners.get(tuple(run[i + 1 - n : i + 1])):
                        found |= owners
                        hit[s + i + 1 - n] += 1
                        hit[s + i + 1] -= 1
        return np.cumsum(hit[:-1]) > 0, found


def shards(benchmark: DataFrame, item_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in shards of whole items; the driver holds one at a time."""
    out, size, held = [], 0, 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ws = words(r[1])
        if out and size + len(ws) > max_words:
            yield out
            out, size, held = [], 0, 0
        held += sum(map(len, ws))
        if held > MAX_SHARD_BYTES:
            raise ValueError(f"item {r[0]} is too long for one automaton")
        if ws:
            out.append((r[0], ws))
            size += len(ws)
    if out:
        yield out


_BUILT: dict[str, Items] = {}


def _automaton(name: str, shared: Broadcast, window: int) -> Items:
    """The automaton of a broadcast shard, built once in this worker; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(shared.value, window)
    return _BUILT[name]


SPANS = "array<struct<start:bigint,end:bigint>>"


def _edges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def _matched(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, max_item_words: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, and their names: number of words, items with occurring windows, spans of hit words."""
    added = [unused(docs, x) for x in ("_n_words", "_items", "_spans")]
    state = small_batches(docs).select("*", F.lit(0).cast("long").alias(added[0]), F.array().cast("array<string>").alias(added[1]), F.array().cast(SPANS).alias(added[2]))
    at, first, schema = docs.columns.index(text_col), len(docs.columns), state.schema

    def passed(state: DataFrame, shared: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _automaton(name, shared, window)
            for batch in batches:
                n_words, found, spans = [], [], []
                for text, before, held in zip(batch.column(at), batch.column(first + 1), batch.column(first + 2), strict=True):
                    ws = words(text.as_py())
                    hit, owners = known.match(ws)
                    hit = np.array(hit, bool)
                    for x in held.as_py():
                        hit[x["start"] : x["end"]] = True
                    n_words.append(len(ws))
                    found.append(sorted({x for x in owners if x is not None} | set(before.as_py())))
                    spans.append([{"start": a, "end": b} for a, b in _edges(hit)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                made = [pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], *made], names=schema.names)

        return state.mapInArrow(run, schema)

    context = docs.sparkSession.sparkContext
    some = False
    for items in shards(benchmark, item_col, item_text_col, max_item_words):
        # what the shards before this one found is written before the next automaton is built
        state = passed(Saved(state, "matches").df if some else state, context.broadcast(items))
        some = True
    return (state if some else passed(state, context.broadcast([]))), added


def _hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document: word counts, hit words, the items with occurring windows and the hit word spans."""
    found, (n, items, spans) = _matched(docs.select(id_col, text_col), text_col, benchmark, item_col, item_text_col, window, max_item_words)
    return found.select(id_col, F.col(n).alias("n_words"), _hit_words(spans).alias("n_hit"), F.col(items).alias("items"), F.col(spans).alias("spans"))


def contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * COVER >= F.col("n_words"))


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return match_benchmark(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def _judged(docs: DataFrame, benchmark: DataFrame, max_item_words: int) -> tuple[DataFrame, str]:
    """``docs`` without the contaminated ones, with the spans of hit words in one more column of that name."""
    found, (n, _, spans) = _matched(docs, "text", benchmark, "item_id", "text", WINDOW, max_item_words)
    n_hit = _hit_words(spans)
    return found.where((n_hit == 0) | (n_hit * COVER < F.col(n))).select(*docs.columns, spans), spans


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Documents with the contaminated ones taken out, row for row with the columns they came with."""
    return _judged(docs, benchmark, max_item_words)[0].select(*docs.columns)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, from the first word's begin to the last one's end; what stood around stays."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def without_spans(docs: DataFrame, benchmark: DataFrame, *, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """As ``clean_documents``, with the matched spans of benchmark words cut out of the remaining texts too."""
    judged, _ = _judged(docs, benchmark, max_item_words)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = [cut_words(t.as_py(), [(x["start"], x["end"]) for x in s]) if s else t.as_py() for t, s in zip(batch.column(at), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return judged.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM lowered),
iw AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark) WHERE len(w) > 0),
ip AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM iw),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN sizes ON len(w) >= n),
hits AS (SELECT doc_id, i, dp.n, item_id FROM dp JOIN win ON win.n = dp.n AND win.g = array_to_string(list_slice(w, i, i + dp.n - 1), ' ')),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
