"""Near-duplicate components by bottom-k sketches, inverted lists of retained values and exact Jaccard.

1. Every document gets its set of 5-word shingles as 64-bit hashes and keeps the ``k`` smallest (one hash function).
2. Documents with the same set are one class, known by a 64-bit key of the set; only classes go on. That removes exact
   copies, however many there are, before any list is built.
3. Retained values are counted; each class puts its rarest retained values into inverted lists. Two sets that are
   similar enough share at least ``need`` retained values, so leaving out the ``need - 1`` most frequent ones of each
   loses no pair (prefix filtering), while a passage that a third of all documents share builds no list unless it
   makes up most of a document.
4. A short list gives its pairs. A long list gives only the pairs of its pivot, the member whose values are the most
   common; the links found join classes into components, and values are then counted anew by component. In what still
   spans two components, members outside the pivot's component are compared with the whole list in blocks, by counting
   on inverted lists of full sets, which writes links only.
5. A pair goes on if its union sketch allows the threshold, and is a link only if the full sets confirm it.

``need`` for sets over ``k`` is so far below the mean that a pair at the threshold is lost with a chance
under 1e-8; for sets of at most 48 shingles the bound is exact.

Defined results: null, empty and blank texts have no shingles, stay alone and are kept; rows with a null id take no
part and have no component; rows that repeat an id with another text are documents of their own, each with the smallest id that
its text reaches; an empty table gives no rows; extra columns are ignored. Values, classes and components that a
large part of the table has are joined apart from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, hot_from, joined_apart, mix64, shuffle_partitions, small_batches
from .components import connected_components
from .shingles import jaccard, shingle_sets

K = 64
NEED = 28  # of k retained values that a similar pair shares (mean 48, deviation 3.5 at the threshold)
EXACT = 48  # sets up to this size are compared with sets that are retained whole
SHORT = 12  # members of a list that gives all its pairs
BLOCK, STREAM = 512, 8192  # members that ask and members that pass by, of one family in one group


def set_key(x: np.ndarray) -> int:
    """A signed 64-bit number that tells a set of shingles."""
    both = np.array([x.sum(dtype=np.uint64), mix64(x).sum(dtype=np.uint64), len(x)], np.uint64)
    return int(mix64((mix64(both) * np.array([1, 3, 5], np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def sketches(docs: DataFrame, *, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """(id, text_key, n, key, sketch): the row, its set's size and key, and the k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, low = [], [], []
            for x in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(x))
                key.append(set_key(x))
                low.append(x[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=["id", "text_key", "n", "key", "sketch"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "id long, text_key long, n long, key long, sketch array<long>")


def full_sets(docs: DataFrame, *, text_col: str) -> DataFrame:
    """(id, set) of the texts, where ``id`` is the key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "set"])

    return docs.select(text_col).mapInArrow(run, "id long, set binary")


def _union_sketch_allows(a: np.ndarray, b: np.ndarray, k: int, na: int, nb: int, num: int, den: int) -> bool:
    """Whether the bottom-k of the union leaves the threshold possible, six deviations allowed."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = np.zeros(len(both), bool)
    same[1:] = both[1:] == both[:-1]
    union = np.flatnonzero(~same)
    if na <= k and nb <= k:
        return den * int(same.sum()) >= num * len(union)
    cut = both[union[k - 1]] if len(union) >= k else both[-1]
    size = min(k, len(union))
    shared = int(np.count_nonzero(same & (both <= cut)))
    t = num / den
    return shared >= t * size - 6 * (size * t * (1 - t)) ** 0.5


def _sketch_filter(pairs: DataFrame, low: DataFrame, k: int, num: int, den: int) -> DataFrame:
    left = low.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = low.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                keep[i] = _union_sketch_allows(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), k, na[i], nb[i], num, den)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                common, union = jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                keep.append(den * common >= num * union)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _prefix(rows: DataFrame, by: DataFrame, size: int) -> DataFrame:
    """Of each id's (id, n, v) rows, joined with counts ``c`` of the values worth a list, the prefix of the rarest; ``size`` rows."""
    need = F.when(F.col("n") <= EXACT, F.ceil(F.col("n") * 3 / 4)).otherwise(NEED)
    w = Window.partitionBy("id")
    ranked = joined_apart(rows, by, by.where(F.col("c") >= hot_from(size)), ["v"])
    ranked = ranked.withColumn("_r", F.row_number().over(w.orderBy("c", "v"))).withColumn("_c", F.count("*").over(w)).withColumn("score", F.sum("c").over(w))
    return ranked.where((F.col("_r") <= F.col("_c") - need + 1) & (F.col("_c") >= need)).select("id", "n", "v", "score")


def _families(listed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links across components within long lists.

    The lists of one pivot make a family. Its members outside the pivot's component are asked, in blocks of ``BLOCK``,
    against all its members, which stream past a block in groups of about ``STREAM``: no pair is written unless it
    is a link. Two members of the pivot's component need no comparison, so every other pair has a side that asks.
    """
    seen = listed.where(F.col("m") > SHORT).select((-F.col("p.neg")).alias("p"), "id", "comp", (F.col("comp") != F.col("p.comp")).alias("asks")).distinct()
    seen = Saved(seen, "families").df
    size = seen.groupBy("p").agg(F.count("*").alias("m"), F.count_if("asks").alias("u")).where("u > 0")
    size = size.select("p", F.ceil(F.col("u") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / STREAM).cast("int").alias("groups"))
    rows = seen.join(size, "p")
    deal = F.xxhash64("id")
    asks = rows.where("asks").select("p", "id", "comp", F.pmod(deal, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("kind"))
    told = rows.select("p", "id", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.shiftright(deal, 20), "groups").cast("int").alias("group"), F.lit(1).alias("kind"))
    dealt = asks.union(told).join(sets, "id").repartition(shuffle_partitions(listed.sparkSession), "p", "block", "group").sortWithinPartitions("p", "block", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking = None, _Asking(num, den)
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("p", "block", "group", "kind", "id", "comp")]
            sets_ = batch.column("set")
            out_a, out_b, at = [], [], 0
            while at < len(batch):
                key = (cols[0][at], cols[1][at], cols[2][at])
                if key != now:
                    now, asking = key, _Asking(num, den)
                end = at
                while end < len(batch) and (cols[0][end], cols[1][end], cols[2][end]) == now and cols[3][end] == cols[3][at] and end - at < 1024:
                    end += 1
                ids, comps = np.array(cols[4][at:end]), np.array(cols[5][at:end])
                values = [np.frombuffer(sets_[i].as_buffer(), np.uint64) for i in range(at, end)]
                if cols[3][at] == 0:
                    asking.add(ids, comps, values)
                else:
                    a, b = asking.links(ids, comps, values)
                    out_a.append(np.minimum(a, b))
                    out_b.append(np.maximum(a, b))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out_a, out_b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


class _Asking:
    """A block of sets as an inverted list, against which other sets are counted."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ids: list[np.ndarray] = []
        self.comps: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.index: tuple | None = None

    def add(self, ids: np.ndarray, comps: np.ndarray, values: list[np.ndarray]) -> None:
        self.ids.append(ids)
        self.comps.append(comps)
        self.values += values

    def _built(self) -> tuple:
        if self.index is None:
            flat = np.concatenate(self.values)
            owner = np.repeat(np.arange(len(self.values)), [len(x) for x in self.values])
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], owner[order], np.concatenate(self.ids), np.concatenate(self.comps), np.array([len(x) for x in self.values])
        return self.index

    def links(self, ids: np.ndarray, comps: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not self.values:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, owner, own_ids, own_comps, sizes = self._built()
        found_a, found_b = [], []
        for i, x in enumerate(values):
            lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
            n = hi - lo
            some = n > 0
            lo, n = lo[some], n[some]
            places = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            common = np.bincount(owner[places], minlength=len(sizes))
            hit = (self.den * common >= self.num * (len(x) + sizes - common)) & (own_comps != comps[i])
            found_a.append(own_ids[hit])
            found_b.append(np.full(int(hit.sum()), ids[i]))
        return np.concatenate(found_a), np.concatenate(found_b)


def _near(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, k: int) -> DataFrame:
    """(id, text_key, n, comp, component_id) of every row; ``comp`` is null for rows without shingles or id."""
    small_batches(docs)
    base = Saved(sketches(docs, id_col=id_col, text_col=text_col, k=k), "sketches").df
    some = base.where("n > 0 AND id IS NOT NULL")
    # from here on an id is a class's key
    classes = some.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("first"), F.count("*").alias("c"))
    classes = Saved(classes.withColumnRenamed("key", "id"), "classes").df
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    size = k * classes.count()
    counts = Saved(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "counts").df
    rows = Saved(_prefix(values, counts, size), "lists").df  # id, n, v, score
    wanted = rows.select("id").distinct()
    chosen = some.select(F.col("key").alias("id"), F.col("id").alias("doc"), "text_key").join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "text_key")).alias("at")).select("at.*").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).join(chosen, ["doc", "text_key"], "left_semi")
    sets = Saved(full_sets(texts, text_col="text").dropDuplicates(["id"]), "sets").df
    low = classes.select("id", "n", "sketch").join(wanted, "id", "left_semi")

    def links(pairs: DataFrame) -> DataFrame:
        return _confirm(Saved(_sketch_filter(pairs, low, k, num, den), "pairs").df, sets, num, den)

    def fits(x: str, y: str):
        return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)

    def lists(members: DataFrame) -> DataFrame:
        """The members of every list of two or more, with the list's length ``m`` and its pivot ``p``."""
        stat = members.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("score", (-F.col("id")).alias("neg"), "n", "comp")).alias("p"))
        stat = Saved(stat.where("m > 1"), "stat").df
        return joined_apart(members, stat, stat.where(F.col("m") >= hot_from(size)), ["v"])

    def short_pairs(listed: DataFrame) -> DataFrame:
        short = listed.where(F.col("m") <= SHORT)
        x = short.select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        y = short.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
        return x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb")).select("a", "b")

    # first round: short lists and pivots
    listed = lists(rows.withColumn("comp", F.col("id")))
    long = listed.where((F.col("m") > SHORT) & (F.col("id") != -F.col("p.neg")))
    long = long.select("id", "n", (-F.col("p.neg")).alias("q"), F.col("p.n").alias("nq")).where(fits("n", "nq"))
    pivots = long.select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b"))
    edges = Saved(links(short_pairs(listed).union(pivots).distinct()), "links").df
    labels = connected_components(edges).df.withColumnsRenamed({"node": "id", "component": "comp"})
    # second round: values that span two components, their lists cut anew to the rarest
    spread = Saved(values.join(wanted, "id", "left_semi").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "spread").df
    by = spread.groupBy("v").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v", "c")
    fresh = _prefix(spread.select("id", "n", "v"), Saved(by, "counts").df, size).join(spread.select("id", "comp").distinct(), "id")
    listed = Saved(lists(fresh), "lists").df
    more = Saved(links(short_pairs(listed).distinct()), "links").df.union(Saved(_families(listed, sets, num, den), "links").df)
    labels = connected_components(edges.union(more)).df.withColumnsRenamed({"node": "id", "component": "comp"})
    # a component's smallest id, for each of its classes
    comps = classes.select("id", "first", "c").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    comps = Saved(comps, "comps").df
    least = comps.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    least = Saved(least, "least").df
    named = joined_apart(comps, least, least.where(F.col("m") >= hot_from(size)), ["comp"]).select(F.col("id").alias("key"), "comp", "component_id", "c")
    named = Saved(named, "named").df
    out = joined_apart(some, named, named.where(F.col("c") >= hot_from(size // k)), ["key"]).select("id", "text_key", "n", "comp", "component_id")
    alone = base.where("n = 0 OR id IS NULL").select("id", "text_key", "n", F.lit(None).cast("long").alias("comp"), F.col("id").alias("component_id"))
    return out.unionByName(alone)


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, k: int = K) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    return _near(docs, id_col, text_col, num, den, k).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op4(docs: DataFrame) -> DataFrame:
    return near_components(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns it came with: that of the smallest id.

    Rows without shingles or id all stay. Of rows that repeat an id within a component, the one with the smallest text hash stays;
    which of two rows with the same id and text stays, if their other columns differ, is not defined.
    """
    near = _near(docs, id_col, text_col, 75, 100, K)
    stays = near.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("id", "text_key")).alias("at")).select(F.col("at.id").alias("_id"), F.col("at.text_key").alias("_text_key"), F.lit(1).alias("_one"))
    alone = near.where("comp IS NULL AND id IS NOT NULL").select(F.col("id").alias("_id"), F.col("text_key").alias("_text_key"), F.lit(0).alias("_one")).distinct()
    kept = Saved(stays.unionByName(alone), "kept").df
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text_key"))
    named = keyed.join(kept, ["_id", "_text_key"])
    one = named.where("_one = 1").dropDuplicates(["_id", "_text_key"])
    rest = keyed.where(F.col("_id").isNull()).select("_doc").unionByName(named.where("_one = 0").select("_doc")).unionByName(one.select("_doc"))
    return rest.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
