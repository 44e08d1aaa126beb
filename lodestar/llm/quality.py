"""Quality classifier: a generalised additive model with pairwise interactions.

Shape statistics of each whole text are binned at quantiles. Cyclic boosting visits one feature after another and
fits a shallow tree on its bins to the log-loss gradient, so each feature ends as one lookup table; the pairs whose
joint table explains most of what is left get two-cut trees on a grid in the same way. A score is the sum of looked-up
values, added for whole batches at a time.

Fitting takes at most ``max_rows`` labelled rows (those with the smallest hash of the id, 20,000 by default), so the
driver's share is bounded; statistics and scores cover every row.

Defined results: null and empty texts have all-zero statistics and get a score like any other; without labels of both
kinds every score is the share of positive labels (0.5 without labels); rows that repeat an id count once for each label it
has, with the smallest statistics; label rows with a null id or null quality are ignored; a null id is not held out; extra
columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches

FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "distinct", "top_word", "repeats", "repeated_lines", "short_words", "stops", "bars", "bangs", "lines", "not_ascii", "commas", "odd_ends")
MAX_ROWS = 20_000
BINS, GRID, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.1

_CLASS = {
    "symbols": b"#$%&*@^~<>={}[]\\/_+`|!", "digits": b"0123456789", "stops": b".?!;:", "bars": b"|", "bangs": b"!", "lines": b"\n", "commas": b",",
    "upper": bytes(range(65, 91)), "not_ascii": bytes(range(128, 256)),
}
_WORD_ENDS = np.zeros(256, bool)
_WORD_ENDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,"]] = True
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = len(raw) - int(counts[[9, 10, 11, 12, 13, 32]].sum())
    share = {k: float(counts[m].sum()) / solid for k, m in _MASKS.items()}
    seen = Counter(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(v for w, v in seen.items() if not _WORD_ENDS[w[-1]])
    short = sum(v for w, v in seen.items() if len(w) <= 3)
    return [
        float(np.log1p(n)), solid / n, share["symbols"], share["upper"], share["digits"], len(seen) / n, seen.most_common(1)[0][1] / n if n > 1 else 0.0,
        sum(map(eq, ws, ws[1:])) / n, 1 - len(set(lines)) / len(lines), short / n, share["stops"], share["bars"], share["bangs"], share["lines"],
        share["not_ascii"], share["commas"], ends / n,
    ]


class Gam:
    """Bin edges, one lookup table per feature, and one per chosen pair."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: np.ndarray, pairs: list[tuple[int, int]], grids: np.ndarray, coarse: np.ndarray):
        self.bias, self.edges, self.tables, self.pairs, self.grids, self.coarse = bias, edges, tables, pairs, grids, coarse

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), self.bias)
        b = self.bins(x)
        out = self.bias + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        g = self.coarse[np.arange(b.shape[1]), b]
        for k, (i, j) in enumerate(self.pairs):
            out += self.grids[k][g[:, i], g[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 1.0) -> np.ndarray:
    """Leaf values per bin of a tree with up to ``leaves`` leaves on ordered bins."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-6, None, 0)
        for p in parts:
            a, b = p
            cuts = np.arange(a + 1, b)
            cuts = cuts[(ch[cuts] - ch[a] >= least) & (ch[b] - ch[cuts] >= least)]
            if len(cuts):
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (float(gains[k]), p, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either axis of a grid: its gain and its cell values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    r, c = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    total_g, total_h = cg[-1, -1], ch[-1, -1]

    def quadrants(t, total):
        a = t[r, c]
        up, left = t[r, -1], t[-1, c]
        return a, up - a, left - a, total - up - left + a

    qs = list(zip(quadrants(cg, total_g), quadrants(ch, total_h), strict=True))
    gains = sum(a**2 / (b + ridge) for a, b in qs) - total_g**2 / (total_h + ridge)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = [float((-a / (b + ridge))[i, j]) for a, b in qs]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v[0], v[1], v[2], v[3]
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, grid: int = GRID, n_pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Gam:
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Gam(float(np.log(share / (1 - share))), [], np.zeros((0, 0)), [], np.zeros((0, 0, 0)), np.zeros((0, 0), int))
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    coarse = np.zeros((m, bins), int)
    for j, e in enumerate(edges):
        coarse[j] = np.minimum(np.arange(bins) * grid // (len(e) + 1), grid - 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    model = Gam(bias, edges, np.zeros((m, bins)), [], np.zeros((0, grid, grid)), coarse)
    b = model.bins(x)
    margin = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, bins), np.bincount(b[:, j], h, bins))
            model.tables[j] += step
            margin += step[b[:, j]]
    cells = coarse[np.arange(m), b]
    flat = lambda i, j: cells[:, i] * grid + cells[:, j]
    table = lambda v, i, j: np.bincount(flat(i, j), v, grid * grid).reshape(grid, grid)
    g, h = slopes()
    ranked = sorted(((_cross(table(g, i, j), table(h, i, j))[0], i, j) for i in range(m) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.grids = np.zeros((len(model.pairs), grid, grid))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _cross(table(g, i, j), table(h, i, j))[1]
            model.grids[k] += step
            margin += step.ravel()[flat(i, j)]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def _with_statistics(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch.column(at)], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Fits on the labelled rows outside the held-out third, at most ``max_rows`` of them."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _with_statistics(batch, batch.schema.get_field_index("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # rows that repeat an id count once, so that the driver gets no more than max_rows
    one = rows.mapInArrow(run, "id string, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))
    got = sorted(one.collect())
    x = np.array([r[2] for r in got], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], np.float64))


def score(docs: DataFrame, model: Gam, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs)
    at, names = docs.columns.index(text_col), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(_with_statistics(batch, at)))], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows the model doesn't reject, with the columns they came with."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(_with_statistics(batch, at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
