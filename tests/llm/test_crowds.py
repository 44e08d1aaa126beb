"""Repeats in grams with more phrases than one task may hold."""

import random
import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from lodestar.llm import repeats

from .test_operators import brute_repeats


def test_crowded_grams_are_split(spark, monkeypatch):
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    a, line = text(600), text(60)
    rows = [(1, a), (2, text(40) + a[100:340])] + [(10 + i, text(150) + a[50 : 240 + 10 * i] + text(90)) for i in range(9)] + [(40 + i, text(170) + line + text(200)) for i in range(9)]
    held, compare = [], repeats._compare

    def spy(phrases, *more):
        held.append(phrases.groupBy("gram").count().agg(F.max("count")).head()[0] or 0)
        return compare(phrases, *more)

    monkeypatch.setattr(repeats, "_compare", spy)
    got = {x["key"]: x["spans"] for x in repeats.repeated_spans(spark.createDataFrame(rows, "key long, text string").repartition(3), crowd=4).collect()}
    for i, n, removed, runs, _ in brute_repeats(rows, 200):
        out = repeats.merged([(s["start"], s["end"]) for s in got.get(i, ())], n)
        assert (sum(b - a for a, b in out), len(out)) == (removed, runs)
    assert max(held) <= 4


def test_windows_are_compared_by_bytes():
    r = random.Random(3)
    some = lambda n: bytes(r.choice((0, 0, 1)) for _ in range(n))
    base = some(120)
    rows = []
    for i in range(60):
        a, b = r.randrange(0, 60), r.randrange(0, 60)
        left = (some(r.randrange(60)) + base[60 - a : 60])[-50:]
        rows.append((i % 3, len(left), left + base[60 : 60 + b] + some(r.randrange(1, 60))))
    rows.sort(key=lambda x: x[0])
    for length in (40, 70):
        width = length - repeats.GRAM + 1
        cuts = [{b: x[n - b : n - b + length] for b in range(min(width - 1, n) + 1) if len(x) - n + b >= length} for _, n, x in rows]
        want = []
        for i, mine in enumerate(cuts):
            hit = [b for b, w in mine.items() if any(j != i and rows[j][0] == rows[i][0] and other.get(b) == w for j, other in enumerate(cuts))]
            want.append((min(hit, default=-1), max(hit, default=-2)))
        low, high = repeats._cut_suffixes(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), [x[2] for x in rows], length)
        assert list(zip(low.tolist(), high.tolist(), strict=True)) == want and max(want) > (0, 0)


def test_memory_of_a_full_gram_is_flat():
    r = np.random.default_rng(1)
    n = repeats.CROWD
    data = [bytes(x) for x in r.integers(0, 256, (n, 368), np.uint8)]
    tracemalloc.start()
    repeats._cut_suffixes(np.zeros(n, np.int64), np.full(n, 168), data, 200)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
