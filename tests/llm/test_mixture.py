"""Mixture packing: every token once, no padding, windows at their targets."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from lodestar.llm import mixture
from lodestar.llm.packing import default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, row int, id string, n long, part int, queue string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 5, 3, "q") for i, t, s in rows], SCHEMA)


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def tokens(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, capacity=2048):
    """rows: (id, text, source) with different ids."""
    ids, pieces, sequences = {i: tokens(t) for i, t, _ in rows}, defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), [*sorted(pieces[i])[1:], (len(x), 0)], strict=True)) and min(pieces[i])[0] == 0
    sizes = []
    for x in sequences.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False))
        sizes.append(x[-1][0] + x[-1][1])
    total = sum(map(len, ids.values()))
    rest = [1 << b for b in range(capacity.bit_length()) if total % capacity >> b & 1]
    assert Counter(sizes) == Counter([capacity] * (total // capacity) + rest)


def texts(seed, n, longest=600):
    r = random.Random(seed)
    names = ["hot"] * 6 + ["b", "c", None, ""]
    return [(i, None if i % 97 == 5 else " ".join(r.choice(["alpha", "beta", "Gamma", "déjà", "x1", "\n"]) for _ in range(r.randrange(longest))), r.choice(names)) for i in range(n)]


def test_every_token_once_without_padding(spark):
    rows = texts(1, 300)
    check(rows, mixture.op13(docs(spark, rows).repartition(3)).collect())


def test_parts_join_without_a_seam(spark):
    rows = texts(2, 200)
    got = mixture.mix(docs(spark, rows), part_tokens=5000).withColumnRenamed("id", "doc_id").collect()
    check(rows, got)


def windows(rows, got):
    source = {i: s or "" for i, _, s in rows}
    out = defaultdict(Counter)
    for r in got:
        out[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    return [out[k] for k in sorted(out)]


def test_windows_keep_the_corpus_mixture(spark):
    rows = texts(3, 400)
    got = mixture.mix(docs(spark, rows), part_tokens=20_000).withColumnRenamed("id", "doc_id").collect()
    share = Counter()
    for i, t, s in rows:
        share[s or ""] += len(tokens(t))
    total, so_far = sum(share.values()), Counter()
    full = [w for w in windows(rows, got) if sum(w.values()) == 2048]
    assert len(full) > 20
    for k, w in enumerate(full):
        so_far += w
        for s, n in share.items():
            assert abs(w[s] - 2048 * n / total) <= 2 * mixture.LEAST
            assert abs(so_far[s] - 2048 * (k + 1) * n / total) <= mixture.LEAST + 1  # deficits are carried, not lost


def test_given_targets_hold_until_a_queue_is_empty(spark):
    rows = [(i, "one two three four " * 40, "a" if i < 100 else "b") for i in range(400)]
    got = mixture.mix(docs(spark, rows), targets={"a": 0.5}, part_tokens=6000).withColumnRenamed("id", "doc_id").collect()
    check(rows, got)
    w = windows(rows, got)
    of_a = sum(x["a"] for x in w)
    mixed = int(2 * of_a / 2048) - 1
    assert mixed > 5 and all(abs(x["a"] - 1024) <= 2 * mixture.LEAST for x in w[:mixed])
    assert not any(x["a"] for x in w[mixed + 3 :])


def test_targets_that_cannot_hold(spark):
    df = docs(spark, [(1, "x", "a"), (2, "y", "b")])
    for bad in ({"a": 0.0}, {"a": 1.0}):
        with pytest.raises(ValueError):
            mixture.mix(df, targets=bad)


def test_many_small_sources_share_queues(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randrange(1, 60), f"s{r.randrange(150)}") for i in range(600)]
    check(rows, mixture.mix(docs(spark, rows), queues=5, part_tokens=2500).withColumnRenamed("id", "doc_id").collect())
    got = mixture.mix(docs(spark, rows), queues=5).withColumnRenamed("id", "doc_id").collect()
    check(rows, got)
    assert Counter(r["length"] < 4 for r in got)[True] < len(got) / 8  # no flood of tiny pieces


def test_one_very_long_text(spark):
    rows = [(1, "long text goes on and on. " * 40_000, "a"), (2, "", "b"), (3, None, None)]
    check(rows, mixture.mix(docs(spark, rows), part_tokens=30_000).withColumnRenamed("id", "doc_id").collect())


def test_repeated_and_null_ids(spark):
    rows = [(None, "same text", "a")] * 4 + [(7, "same text", "a")] * 3
    got = mixture.op13(docs(spark, rows)).collect()
    n = len(tokens("same text"))
    assert sum(r["length"] for r in got) == 7 * n and sum(r["length"] for r in got if r["doc_id"] is None) == 4 * n


def test_nothing(spark):
    df = mixture.op13(docs(spark, []))
    assert df.count() == 0
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]


def test_a_power_of_two_alone_is_one_sequence():
    total = 2048 * 3 + 1536
    assert [mixture.place(p, total) for p in (0, 2047, 2048, 6144, 6144 + 1023, 6144 + 1024, total - 1)] == [(0, 0, 2048), (0, 2047, 2048), (1, 0, 2048), (3, 0, 1024), (3, 1023, 1024), (4, 0, 512), (4, 511, 512)]
