"""Divergence by inclusion and exclusion against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestar.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, p double, item string, value long, term string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 0.5, "x", 3, "t") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def brute(rows, least=3, top=200):
    seen, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        seen[lang, source].update(words)
        held[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((seen[lang, s] for s in sources), Counter()))
        p = {s: shares(seen[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if seen[lang, s][t] and p[s][t] > whole[t]]
            for part, listed, most in (("pair", pair, None), ("term", term, top)):
                listed.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(listed[:most])}
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéßж字" for b in "klmnopqrstuv"] + ["Word", "wORD", "x_y", "a1b"]
    out = []
    for _ in range(n):
        source = r.choice(["s1", "s1", "s1", "S2", "s3", "é", None, ""])
        lang = r.choice(["en", "en", "de", None])
        mine = words if source != "s3" else words[:20]
        out.append((" ".join(r.choice(mine) for _ in range(r.randrange(40))) or r.choice([None, "", " 12 "]), lang, source))
    return out


def got(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_equals_sums_over_all_terms(spark):
    rows = rows_of(1, 150) + [("rare words here", "xx", "only"), (None, "yy", "a"), ("", "yy", "b"), ("one two", "yy", None)]
    rows += rows[:10]  # repeated rows count again
    df = divergence.op11(docs(spark, rows).repartition(3))
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert df.count() == len(got(df))
    assert got(df) == brute(rows)


def test_only_the_first_terms_are_listed(spark):
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "en", s) for s in "aab"] + [("zz zz", "en", "b")]
    assert got(divergence.divergence(docs(spark, rows), top=7)) == brute(rows, top=7)


def test_one_very_long_text_and_a_hot_source(spark):
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 23)}" for i in range(60_000)), "en", "long")] + [("wab waa wxx", "en", "hot")] * 300 + [("wab", "en", "b")] * 3
    assert got(divergence.op11(docs(spark, rows))) == brute(rows)


def test_nothing(spark):
    assert divergence.op11(docs(spark, [])).count() == 0


def test_shares_of_counts_near_the_top_of_64_bits(spark):
    n, total, terms = 4 * 10**15, 9 * 10**15, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).head()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + terms)
