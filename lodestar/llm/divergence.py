"""How far the sources of a language differ in their words, without ever laying out words x sources.

Each (language, source) group gives every kept term a share p, an integer in parts of a milliard that depends on the
term's count in the group only; all terms that a group lacks share one value, p0. The divergence of two groups g, h is
the sum of f(p, q) = floor((p - q)^2 / q) over all kept terms, and by inclusion and exclusion over the two supports
it falls apart into

* terms of g as if h lacked them, and terms of h as if g lacked them: priced from a histogram of each group's counts;
* terms that both lack: a number of terms times the constant f(p0, q0), entered as the histogram's row of count 0;
* a correction f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for the terms that both hold, found by joining postings.

So the work follows the postings that two sources really share and the different counts, not terms x sources. Terms are
counted inside Arrow batches and summed by Spark. Histograms meet the other sources of their language in salted joins, so a
language is not one task.

All arithmetic is in 64-bit integers: shares by long division in three steps (no product beyond 1000 times a corpus
count), and since the shares of a group add up to little more than 10^9, no sum of f exceeds a few 10^18.

Defined results: null text, language and source are read as ''; a group without kept terms has p0 for each of them; a
language without kept terms has pairs of value 0; an empty table gives no rows; repeated rows count as often as they
stand; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, small_batches, shuffle_partitions

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each group."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = small_batches(docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
            held: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
            for lang, source, text in zip(*batch.columns, strict=True):
                group, words = (lang.as_py(), source.as_py()), _WORD.findall(text.as_py().lower())  # of bytes, lower() changes A-Z only
                seen[group].update(words)
                held[group].update(set(words))
            out = [(*g, t, n, held[g][t]) for g, c in seen.items() for t, n in c.items()] + [(*g, None, 0, 0) for g in seen]
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    texts = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    return found.select(*texts, "n", "docs").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), three decimal digits at a time; null if nothing is kept."""
    by, rest, out = F.nullif(total + terms, F.lit(0)), n + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, by)
        rest = (rest * 1000) % by
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence, and the ``top`` terms that a source uses more than its language."""
    counts = Saved(term_counts(docs, **columns), "term-counts").df
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    postings = Saved(counts.drop("docs").join(kept, ["lang", "term"]), "postings").df

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    sizes = postings.groupBy("lang", "source").agg(F.count("*").alias("support"), F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["support", "total", "terms", "all_total"])
    groups = Saved(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups").df
    priced = postings.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("all_n"), F.col("all_total"), F.col("terms"))})
    priced = Saved(priced.select("lang", "source", "term", "n", "p", "q", "p0"), "priced").df
    return pairs(priced, groups).unionByName(terms(priced, top))


def pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of each group from every other source of its language."""
    salts = shuffle_partitions(priced.sparkSession)
    histogram = priced.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("k"))
    lacking = groups.select("lang", "source", F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), "p0", (F.col("terms") - F.col("support")).alias("k"))
    histogram = histogram.unionByName(lacking).withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(salts)).cast("int"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = histogram.join(others, ["lang", "salt"]).where("source <> item")
    one_sided = met.groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * gap(F.col("p"), F.col("q0"))).alias("there"),
        F.sum(F.when(F.col("n") > 0, F.col("k") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))).otherwise(0)).alias("back"),
    )

    a = priced.select("lang", "term", F.col("source"), F.col("p"), F.col("p0"))
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = map(F.col, ("p", "p0", "q", "q0"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(
        F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("there"), F.sum(gap(q, p) - gap(q, p0) - gap(q0, p) + gap(q0, p0)).alias("back")
    )

    def ways(df: DataFrame) -> DataFrame:
        """A row for each direction: the sum for (source, item) and the one for (item, source)."""
        there = F.struct("source", "item", F.col("there").alias("value"))
        back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
        return df.select("lang", F.explode(F.array(there, back)).alias("w")).select("lang", "w.*")

    total = ways(one_sided).unionByName(ways(both)).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    return _ranked(total.withColumn("part", F.lit("pair")))


def terms(priced: DataFrame, top: int = TOP) -> DataFrame:
    """The terms of a group whose share is above the language's, at most ``top`` of them."""
    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def op11(docs: DataFrame) -> DataFrame:
    return divergence(docs)


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM t),
w AS (SELECT i, lang, source, unnest(w) AS term FROM t),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (s.n + v.v) AS p, 1 + (1000000000 * (kept.c + 1)) // (v.n + v.v) AS q
    FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""
