"""Personal data: validated base patterns, then bootstrapped contextual extraction. DataFrame functions only.

1. Base entities (email, ip, card, phone) are found by regular expressions and validated.
2. Every base entity is a seed instance, and every other token with a digit or ``@`` is an unlabelled one, but for numbers of 16
   to 19 digits that fail as cards: what is known not to be an identifier takes no part. An instance has up
   to four lexical patterns: the two words before it, the word before it, the word after it (for entities of one
   token), all lower-cased and with digits masked, and its shape (``@`` or not, and its number of digits in five steps).
3. Patterns and instances form a bipartite graph; patterns with fewer than ``LEAST_SUPPORT`` instances are left out. In each round
   a pattern's score is the smoothed mean of its distinct instances' scores, and an unlabelled instance's score is the smoothed
   mean of the scores of those of its patterns that have an identifier. An instance that reaches ``ACCEPT`` with two of them
   counts as an identifier for the next round, so that patterns without any base entity rise through it and find others.
4. A left context with a score of ``LEAST_SCORE`` that rests on ``LEAST_SUPPORT`` identifiers extracts the instances after it that
   no base pattern matched (kind ``context``). Two words that so many base entities follow need no more; any other
   context extracts only shapes that base entities have and whose score is at least ``LEAST_SHAPE``.

Matches never span lines and offsets are code points. The possessive forms used below match what the plain greedy forms match,
without backtracking or recursion, so long runs of digits or dotted labels stay linear.

Defined results: null text is empty; repeated rows are judged row by row, and count once in the graph; empty tables give no rows;
extra columns are ignored by ``find_spans`` and kept by ``redact``. Words and tokens that a large part of the table has are joined
apart from the others.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, Scratch, hot_from, joined_apart

#: kind -> (pattern, cheap test that must hold for any match)
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = [*BASE, "context"]
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
ROUNDS = 5
LEAST_SUPPORT = 8
LEAST_SCORE = 0.9
LEAST_SHAPE = 0.5
ACCEPT = 0.5
PRIOR = 0.5  # unlabelled mass added to each pattern and each instance
#: Ends of a token that are no part of an identifier.
HEAD, TAIL = r"^[^\p{L}\p{N}+@]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"

_SPAN = "array<struct<kind:int,start:int,end:int>>"
_ENTITIES = "array<struct<kind:int,start:int,end:int,m:string>>"
_INSTANCES = "array<struct<two:string,one:string,next:string,shape:string,token:string,start:int,end:int,seed:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(x))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.when((n >= 16) & (n <= 19), _luhn(_digits(x))).otherwise(False)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


FEW = 64  # items that a plain fold takes


def _running(values: Column, step, first: int = 0) -> Column:
    """For each item of an array of numbers, the fold of the items before it.

    A fold that collects its states copies them at every step. So a long array is folded in chunks of about the root of its
    size, from the folds of the chunks before: n items cost n * sqrt(n) copies, not n * n.
    """

    def states(xs: Column, start: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x)))), 1, F.size(xs))

    def chunked(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(xs) - 1, width).cast("int")), lambda c: F.slice(xs, c * width + 1, width))
        whole = lambda cs: states(F.transform(cs, lambda c: F.aggregate(c, F.lit(first), step)), F.lit(first))
        return _bound(chunks, lambda cs: _bound(whole(cs), lambda starts: F.flatten(F.transform(cs, lambda c, i: states(c, F.get(starts, i))))))

    return _bound(values, lambda xs: F.when(F.size(xs) <= FEW, states(xs, F.lit(first))).otherwise(chunked(xs)))


def _sum(a: Column, x: Column) -> Column:
    return a + x


def _located(text: Column, pattern: str, made) -> Column:
    """made(match, start, piece before) of every match, in order; pieces between matches give the offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)
    zipped = F.zip_with(hits, F.slice(rest, 1, F.size(hits)), lambda m, p: F.struct(m.alias("m"), p.alias("p"), (F.length(m) + F.length(p)).alias("n")))
    return _bound(zipped, lambda zs: F.zip_with(zs, _running(F.transform(zs, lambda z: z["n"]), _sum), lambda z, s: made(z["m"], s + F.length(z["p"]), z["p"])))


def _checked(kind: str):
    return lambda x: _valid(kind, x["m"])


def _match(k: int, m: Column, s: Column, _: Column) -> Column:
    return F.struct(F.lit(k).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"))


def _entities(text: Column) -> Column:
    """array<struct<kind,start,end,m>> of the valid base entities, by kind and start."""
    none = F.array().cast(_ENTITIES)
    parts = []
    for k, (kind, (pattern, test)) in enumerate(BASE.items()):
        found = _located(text, pattern, partial(_match, k))
        good = F.filter(found, _checked(kind))
        parts.append(F.when(F.contains(text, F.lit("@")) if test is None else text.rlike(test), good.cast(_ENTITIES)).otherwise(none))
    return F.concat(*parts)


def _places(entities: Column) -> Column:
    return F.transform(entities, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end>> of the valid base entities, by kind and start."""
    return _places(_entities(text))


def _word(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[0-9]", "0"))


def _shape(token: Column) -> Column:
    n = F.length(_digits(token))
    step = F.when(n == 0, "0").when(n < 4, "1").when(n < 8, "4").when(n < 16, "8").otherwise("16")
    return F.concat(F.when(F.contains(token, F.lit("@")), "@").otherwise(""), step)


_AROUND = f"array<struct<inner:{_ENTITIES},inside:boolean>>"


def _around(tokens: Column, base: Column) -> Column:
    """For each token the base entities that begin in it, and whether it begins inside one; the last token is a stop only."""

    def plain(x: Column) -> Column:
        stop = x["start"] + F.length(x["m"])
        return F.struct(F.filter(base, lambda b: (x["start"] <= b["start"]) & (b["start"] < stop)).alias("inner"), F.exists(base, lambda b: (b["start"] < x["start"]) & (x["start"] < b["end"])).alias("inside"))

    # where there are many of both, they are put in one order: the entities of a token follow it, and what ends after it began before
    none = F.lit(None).cast("struct<kind:int,start:int,end:int,m:string>")
    kind = "array<struct<at:int,later:int,b:struct<kind:int,start:int,end:int,m:string>>>"
    marks = F.concat(F.transform(tokens, lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("later"), none.alias("b"))).cast(kind), F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("later"), b.alias("b"))).cast(kind))

    def merged(every: Column) -> Column:
        places = F.filter(F.transform(every, lambda e, i: F.when(e["later"] == 0, i)), lambda i: i.isNotNull())
        reach = _running(F.transform(every, lambda e: F.coalesce(e["b"]["end"], F.lit(0))), lambda a, x: F.greatest(a, x))

        def one(at: Column, reach: Column, places: Column, k: Column) -> Column:
            following = F.slice(every, at + 2, F.coalesce(F.get(places, k + 1), F.size(every)) - at - 1)
            return F.struct(F.transform(following, lambda e: e["b"]).alias("inner"), (F.get(reach, at) > F.get(every, at)["at"]).alias("inside"))

        return _bound(places, lambda ps: _bound(reach, lambda r: F.transform(ps, lambda at, k: one(at, r, ps, k))))

    few = F.size(tokens).cast("long") * F.size(base) <= FEW * FEW
    return F.when(few, F.transform(tokens, plain).cast(_AROUND)).otherwise(_bound(F.array_sort(marks), merged).cast(_AROUND))


def _instances(text: Column, base: Column) -> Column:
    """Instances with their contexts: base entities (seed 1), and tokens that no base entity touches (seed 0)."""
    hits = _located(text, TOKEN, lambda m, s, p: F.struct(m.alias("m"), s.alias("start"), p.alias("p")))
    # one more entry holds what follows the last token
    last = F.struct(F.lit("").alias("m"), F.length(text).alias("start"), F.element_at(F.split(text, TOKEN, -1), -1).alias("p"))
    located = F.concat(hits, F.array(last))

    def made(all_: Column, around: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            head = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], HEAD, ""))
            token = F.regexp_replace(F.regexp_replace(x["m"], HEAD, ""), TAIL, "")
            stop = x["start"] + F.length(x["m"])
            # with two earlier tokens, which are words themselves, there are two words before any token that has them
            back = lambda n, field: F.coalesce(F.get(all_, i - n)[field], F.lit(""))
            before = F.concat(back(2, "m"), back(1, "p"), back(1, "m"), x["p"])
            two = F.substring_index(_word(F.trim(F.regexp_replace(before, r"\s+", " "))), " ", -2)
            follows = F.get(all_, i + 1)
            after = F.regexp_extract(follows["p"], r"^\s*+(\S++)", 1)
            after = _word(F.when(after == "", F.regexp_replace(follows["m"], TAIL, "")).otherwise(after))

            def instance(token: Column, start: Column, end: Column, seed: Column) -> Column:
                near = F.when(end <= stop, after).otherwise("")
                return F.struct(two.alias("two"), F.substring_index(two, " ", -1).alias("one"), near.alias("next"), _shape(token).alias("shape"), token.alias("token"), start.alias("start"), end.alias("end"), seed.alias("seed"))

            inner = F.get(around, i)["inner"]
            seeds = F.transform(inner, lambda b: instance(b["m"], b["start"], b["end"], F.lit(1)))
            # a card number but for its check digits is known not to be one
            false = _digits(token).rlike("^[0-9]{16,19}$") & ~token.rlike("[^0-9-]")
            start = x["start"] + head
            plain = F.when(F.get(around, i)["inside"] | ~token.rlike("[0-9@]"), F.array().cast(_INSTANCES)).otherwise(F.array(instance(token, start, start + F.length(token), F.when(false, -1).otherwise(0))).cast(_INSTANCES))
            return F.when(F.size(inner) > 0, seeds.cast(_INSTANCES)).otherwise(plain)

        return F.flatten(F.transform(F.slice(all_, 1, F.size(all_) - 1), one))

    # bound once: every token looks at the tokens around it
    return _bound(located, lambda all_: _bound(_around(all_, base), lambda around: made(all_, around)))


def _with_base(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.select(*keep, text.alias("_text"), _entities(text).alias("_found"))
    many = F.col("_text").rlike("[0-9@]")
    empty = F.array().cast(_INSTANCES)
    step = step.select(*keep, _places(F.col("_found")).alias("_base"), F.when(many, _instances(F.col("_text"), F.col("_found"))).otherwise(empty).alias("_instances"))
    return step.withColumn("_row", F.monotonically_increasing_id())


def _patterns(*kinds: str) -> Column:
    """The named patterns of an instance that has them, each with its kind before it."""
    return F.array_compact(F.array(*(F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), F.col(k))) for k in kinds)))


def _scored(state: DataFrame) -> DataFrame:
    """Each pattern's score, its identifiers, and the base entities among them."""
    mean = F.round(F.sum("score") / (F.count("*") + PRIOR), 9)
    return state.groupBy("pattern").agg(mean.alias("p"), F.sum((F.col("score") >= 1).cast("long")).alias("support"), F.sum("seed").alias("seeds"))


def bootstrapped(seen: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pattern, p, support, seeds) after all rounds, and the patterns that many instances have."""
    pairs = seen.where("seed >= 0").select(F.explode(_patterns("two", "one", "next", "shape")).alias("pattern"), "token", "seed")
    pairs = scratch.save(pairs.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pairs")
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    frequent = scratch.save(sizes.where(F.col("n") >= max(LEAST_SUPPORT, hot_from(pairs.count()))).select("pattern"), "frequent")
    edges = scratch.save(joined_apart(pairs, sizes.select("pattern"), frequent, ["pattern"]), "edges")
    plain = edges.where("seed = 0").select("pattern", "token")
    everywhere = plain.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= hot_from(edges.count()))
    everywhere = scratch.save(everywhere.select("token"), "everywhere")
    known = edges.where("seed = 1").withColumn("score", F.lit(1.0))
    state = known.unionByName(plain.select("*", F.lit(0).alias("seed"), F.lit(0.0).alias("score")))
    for _ in range(ROUNDS):
        # a pattern without any identifier speaks neither for nor against an instance
        p = _scored(state).select("pattern", F.when(F.col("support") > 0, F.col("p")).alias("p"))
        mean = F.round(F.coalesce(F.sum("p"), F.lit(0.0)) / (F.count("p") + PRIOR), 9)
        tokens = joined_apart(plain, p, p.join(F.broadcast(frequent), "pattern"), ["pattern"]).groupBy("token").agg(mean.alias("q"), F.count("p").alias("k"))
        tokens = tokens.select("token", F.when((F.col("q") >= ACCEPT) & (F.col("k") > 1), 1.0).otherwise(F.col("q")).alias("score"))
        judged = joined_apart(plain, tokens, tokens.join(F.broadcast(everywhere), "token"), ["token"]).withColumn("seed", F.lit(0))
        state = scratch.save(known.unionByName(judged), "scores")
    return scratch.save(_scored(state), "patterns"), frequent


def discovered(saved: DataFrame) -> DataFrame:
    """(_row, more): spans of unseen identifiers after confident patterns; ``saved`` is a stable table."""
    scratch = Scratch()
    seen = saved.select("_row", F.explode("_instances").alias("x")).select("_row", "x.*")
    patterns, frequent = bootstrapped(seen, scratch)
    confident = (F.col("p") >= LEAST_SCORE) & (F.col("support") >= LEAST_SUPPORT)
    direct = F.col("pattern").startswith("two:") & (F.col("seeds") >= LEAST_SUPPORT)
    good = patterns.where(confident & ~F.col("pattern").startswith("shape:") & ~F.col("pattern").startswith("next:")).select("pattern", direct.alias("direct"))
    # ten shapes at most
    shapes = patterns.where(F.col("pattern").startswith("shape:") & (F.col("p") >= LEAST_SHAPE) & (F.col("seeds") >= LEAST_SUPPORT))
    shapes = shapes.select(F.substring_index("pattern", ":", -1).alias("shape"), F.lit(True).alias("usual"))
    after = seen.where("seed = 0").select("_row", "start", "end", "shape", F.explode(_patterns("two", "one")).alias("pattern"))
    found = joined_apart(after, good, good.join(F.broadcast(frequent), "pattern"), ["pattern"]).join(F.broadcast(shapes), "shape", "left")
    span = F.struct(F.lit(len(BASE)).alias("kind"), "start", "end")
    out = Saved(found.where("direct OR usual").groupBy("_row").agg(F.array_sort(F.collect_set(span)).cast(_SPAN).alias("_more")), "found").df
    scratch.drop()
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``all_spans``, arrays of (kind, start, end)."""
    keep = ["doc_id"] if keep is None else keep
    saved = Saved(_with_base(docs, text_col, keep), "entities").df
    out = saved.join(discovered(saved), "_row", "left")
    return out.select(*keep, F.col("_base").alias("base"), F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN))).alias("all_spans"))


def op2(docs: DataFrame) -> DataFrame:
    out = find_spans(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    n = {kind: (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)}
    return out.select("doc_id", *n.values(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))


BLOCK = 4096


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """The text from a to b, taken from its blocks of ``BLOCK`` code points: reading up to a place in a long text costs its length."""
    i, j = F.call_function("div", a, F.lit(BLOCK)).cast("int"), F.call_function("div", b, F.lit(BLOCK)).cast("int")
    at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    apart = F.concat(F.substring(at(i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b % BLOCK))
    return F.when(i == j, F.substring(at(i), a % BLOCK + 1, b - a)).otherwise(apart)


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def masked(blocks: Column, order: Column) -> Column:
        covered = _running(F.transform(order, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        begun = F.filter(F.zip_with(order, covered, lambda s, c: F.struct(s.alias("s"), c.alias("c"))), lambda x: x["s"]["start"] >= x["c"])
        out = F.transform(begun, lambda x: F.concat(_piece(blocks, x["c"], x["s"]["start"]), F.element_at(names, x["s"]["kind"] + 1)))
        return F.concat(F.array_join(out, ""), _piece(blocks, F.array_max(F.transform(order, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_bound(blocks, lambda bs: _bound(order, lambda o: masked(bs, o))))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked; every row stays, with the columns it came with."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_from"))
    saved = Saved(_with_base(whole, "_from", ["_doc"]), "entities").df
    out = saved.join(discovered(saved), "_row", "left")
    spans = F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN)))
    out = out.select("_doc", spans.alias("_spans"))
    text = F.col("_doc")[text_col]
    return out.select(*(F.when(F.size("_spans") == 0, text).otherwise(_masked(text, F.col("_spans"))).alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns))
