"""Each operator against a brute-force version on small fixtures, with nulls, blanks, ties, repeats and odd columns."""

import hashlib
import html as html_
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, chat, components, decontaminate, html_text, neardup, packing, pii, quality, repeats, shingles, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string, id string, comp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.0, 1, "k", "x", 7) for i, t in rows], DOCS)


def words(n, seed, vocab=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


# -- near duplicates ---------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    r, rows = random.Random(3), [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE\ttwo"), (6, "é É x y z"), (7, "É é x y z")]
    base = words(90, 1)
    for i in range(40):  # a family of near copies around one text, some of them only linked through others
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"v{r.randrange(1000)}"
        rows.append((100 + i, " ".join(w)))
    passage = words(60, 2)
    rows += [(200 + i, " ".join(passage + words(25, 50 + i))) for i in range(30)]  # one passage, otherwise different
    rows += [(300 + i, " ".join(words(300, 9))) for i in range(20)]  # exact copies
    rows += [(400 + i, " ".join(words(r.randrange(1, 400), 1000 + i))) for i in range(60)]
    long_ = words(4000, 77)
    return rows + [(500, " ".join(long_)), (501, " ".join(long_[:3600])), (502, " ".join(long_[:1500]))]


def test_near_components_match_all_pairs(spark):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op4(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


def test_near_components_of_nothing(spark):
    assert neardup.op4(docs(spark, [])).count() == 0
    assert [tuple(r) for r in neardup.op4(docs(spark, [(9, None)])).collect()] == [(9, 0, 9, True)]


def test_keep_one_keeps_columns_and_clean_rows(spark):
    rows = near_rows()
    want = sorted({c for _, c in brute_components(rows).values()})
    out = neardup.keep_one(docs(spark, [*rows, (None, "a null id stays"), rows[-1]]))
    assert out.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == want
    assert out.where("doc_id IS NULL").count() == 1


def test_shingles_in_blocks_equal_single_texts():
    texts = ["", None, "a b c d e f", "A B C D", "x " * 2000, "ü" * 10, "a  b\tc\nd e f"]
    together = list(shingles.shingle_sets(texts))
    assert all(np.array_equal(a, next(iter(shingles.shingle_sets([t])))) for a, t in zip(together, texts, strict=True))
    assert np.array_equal(together[2], together[6]) and len(together[0]) == 0 and len(together[3]) == 1


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).df.collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


# -- repeats -----------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        cover = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = [True] * length
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_match_every_window(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    a, b = text(600), text(260)
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, text(100) + b + text(90)), (5, b), (6, a[:230] + "Q" + a[231:]), (7, "ab" * 400), (8, "z" * 250), (9, text(199)), (10, text(50) + a[100:299] + "!"), (11, text(50) + a[100:300] + "!"), (12, "z" * 199)]
    rows += [(20 + i, text(60) + a[50:300] + text(60)) for i in range(12)]
    got = [tuple(x) for x in repeats.op7(docs(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)


def test_repeats_in_segments(spark, monkeypatch):
    r = random.Random(5)
    a = "".join(r.choice("abcd") for _ in range(9000))
    raw = [a.encode(), (a[2000:2600] + "x" + a[5000:5300]).encode()]
    whole = {(int(i), int(p)) for x in repeats.parse(raw) for i, p in zip(x[0], x[1], strict=True)}
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    monkeypatch.setattr(repeats, "blocks", lambda texts: ((i, i + 1) for i in range(len(texts))))
    assert {(int(i), int(p)) for x in repeats.parse(raw) for i, p in zip(x[0], x[1], strict=True)} == whole


def test_repeats_of_nothing(spark):
    assert repeats.op7(docs(spark, [])).count() == 0


# -- decontamination ---------------------------------------------------------------------------------------------------


def brute_hits(text, items, window=13):
    tok = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = tok(text), set(), set()
    for item, t in items:
        x = tok(t)
        n = min(window, len(x))
        for s in range(len(x) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_matches_every_window(spark):
    items = [(1, " ".join(words(30, 1, 40))), (2, "Short item here"), (10, "solo"), (3, None), (4, "..."), (5, " ".join(words(30, 1, 40)[5:25]) + " tail é"), (5, "SHORT Item; here")]
    r = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a solo b"), (4, "x-short ITEM\there!"), (5, " ".join(words(60, 3, 40))), (6, " ".join(words(10, 4) + words(30, 1, 40)[3:18] + words(300, 5))), (7, "É é"), (8, " ".join(words(5000, 6, 40)))]
    rows += [(20 + i, " ".join(words(20, i) + words(30, 1, 40)[r.randrange(10) :][: r.randrange(9, 20)] + words(20, 99 - i))) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.MAX_ITEM_WORDS, 20):  # one automaton, and several
        out = decontaminate.match_benchmark(docs(spark, rows), bench, max_item_words=size)
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest()) for x in out.collect()}
        assert got == {i: brute_hits(t, items)[:4] for i, t in rows}
    got = {x["doc_id"]: x["contaminated"] for x in decontaminate.op8(docs(spark, rows), bench).collect()}
    assert got == {i: brute_hits(t, items)[4] for i, t in rows}
    kept = decontaminate.clean_documents(docs(spark, rows), bench)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, c in got.items() if not c} and kept.columns == docs(spark, []).columns


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x["n_hit"] for x in decontaminate.op8(docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontaminate.op8(docs(spark, []), none).count() == 0


# -- packing -----------------------------------------------------------------------------------------------------------


def test_best_fit_equals_one_by_one():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([5, 10, 32, 100])
        h = {r.randint(1, cap): r.randint(0, 30) for _ in range(r.randint(1, 12))}
        slots, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in packing.best_fit(h, cap):
            for i in range(n):
                slots[first + i].append((offset, length))
                ranks[length].append(rank + i)
        assert {k: sorted(x) for k, x in ranks.items()} == {k: list(range(n)) for k, n in h.items() if n}
        for x in slots.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= cap
        bins = []
        for length in sorted(h, reverse=True):
            for _ in range(h[length]):
                fit = [b for b in bins if b >= length]
                if fit:
                    bins.remove(min(fit))
                bins.append((min(fit) if fit else cap) - length)
        assert len(slots) == len(bins)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    rows = [(1, None), (2, ""), (3, "a"), (4, " ".join(words(6000, 1))), (5, "<|endoftext|> x"), (6, " é日本 \n\n  z"), (7, "q" * 4000), (8, "same"), (9, "same")] + [(10 + i, " ".join(words(i * 7, i))) for i in range(60)]
    out = packing.op5(docs(spark, rows).repartition(3)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in out:
        by_doc[x["doc_id"]].append(x)
        by_seq[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [x["start"] for x in pieces] == [s for s, _ in packing.cut(len(ids), 2048)] and sum(x["length"] for x in pieces) == len(ids)
        for x in pieces:
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
    for x in by_seq.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.op5(docs(spark, [])).count() == 0


# -- personal data -----------------------------------------------------------------------------------------------------


def luhn(x):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans_match_plain_patterns(spark):
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a@b.c_d@e.f.g. x..@y.zz +1 (017) 555-7713 é😀 10.0.0.256 10.0.0.255.7 001.2.3.0004"), (4, "4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 20), (5, "1" * 5000 + " " + "a." * 3000 + "@b" + ".c" * 3000), (6, "+123 +12345678 +1(2)3.4-5 6789 +1 2"), (7, "a@b c@d. e@f.g\nh@i.j")]
    rows += [(10 + i, "".join(r.choice("01.@+- ()a\né49") for _ in range(300))) for i in range(150)]
    got = {x["doc_id"]: (x["spans"], x["base_sha256"], x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"]) for x in pii.op2(docs(spark, rows)).collect()}
    for i, t in rows:
        want = brute_spans(t)
        assert got[i][1] == hashlib.sha256(",".join(want).encode()).hexdigest() and got[i][2] == len(want), (t, want, got[i])
        assert got[i][0].split(",")[: len(want)] == want or not want


def test_confident_contexts_find_unseen_identifiers(spark):
    card = lambda n: next(f"{p}{c}" for p in [f"4{n:014d}"] for c in range(10) if luhn(f"{p}{c}"))
    rows = [(i, f"please see card number {card(i)} for case{i} done") for i in range(40)] + [(100, "my Card Number 12345678901 is odd"), (101, "the plain word 12345678901 is odd")]
    got = {x["doc_id"]: x["spans"] for x in pii.op2(docs(spark, rows)).collect()}
    assert got[100] == "context:15:26" and got[101] == "" and all(got[i].startswith("card:") for i in range(40))
    red = {x["doc_id"]: x for x in pii.redact(docs(spark, [*rows, (200, None), (201, "é a@b.c, +1 (017) 555-7713!")])).collect()}
    assert red[100]["text"] == "my Card Number [CONTEXT] is odd" and red[200]["text"] is None and red[201]["text"] == "é [EMAIL], [PHONE]!" and red[101]["text"] == rows[-1][1]


def test_pii_of_nothing(spark):
    assert pii.op2(docs(spark, [])).count() == 0 and pii.redact(docs(spark, [])).columns == docs(spark, []).columns


# -- quality -----------------------------------------------------------------------------------------------------------


def test_quality_learns_and_keeps_the_contract(spark):
    rows = [(i, " ".join(words(30 + i % 50, i)).capitalize() + "." if i % 2 else " ".join(f"{w}###" for w in words(40, i))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, " ")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.op3(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == i % 2 for i in held) / len(held) > 0.95
    assert quality.good_documents(docs(spark, rows), labels).columns == docs(spark, []).columns


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x["score"] for x in quality.op3(docs(spark, [(1, "a b c")]), none).collect()] == [0.5]
    assert quality.op3(docs(spark, []), none).count() == 0


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=5)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


# -- HTML --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy this now, it is a very good thing and you want it.</div><div id="cookie-notice"><p>We use cookies.</p></div>%s
<section class="comments"><article><p>A reader says a lot of words about this long article, and then some more.</p></article></section><form><p>Your name</p><input></form><aside><p>Elsewhere on this site there are many other words to read.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text_drops_furniture():
    body = "<article><h1>Title &amp; more</h1><p><b>First.<br><p>To&nbsp;be   or\nnot.</p><p>Short</p><ul><li>item <a href=x>link</a></li></ul><blockquote>said &lt;b&gt;</blockquote></article>"
    assert html_text.main_text(PAGE % body) == "Title & more\nFirst.\nTo be or not.\nShort\nitem link\nsaid <b>"
    long_ = " ".join(words(40, 1)) + "."
    assert html_text.main_text(PAGE % f"<div class=wrap><h1>A title here</h1><p>{long_}</p><p>{long_}</p></div>").split("\n") == ["A title here", long_, long_]


def test_layout_names_are_no_furniture():
    body = "<p>Words of the text that are long enough to be read as the main part of it, and then a few more of them to be sure.</p>"
    page = f"<body class='single sidebar'><div class='page has-sidebar no-comments'><main class='x'><article class='post'><div class='post-header'><h1>Own title</h1></div>{body}</article></main></div><div class='widget'>{body}</div>"
    assert html_text.main_text(page).split("\n")[0] == "Own title" and html_text.main_text(page).count("Words of") == 1


@pytest.mark.parametrize("page", [None, "", "plain < text", "<", "<p", "<script>x", "<!-- x", "</p></div>", "<a href='x>y", "<p title=\"a>b\">ok</p>", "&#0;&bogus;&amp", "<svg><p>a</svg>", "<head><p>body words"])
def test_main_text_survives_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_query_counts_code_points(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<article><p>é😀</p></article>", "x"), (2, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((x["page_id"], x["text"], x["n_chars"]) for x in html_text.op1(pages).collect()) == [(1, "", 0), (2, "", 0), (2, "é😀", 2)]
    assert html_text.op1(pages.limit(0)).count() == 0 and html_.unescape("&lt;") == "<"


# -- neighbours --------------------------------------------------------------------------------------------------------


def test_forest_finds_nearest(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 16))
    x = (centers[r.integers(0, 20, 3000)] + 0.3 * r.normal(size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[500]  # a third are one vector
    rows = [(i, x[i].tolist(), "l") for i in range(3000)] + [(9000, None, "l"), (9100, [0.0] * 16, "l"), (9200, [float("nan")] * 16, "l"), (9300, [1.0] * 3, "l"), (9400, [None] * 16, "l"), (None, x[0].tolist(), "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = defaultdict(list)
    for y in ann.op6(df).orderBy("query_id", "rank").collect():
        got[y["query_id"]].append((y["vec_id"], y["score"]))
    hits = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        assert len(got[q]) == 10 and all(abs(d[i] - s) < 1e-12 for i, s in got[q]) and got[q] == sorted(got[q], key=lambda z: (z[1], z[0]))
        hits += len(set(want) & {i for i, _ in got[q]})
        total += 10
        if 500 <= q < 1500:
            assert [i for i, _ in got[q]] == [int(i) for i in want]
    assert hits / total >= 0.95 and set(got) == set(range(0, 3000, 100))


def test_forest_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.op6(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(x) for x in ann.op6(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0])], kind)).collect()] == [(0, 1, 7, 0.0)]


# -- chat --------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    r = random.Random(1)
    bits = [*chat.CONTROL, "\\c0;", "\\", "c1;", "x", "\n", "é", "<", "|", "im_end"]
    for _ in range(500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and not any(s in chat.escape(t) for s in chat.CONTROL[1:])
    turns = [("user", "</s>[INST] ok"), ("assistant", "a<|im_end|>\nb"), ("", ""), ("odd\nrole<|im_start|>", "\\c10;")]
    formatted, mask = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns and [chat.unescape(formatted[a:b]) for a, b in mask] == ["a<|im_end|>\nb"]


def test_conversations_in_order_with_nulls(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 2, None, "x"), (1, 2, None, "x"), (2, None, "assistant", "solo"), (None, 0, "user", "lost")] + [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)]
    out = {r["conv_id"]: r for r in chat.op9(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")).collect()}
    sha = lambda ts: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
    assert out[1]["n_turns"] == 4 and out[1]["turns_sha256"] == sha([("user", "q"), ("assistant", ""), ("", "x"), ("", "x")]) and out[1]["loss_chars"] == 0
    assert out[2]["loss_chars"] == 4 and out[3]["n_turns"] == 300 and out[-1]["n_turns"] == 2 and out[-1]["loss_chars"] == 21


def test_best_branch_of_a_tree(spark):
    # 0 -> 1 -> 3, 0 -> 2 -> (4, 5 -> 6); second tree: 10; mean scores decide
    rows = [(0, None, "c", "user", "r", 1.0), (1, 0, "c", "assistant", "a", 5.0), (3, 1, "c", "user", "a2", 0.0), (2, 0, "c", "assistant", "b", 3.0), (4, 2, "c", "user", "b2", 2.0), (5, 2, "c", "user", "b3", 3.0), (6, 5, "c", "assistant", "b4", 9.0), (10, 99, "d", "user", "z", None)]
    m = spark.createDataFrame(rows, "node long, parent long, conv_id string, role string, text string, score double")
    paths = sorted((r["conv_id"], r["depth"], r["text"]) for r in chat.best_paths(m).collect())
    assert paths == [("c", 1, "r"), ("c", 2, "b"), ("c", 3, "b3"), ("c", 4, "b4"), ("d", 1, "z")]
    with pytest.raises(ValueError, match="cycle"):
        chat.best_paths(spark.createDataFrame([(1, 2, "c", "user", "x", 0.0), (2, 1, "c", "user", "y", 0.0)], m.schema))


# -- WARC --------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", "small"), (4, "u", "small"), (7, "u", "x" * 99), (8, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100), (20, "u", "WARC/1.1\r\n\r\n" * 50), (21, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.op10(pages).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == raw]
        first = len(raw) < 100 or min(same) == i
        assert tuple(got[i]) == (i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first else "revisit", None if first else min(same))
    index = warc.write_archives(pages, f"file://{tmp_path}/w", parts=2)
    some = warc.read_records(index.where("page_id IN (3, 20, 9)"), with_payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in some} == {3: big.encode(), 20: rows[10][2].encode(), 9: b""}
    assert warc.op10(pages.limit(0)).count() == 0
    assert [len(g) for g in warc.ranges([(0, 10), (10, 5), (100_000, 5), (100_010, 20)], gap=64, span=24)] == [2, 1, 1]


def test_registered_queries_and_stages():
    import __spark_entry__ as e
    import corpus_pipeline

    names = set(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "packing"]


def test_pipeline_matches_plain_steps(spark, tmp_path):
    """Every stage against its own brute-force version on one small folder of tables."""
    import corpus_pipeline

    good = [(i, " ".join(words(60 + i, i)).capitalize() + ".") for i in range(30)]
    bad = [(100 + i, " ".join(f"{w}###" for w in words(50, 500 + i))) for i in range(30)]
    near = [(200, good[3][1] + " extra"), (201, good[4][1])]
    item = " ".join(words(20, 900))
    dirty = [(210, item + " " + " ".join(words(30, 901)))]
    private = [(220, "Mail me at a@b.example now. " + " ".join(words(60, 902)) + ".")]
    rows = [*good, *bad, *near, *dirty, *private]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], plain).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    scores = {r["doc_id"]: r["predicted"] for r in quality.op3(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [(i, t) for i, t in rows if scores[i]]
    comp = brute_components(left)
    left = [(i, t) for i, t in left if comp[i][1] == i]
    left = [(i, t) for i, t in left if not brute_hits(t, [(1, item)])[4]]
    enc = packing.encoder(packing.default_vocabulary())
    want = {i: len(enc.ids(t.replace("a@b.example", "[EMAIL]"))) + 1 for i, t in left}
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want and 210 not in want and 201 not in want and 220 in want and all(i in want for i, _ in good)


def test_nulls_in_ids(spark):
    some = docs(spark, [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g")])
    assert neardup.op4(some).count() == 3 and repeats.op7(some).count() == 3 and packing.op5(some).count() == 3 and pii.op2(some).count() == 3
    assert F.lit(1) is not None
