"""Every kind of base entity induces patterns, and tokens of any shape are found after them."""

import pytest

from lodestar.llm import pii

from .test_operators import docs, luhn


@pytest.mark.parametrize(
    ("seed", "unseen"),
    [("write to ann.{i:c}@mail.example.com", "b@localhost"), ("call us at +1 (017) 555-77{i:02d}", "x555"), ("seen from 10.0.0.{i}", "10.0.0.999"), ("room 7 to 10.0.0.{i}", "h4")],
)
def test_each_kind_induces_patterns(spark, seed, unseen):
    rows = [(i, "please " + seed.format(i=i) + " today") for i in range(97, 117)]
    head = rows[0][1][: len("please ") + seed.index("{")].rsplit(" ", 1)[0] if "+1" not in seed else "please call us at"
    rows += [(200, f"{head} {unseen}, today"), (201, f"nothing like {unseen}, today")]
    got = {x["doc_id"]: x["spans"] for x in pii.op2(docs(spark, rows)).collect()}
    assert got[200] == f"context:{len(head) + 1}:{len(head) + 1 + len(unseen)}" and got[201] == ""
    red = {x["doc_id"]: x["text"] for x in pii.redact(docs(spark, rows)).collect()}
    assert red[200] == f"{head} [CONTEXT], today" and red[201] == rows[-1][1]


def test_patterns_rise_through_found_identifiers(spark):
    """No base entity ever follows ``passport no``: it is learnt from identifiers of known shape and right context."""
    card = lambda n: next(f"{p}{c}" for p in [f"4{n:014d}"] for c in range(10) if luhn(f"{p}{c}"))
    rows = [(i, f"my card is {card(i)} issued here") for i in range(30)]
    rows += [(100 + i, f"passport no K71000000L{80000000 + 7 * i}X issued here") for i in range(12)]
    rows += [(200 + i, f"passport no K81000000L{80000000 + 7 * i}X and that is all {i}") for i in range(12)]
    rows += [(300 + i, f"build {9100000000 + i} done, version {i}.0 is out") for i in range(12)]
    got = {x["doc_id"]: x["spans"] for x in pii.op2(docs(spark, rows)).collect()}
    assert all(got[i] == "context:12:31" for i in [*range(100, 112), *range(200, 212)])
    assert all(got[300 + i] == "" for i in range(12))


def test_repeated_rows_count_once(spark):
    rows = [(1, "call me at 10.0.0.1 now")] * 20 + [(2, "call me at h4 now")]
    assert all("context" not in x["spans"] for x in pii.op2(docs(spark, rows)).collect())
