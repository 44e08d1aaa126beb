"""Cases of a large directory are drawn in one round, places are looked up once, and most needs are settled in a part of the resources."""

import pytest

from lodestar.operators import search, specgen
from lodestar.sources import directory as src
from lodestar.sources.storage import kept

from .test_large_directories import _alike
from .test_queries import SF


@pytest.mark.parametrize("made", [specgen.specs_in_order, specgen.build_specs])
def test_one_round(spark, monkeypatch, made):
    res = kept(src.resources(spark, SF), "resources")
    plain = sorted(map(str, made(res, 6, 1, draw=specgen.arithmetic, partial=True).collect()))
    looked, at_places = [], specgen.Directory.at_places
    monkeypatch.setattr(specgen.Directory, "at_places", lambda self, asked: looked.append(1) or at_places(self, asked))
    monkeypatch.setattr(specgen, "ROWS_FOR_AN_ATTEMPT", 1)
    assert sorted(map(str, made(res, 6, 1, draw=specgen.arithmetic, partial=True).collect())) == plain
    assert plain and len(looked) == 1


def test_no_cases_at_all(spark):
    res = _alike(spark, 20)
    assert specgen.build_specs(res, 0, 1).count() == specgen.specs_in_order(res, 0, 1).count() == 0


def test_parts_of_parts(spark, monkeypatch):
    from .test_large_directories import test_many_known_rows_among_repeated_categories as same

    monkeypatch.setattr(search, "LARGE_PART", 1)
    monkeypatch.setattr(search, "PART", 3)
    read, ahead = [], search._ahead
    monkeypatch.setattr(search, "_ahead", lambda asked, resources, kinds: read.append(asked.count()) or ahead(asked, resources, kinds))
    same(spark, 10)
    assert len(read) == 4 and read == sorted(read, reverse=True) and read[-1] < 150
