"""Case generation fills every slot, or says that it cannot."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import specgen
from lodestar.plans import QUERIES
from lodestar.sources import directory as src

from .test_queries import SF


def test_slots_are_tried_again(spark):
    res = src.resources(spark, SF).where(F.size("schedule_windows") > 0).cache()
    with pytest.raises(RuntimeError, match="No resources"):
        specgen.build_specs(res.limit(0), 4, 7)
    # rounds that begin with a single try: slots that miss it are drawn again
    assert {r["slot"] for r in specgen.build_specs(res, 12, 7, tries=1).select("slot").collect()} == set(range(12))


def test_sixty_four_cases(spark):
    assert QUERIES["generate_specs"](spark, SF).select("user_spec_id").distinct().count() == 64
