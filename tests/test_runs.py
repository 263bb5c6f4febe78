"""What the whole runs are given."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from posttide.checks import runs

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_landed_copies_pass_the_search(spark):
    landed = runs._landed(spark, SF_DIR).filter(F.lower("content").contains("that"))
    day = F.to_date("created_at")
    found = landed.filter(day.between("2026-05-03", "2026-05-06")).groupBy("tweet_id").count()
    assert found.filter("count = 2").count() > 0 and found.filter("count = 1").count() > 0
