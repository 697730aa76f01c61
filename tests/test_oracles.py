"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry  # noqa: E402
from qaloom.catalog import ORACLES, QUERIES  # noqa: E402
from tools.check_oracles import difference, views  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return views(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    ours = QUERIES[name](spark, SF).toArrow()
    theirs = db.execute(ORACLES[name]).to_arrow_table()
    assert difference(ours, theirs) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r["n"] for r in rows) > 0
    assert sum(r["pct"] for r in rows) == pytest.approx(100, abs=0.05)
