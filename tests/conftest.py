from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark import cloudpickle  # noqa: E402

import qaloom  # noqa: E402
from qaloom.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(qaloom)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def qa(spark):
    """Records of five categories, one of them holding most rows."""
    rows = []
    for i in range(120):
        category = "a" if i % 2 else ("b", "c", "d")[i // 2 % 3]
        rows.append((i, f"question {i}", "x" * (i * 3), category))
    rows.append((120, "the only one", "y" * 150, "single"))
    return spark.createDataFrame(rows, "row_id long, input string, output string, category string")
