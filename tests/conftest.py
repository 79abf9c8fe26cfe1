from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from rowgate.functions.json_text import with_parsed  # noqa: E402
from rowgate.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def json_rows(spark):
    """Rows (seq, raw, v) from JSON texts, in order."""

    def make(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, raw string")
        return with_parsed(df, "raw", "v")

    return make
