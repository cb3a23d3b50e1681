from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every odd case, copies included, over several partitions."""
    return spark.createDataFrame(plain.rows(plain.corpus()), plain.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
