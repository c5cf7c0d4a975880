import os
import sys
import tempfile
from datetime import timedelta

import pytest
from helpers import BASE

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

from paysleuth.schemas import TRANSACTION_TABLE  # noqa: E402
from paysleuth.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "paysleuth-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="paysleuth-test-"),
            "spark.sql.streaming.stateStore.maintenanceInterval": "600s",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a transaction table from short dicts: minute offsets, amounts and so on."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            full.append(
                (
                    r.get("id", f"t{i:04d}"),
                    r.get("user", "u1"),
                    r.get("merchant", "m1"),
                    r.get("category", "retail"),
                    float(r.get("amount", 100.0)),
                    r.get("country", "AR"),
                    r.get("at", BASE + timedelta(minutes=r.get("minute", 0))),
                    r.get("device", "mobile"),
                    "hash",
                    r.get("fraud", False),
                )
            )
        return spark.createDataFrame(full, TRANSACTION_TABLE)

    return build
