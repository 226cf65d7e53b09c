"""Shared fixtures: one local session for the whole run, driver test data."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from telemetry_lake.session import build_session  # noqa: E402

TESTDATA = "/root/testdata"
SF0001 = f"{TESTDATA}/sf0.001"
SF001 = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[*]", 8, app_name="telemetry_lake_tests")
    session.sparkContext.setLogLevel("ERROR")
    # Tests are the one place that may choose a checkpoint folder, and only
    # when the launcher has not named one.
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()


@pytest.fixture()
def scratch(spark):
    from telemetry_lake.session import scratch_path, strip_scheme
    return lambda name="t": strip_scheme(scratch_path(spark, name))


def rows(df, *cols):
    """Collect ``cols`` (default: all) as a sorted list of tuples."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
