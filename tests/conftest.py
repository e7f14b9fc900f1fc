from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from riskbook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="riskbook-tests-")
    s = build_session(master="local[*]", app="riskbook-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": f"{scratch}/shared",
                             "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    yield s
    s.stop()
