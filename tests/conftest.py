from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quiverlake.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    extra = {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    s = local_session(8, "4g", 4, **extra)
    yield s
    s.stop()


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
