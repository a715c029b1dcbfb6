from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from reviewops.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="reviewops-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples (tests only; tiny frames)."""
    out = df.select(*cols) if cols else df
    return [tuple(r) for r in out.collect()]
