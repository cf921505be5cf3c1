import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from crashlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="module")
def reports(spark):
    """Cached for one module: a cached table takes the place of the scan in the plans of other modules."""
    from crashlens.sources.fixture import crash_table
    cached = crash_table(spark, SF_SMALL).cache()
    yield cached
    cached.unpersist()
