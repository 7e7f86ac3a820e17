"""Every registered query against its SQL counterpart."""

import pytest

from oracle import compare, connect
from workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(frame, duck, ORACLES[name]) is None
    else:
        assert frame.count() > 0
