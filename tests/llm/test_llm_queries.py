"""The registered queries of the llm folder against their oracles at the smallest scale."""

import os

import pytest

from commentlens.llm.queries import ORACLES, QUERIES
from tests.test_oracle import FOLDER, canonical, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    result = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in result.collect()]
    assert rows
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert canonical(result.columns, rows) == canonical([d[0] for d in cursor.description], cursor.fetchall())
