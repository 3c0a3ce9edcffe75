import os

import pytest

from cytoweave.llm import queries as llm
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(llm.queries()[name](spark, SF).toPandas(), connect(SF).sql(llm.oracle_sql()[name]).df())


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in llm.queries()) == list(range(1, 14))
