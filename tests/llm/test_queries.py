import os

import pytest

from storyweft.llm import entries

from .. import oracle

SQL = entries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": ["group_id", "item_id"], "p2_found": ["entry_id"], "p3_found": ["model_id", "item_id_a", "item_id_b"], "p4_found": ["field", "record_id"],
    "p5_found": ["item_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "golden_id"], "p8_found": ["doc_id", "span_start", "span_end"],
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    oracle.check(spark, con, entries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = entries.queries()[name](spark, oracle.FOLDER)
    assert df.columns == COLUMNS[name] and df.count() > 0
