import os

import pytest

from storyweft.plans import catalog

from . import oracle

SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    oracle.check(spark, con, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_without_sql(spark, name):
    df = catalog.queries()[name](spark, oracle.FOLDER)
    assert df.columns and df.count() >= 0


def test_a_join_covers_every_model(spark):
    rows = {n: {tuple(r) for r in catalog.queries()[n](spark, oracle.FOLDER).select("model_id", "a", "b").collect()} for n in ("j01_cosine_join_all", "j01_cosine_pairs")}
    assert rows["j01_cosine_join_all"] == rows["j01_cosine_pairs"] and len({m for m, _, _ in rows["j01_cosine_join_all"]}) == 2


@pytest.mark.parametrize("name", ["j01_cosine_join", "j01_cosine_join_all"])
def test_a_join_multiplies_blocks(spark, name):
    plan = catalog.queries()[name](spark, oracle.FOLDER)._jdf.queryExecution().executedPlan().toString()
    # pairs of blocks, not of vectors
    assert "MapInArrow" in plan and "CartesianProduct" in plan and "Exchange" not in plan
