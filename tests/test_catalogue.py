import pytest

from glimmer.plans import catalogue, neurons, updates
from tests.sql import DATA, differences, views


ALL = catalogue.QUERIES | neurons.QUERIES | updates.QUERIES


@pytest.fixture(scope="module")
def con():
    return views(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", catalogue.SQL | updates.SQL)
def test_query_agrees_with_sql(spark, con, name):
    _, only, types = differences(con, ALL[name](spark, f"{DATA}/sf0.001"), (catalogue.SQL | updates.SQL)[name])
    assert not only
    assert types


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["label", "pix", "rank", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ring_offsets():
    from glimmer.operators.neighbours import ring

    assert len(ring(1, 2)) == 8
    assert all(9 <= a * a + b * b < 16 for a, b in ring(3, 4))
    assert len(ring(3, 4, 7)) == 7


def test_seeds_plan_has_no_distance_join(spark):
    plan = catalogue.QUERIES["corr_image"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def test_all_queries_are_registered():
    import __spark_entry__
    from glimmer.plans import kernels

    assert set(ALL) | set(kernels.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.SQL | updates.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
