import pathlib

import pytest

import verify_oracle
from rackpulse.plans import checks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    return verify_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query_equals_sql(spark, duck, name):
    # The smallest tables hold too few messages for a consumer to fall behind.
    expected = "both empty" if name == "log_fell_behind" else ""
    assert verify_oracle.check(spark, duck, SF, name) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
