"""Every registered query outside the optional subpackage, against its SQL."""

import pytest
from compare import assert_same

from foliograph import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
