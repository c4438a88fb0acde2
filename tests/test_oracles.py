"""Every core query with a SQL twin gives the twin's rows on the smallest tables."""

import numpy as np
import pytest

from conftest import SF
from inkledger.plans import registry


def rows(frame):
    columns = sorted(frame.columns)
    said = frame[columns].astype(object).where(frame[columns].notna(), None)
    plain = lambda v: repr(float(v) + 0.0) if isinstance(v, (float, np.floating)) else str(v)
    return columns, sorted(tuple(plain(v) for v in r) for r in said.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
