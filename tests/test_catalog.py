"""Every query of the catalog against its SQL, on the smallest tables."""

import math

import pytest

from lorekeep.plans.catalog import QUERIES_BY_NAME
from lorekeep.plans.oracles import ORACLES
from lorekeep.plans.store_catalog import STORE_ORACLES, STORE_QUERIES

ALL, SQL = QUERIES_BY_NAME | STORE_QUERIES, ORACLES | STORE_ORACLES


def rows(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.8f}" if isinstance(x, (int, float)) or hasattr(x, "item") and not isinstance(x, (bool, str)) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = ALL[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).fetchdf())
    else:
        assert len(got) > 0
