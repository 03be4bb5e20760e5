"""Queries against their SQL on the smallest tables, value by value; the comparison on larger ones is the driver's."""

import functools
import math
import os
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def core_names() -> list[str]:
    import __spark_entry__ as entry

    return sorted(n for m in entry._modules() if m.__name__.startswith("chalkline.queries.") for n in m.oracle_sql())


@functools.cache
def tables():
    import duckdb

    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "normalize"):
        f = float(v)
        return "nan" if math.isnan(f) else repr(f + 0.0)
    return repr(v)


def check(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = tables().execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", core_names())
def test_query_equals_sql(spark, name):
    check(spark, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
