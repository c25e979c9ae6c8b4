"""Every query of the core against its SQL, over whole tables at the smallest scale."""

import math
import os

import pytest

from rohspark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(spark, duck, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if sql is None:
        return len(got) > 0 and len(set(names)) == len(names)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    order = [rel.columns.index(c) for c in names]
    return got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    assert same(spark, duck, registry.queries()[name], registry.oracle_sql().get(name))


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


def test_llm_is_optional():
    """Nothing of the library but the entry point names the optional subpackage."""
    import pathlib

    import rohspark

    root = pathlib.Path(rohspark.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "rohspark.llm" not in p.read_text()
