"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tarnwick import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_null_safe_join_counts_suppliers_before_they_meet_customers(spark, tmp_path):
    spark.createDataFrame([(i % 50, None if i % 4 == 0 else 3 if i % 4 == 1 else i % 7) for i in range(100)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(None if i % 5 == 0 else i % 6,) for i in range(300)], "s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalog.QUERIES["q_join_null_safe"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(catalog.ORACLE_SQL["q_join_null_safe"]).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
