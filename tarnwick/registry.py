"""The registry that the query modules fill."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a Spark SQL text over the tables that it names in braces; the oracle is the same text unless given."""
    import re

    from tarnwick.sources.tables import table

    names = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))

    def run(spark, sf_dir):
        return spark.sql(spark_sql, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", spark_sql)
