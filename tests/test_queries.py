"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pandas as pd
import pytest

from loomgraph.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


def expected(sql):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db.execute(sql).df()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, name):
    assert canonical(plans.QUERIES[name](spark, SF).toPandas()) == canonical(expected(plans.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query", "id", "distance", "rank", "degree"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
