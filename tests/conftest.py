import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["TALLYSPARK_TEST_DIR"] = "file://" + str(tmp_path_factory.mktemp("shared"))
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.10g}"
    return [cell(x) for x in v] if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted(str([cell(r[c]) for c in cols]) for r in df.collect())
        out = duck.execute(sql)
        names = [d[0] for d in out.description]
        assert sorted(names) == cols
        want = sorted(str([cell(r[names.index(c)]) for c in cols]) for r in out.fetchall())
        assert got == want

    return check
