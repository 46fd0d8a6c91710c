import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con


@pytest.fixture(scope="session")
def agrees(spark, data, duck):
    """Whether a query's rows are those of its SQL."""

    def near(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        ours = sorted((tuple(near(r[c]) for c in names) for r in df.collect()), key=str)
        rel = duck.sql(sql)
        columns = list(rel.columns)
        assert sorted(columns) == names
        theirs = sorted((tuple(near(r[columns.index(c)]) for c in names) for r in rel.fetchall()), key=str)
        assert ours == theirs

    return check
