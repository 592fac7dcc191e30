import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        mine = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        found = duck.sql(sql)
        places = [found.columns.index(c) for c in sorted(found.columns)]
        assert sorted(found.columns) == sorted(df.columns)
        assert mine == sorted(str(tuple(r[k] for k in places)) for r in found.fetchall())

    return check
