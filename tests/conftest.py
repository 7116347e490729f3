import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def same_rows(spark_df, sql, sf_dir=SMALL):
    """The rows of a Spark query against those of its SQL in DuckDB, columns by name, rows in any order."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    want = con.sql(sql).df().convert_dtypes()
    got = spark_df.toPandas().convert_dtypes()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def text(v):
        if v is None or v != v or str(v) == "<NA>":
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = lambda df: sorted(map(tuple, df[columns].map(text).to_numpy().tolist()))
    assert rows(got) == rows(want)
