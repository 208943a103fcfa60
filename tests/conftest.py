import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vigilrow.session import local_session

    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SMALL).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def files(spark, *rows):
    """(path, code) pairs as a files relation."""
    from pyspark.sql import functions as F

    from vigilrow.operators.features import suffix_of

    data = [(i, path, code) for i, (path, code) in enumerate(rows)]
    df = spark.createDataFrame(data, "file_id long, path string, code string")
    return df.withColumns({"ext": suffix_of(F.col("path")), "size": F.octet_length("code").cast("long")})
