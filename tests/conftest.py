import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def data_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_rows(spark, data_dir):
    """Checks that a query and its SQL give the same rows."""
    import duckdb

    def shown(x):
        if x is None or x != x:
            return "null"
        return f"{x:.5f}" if isinstance(x, float) else str(x)

    def check(query, sql):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        expected = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
        found = [r.asDict() for r in query(spark, data_dir).collect()]
        columns = sorted(names)
        if found:
            assert sorted(found[0]) == columns
        rows = lambda data: sorted(tuple(shown(r[c]) for c in columns) for r in data)
        assert rows(found) == rows(expected)

    return check
