import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    """DuckDB over the smallest tables, compared by rows whatever their order."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def rows_of(columns, rows):
    """Rows as sorted tuples of text, columns by name, floats to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, tables):
    def check(frame, sql):
        got = frame.collect()
        want = tables.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(frame.columns) == sorted(names)
        assert rows_of(frame.columns, got) == rows_of(names, want.fetchall())

    return check
