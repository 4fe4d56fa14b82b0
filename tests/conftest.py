from __future__ import annotations

import math
import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": folder, "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    yield s
    s.stop()


def plain(v):
    """Values in the form in which two engines agree."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a registered query with its SQL over the smallest tables."""

    def check(query, sql: str) -> int:
        df = query(spark, SF)
        names = sorted(df.columns)
        cur = duck.execute(sql)
        own = [d[0] for d in cur.description]
        assert sorted(own) == names
        want = sorted(repr(tuple(plain(dict(zip(own, r, strict=True))[n]) for n in names)) for r in cur.fetchall())
        got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
        assert got == want
        return len(got)

    return check
