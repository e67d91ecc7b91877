import glob
import math
import os

import duckdb
import pytest

from wardline.llm.entry import QUERIES, SQL

FOLDER = os.environ.get("LLM_SQL_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    said = lambda v: f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(map(said, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    out = db.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(out.fetchall())
