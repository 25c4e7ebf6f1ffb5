"""Every registered query of the time-series engine: the same rows as its SQL in DuckDB, or at least some rows."""

import duckdb
import pytest

from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, tmp_path, name):
    out = str(tmp_path / "out")
    plans.QUERIES[name](spark, sf_dir).write.parquet(out)
    con.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    if name not in plans.ORACLE_SQL:
        assert con.execute("SELECT count(*) FROM got").fetchall()[0][0] > 0
        return
    con.execute(f"CREATE OR REPLACE TABLE want AS {plans.ORACLE_SQL[name]}")
    columns = sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in con.execute("DESCRIBE got").fetchall())
    shown = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT {shown} FROM {a} EXCEPT ALL SELECT {shown} FROM {b} LIMIT 3").fetchall() == []
