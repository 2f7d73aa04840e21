import duckdb
import pytest

import __spark_entry__ as entry
import check
from driver.layers import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("overlap_pairs", "match_greedy", "geometry_checks", "interior_checks", "vegetation_candidates",
          "review_state", "normalize_features", "tile_blend", "export_import_roundtrip")


def test_every_query_has_a_callable_and_most_have_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    own = entry.reference_registry()
    assert set(sql) <= set(q) and set(own) <= set(q)
    assert sum(name in sql for name in own) >= len(own) - 2


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(cols, cur.fetchall())
