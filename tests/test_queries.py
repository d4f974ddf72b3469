import math
from pathlib import Path

import duckdb
import pytest

from ferrule.plans.registry import QUERIES, SQL
from ferrule.sources import layers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(norm(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_in_both_engines(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.columns
        return
    expected = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    mine = plain([tuple(r[c] for c in columns) for r in got.collect()])
    assert mine == plain(expected.select(*columns).fetchall())


def test_search_answers_every_due_query(spark):
    due = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    got = QUERIES["top_k_all_due"](spark, SF).collect()
    assert {r["query_id"] for r in got} == due and len(got) == 10 * len(due)


def test_every_store_gets_its_tombstones(spark):
    got = layers.invalidate(spark.range(2).toDF("doc_id"), spark.range(1500).toDF("model"))
    assert got.distinct().count() == 3000
