"""Each registered query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(float(v), 7) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["html_sections", "html_chunks", "html_main_stats", "source_dispatch"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", ["bm25_scores", "overlap_scores", "broad_topn"])
def test_rows_that_share_an_id(spark, tmp_path, name):
    """Repeated and missing ids, against SQL; pairs aren't shuffled before a task has kept its best."""
    docs = [(i, " ".join(f"w{'abcdefghijk'[(i * k) % 11]}" for k in range(1, i % 7 + 4))) for i in range(60)]
    docs += [(3, "wa wb wb"), (3, "wa wc wa"), (4, "wd"), (None, "wa wb"), (None, "wa wb"), (None, "wc")]
    items = [(1, "wa wb"), (2, "wc wc wd"), (2, "we wc"), (2, "wa wb wc"), (3, "none"), (4, "wk wa wb wa")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = c.sql(entry.oracle_sql()[name])
    at = [df.columns.index(x) for x in want.columns]
    assert sorted((tuple(plain(r[i]) for i in at) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan.split("MapInArrow")[0]
