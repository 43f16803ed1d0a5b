import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import compare

import __spark_entry__
from noticeflow.plans import queries, stored

pytestmark = pytest.mark.skipif(not compare.present, reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection(compare.SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    compare.same_rows(queries.QUERIES[name](spark, compare.SMALL), con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(stored.SQL))
def test_stored_query_equals_its_sql(spark, con, name):
    compare.same_rows(stored.QUERIES[name](spark, compare.SMALL), con, stored.SQL[name])


def test_stream_holds_each_url_once(spark):
    rows = stored.stream_master(spark, compare.SMALL).collect()
    urls = {r["url"] for r in stored.views.notices(spark, compare.SMALL).select("url").distinct().collect()}
    assert len(rows) == len(urls) and {r["url"] for r in rows} == urls


def test_entry_and_registry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["date", "notices", "total_eccns", "flagged"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("missing", ["noticeflow.llm", "xxhash"])
def test_entry_where_the_corpus_part_cannot_be_imported(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from noticeflow.plans import queries as q, stored as s; "
        "assert set(e.queries()) == {*q.QUERIES, *s.QUERIES} and set(e.oracle_sql()) == {*q.SQL, *s.SQL}"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_plans_push_down_and_stay_native(spark):
    for name in ("diff_added", "codes_per_date", "run_summary"):
        plan = queries.QUERIES[name](spark, compare.SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
    plan = queries.QUERIES["parse_dates"](spark, compare.SMALL)._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[-1]


def test_what_is_read_twice_holds_no_parser(spark, monkeypatch):
    seen = []

    def watched(owner, name):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda df, *a, **k: (seen.append(df._jdf.queryExecution().toString()), real(df, *a, **k))[1])

    watched(stored.snapshots, "write_sorted")
    watched(stored.text, "assemble")
    stored.multi_source_run(spark, compare.SMALL)
    stored.current_run(spark, compare.SMALL)
    assert len(seen) == 2 and not any("MapIn" in plan for plan in seen)


@pytest.mark.parametrize("name", ["master_append", "stream_master", "bucketed_master"])
def test_first_rows_do_not_depend_on_the_order_of_input(spark, tmp_path, name):
    """Orders in pairs that differ in their source alone, by what the SQL ranks them by."""
    day = dt.datetime(1998, 3, 4)
    keys = [k for k in range(1, 60) if k % 17 and (k + 1000) % 17]
    pairs = [(k + at, k, status, 1.0, day, "1-URGENT") for k in keys for at, status in ((0, "P"), (1000, "F"))]
    for turn, rows in enumerate((pairs, pairs[::-1])):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/{turn}/orders.parquet")
        assert [r["source"] for r in stored.QUERIES[name](spark, f"{tmp_path}/{turn}").collect()] == ["src-F"] * len(keys)
