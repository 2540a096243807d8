"""Every registered query against its SQL on the smallest tables, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidecast.plans import relational
from tidecast.session import scratch, shared_dir
from tidecast.sources.binding import BoundTables
from tools.check_oracles import TABLES, compare


@pytest.fixture(scope="module")
def con(small_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small_dir, con, name):
    with scratch(spark):
        got = entry.queries()[name](spark, small_dir).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small_dir):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_range_reaches_the_scan(spark, small_dir):
    plan = plan_of(BoundTables(spark, small_dir).cells(2411, 2468))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan


def test_panel_needs_two_exchanges(spark, small_dir):
    """One for the map-side combined totals, one to bring each series together."""
    assert plan_of(BoundTables(spark, small_dir).panel()).count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["var_forecast", "ml_poisson_boost", "forecast_hybrid"])
def test_model_queries_run(spark, small_dir, name):
    assert entry.queries()[name](spark, small_dir).limit(5).count() == 5


def test_clustered_range_needs_no_exchange(spark, small_dir):
    """A window by series over a day range reads only its months' folders, and nothing is moved."""
    t = BoundTables(spark, small_dir)
    fact = relational.clustered_cells(t, buckets=4)
    try:
        first, last = t.study.date_of(2411), t.study.date_of(2468)
        plan = plan_of(relational.trailing_sales(fact, first, last))
        assert "Exchange" not in plan and "Bucketed: true" in plan
        read = fact.range(first, last).inputFiles()
        months = {f.split("month_no=")[1].split("/")[0] for f in read}
        assert months == {str(2001 * 12 + m - 1) for m in (8, 9, 10)}
        assert fact.range(first, last).agg({"sales": "sum"}).first()[0] == t.cells(2411, 2468).agg({"sales": "sum"}).first()[0]
    finally:
        fact.drop()
    assert not spark.catalog.tableExists(fact.name)


def test_intermediates_are_removed(spark, small_dir):
    def held():
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {str(f.getPath().getName()) for f in system.listStatus(path)} if system.exists(path) else set()

    before = held()
    with scratch(spark):
        assert entry.queries()["category_codes"](spark, small_dir).count() > 0
        assert held() > before
    assert held() == before
