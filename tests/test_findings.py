"""Suppliers that share a code (from the thousandth on), so that code and day are no key of the bars, and other findings."""

import re
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import acceptance
from barloom.plans.all_plans import ORACLES, QUERIES
from barloom.plans.reads import cents
from tests.test_catalog import TABLES, rows


@pytest.fixture(scope="module")
def shared_codes(small, tmp_path_factory):
    """The small tables with suppliers 1230 to 1239: 1230 and 1236, 1231 and 1237 and so on have one code."""
    path = str(tmp_path_factory.mktemp("shared-codes"))
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{small}/{t}.parquet", path)
    duckdb.execute(f"COPY (SELECT * REPLACE (l_suppkey + 1230 AS l_suppkey) FROM '{small}/lineitem.parquet') TO '{path}/lineitem.parquet'")
    return path


def wanted(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def same(spark, sf_dir, name, keep=lambda row: True):
    got, (names, want) = QUERIES[name](spark, sf_dir), wanted(sf_dir, ORACLES[name])
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, filter(keep, got.collect())) == rows(names, filter(keep, want))


def scans(df, column):
    return len(re.findall(rf"Relation \[[^\]]*{column}#", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("name", ["DQ-15", "DQ-15-range"])
def test_fourteen_checks_read_bars_once(spark, shared_codes, name):
    assert scans(QUERIES[name](spark, shared_codes), "l_suppkey") == 1
    # The order of rows of one code and day is open in the SQL of these two.
    same(spark, shared_codes, name, lambda row: row[0] not in ("pct_chg_extreme", "adj_factor_jump"))


def test_alerts_of_rows_without_key(spark):
    raw = spark.createDataFrame([(None, "2020-01-06", 1.0), ("a", None, 1.0), ("a", "2020-01-06", 1.0), ("a", "2020-01-06", 1.2), ("a", "2020-01-13", 1.2), ("b", "2020-01-06", 1.0)], "ts_code string, trade_date string, adj_factor double")
    raw = raw.withColumns({"trade_date": F.col("trade_date").cast("date"), "volume": F.lit(1), "amount": F.lit(2.0), "pct_chg": F.lit(None).cast("double"), "is_suspend": F.lit(False)} | {c: F.lit(2.0) for c in ("open", "high", "low", "close")})
    adjusted = raw.where("ts_code is null or ts_code = 'a'").withColumn("close", F.col("close") * F.col("adj_factor"))
    gone = spark.createDataFrame([("a", "2020-01-10")], "ts_code string, delist_date string").withColumn("delist_date", F.col("delist_date").cast("date"))
    none = spark.createDataFrame([], "ts_code string, in_date date, out_date date")
    found = acceptance.data_quality(acceptance.sides(raw, adjusted, gone), none, spark.createDataFrame([], "t date, n long"))
    got = sorted((r.alert_type, str(r.ts_code), str(r.trade_date), r.n) for r in found.collect())
    assert got == sorted([
        ("duplicate_rows", "a", "2020-01-06", 1), ("adj_factor_jump", "a", "2020-01-06", 1), ("delisted_with_future_data", "a", "2020-01-13", 1),
        ("adj_raw_ratio_invalid", "a", "2020-01-06", 2), ("qfq_close_mismatch", "a", "2020-01-06", 2), ("raw_adj_row_count_mismatch", "b", "None", 1), ("raw_adj_row_count_mismatch", "None", "None", 2),
        ("raw_adj_pk_missing", "b", "2020-01-06", 1), ("raw_adj_pk_missing", "None", "2020-01-06", 2), ("raw_adj_pk_missing", "a", "None", 2),
    ])


def test_lots_are_made_before_the_join(spark, shared_codes):
    plan = QUERIES["R-03"](spark, shared_codes)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join FullOuter", 1)
    assert "RLIKE" not in above and "RLIKE" in below and "windowspecdefinition(trade_date" not in below
    same(spark, shared_codes, "R-03")


def test_prices_are_rounded_as_in_c(spark, shared_codes, tmp_path):
    prices = [24.615, 0.125, 0.375, 2.675, 1.005, 1234567.895, 0.005, 9.995]
    got = spark.createDataFrame([(p,) for p in prices], "p double").select(cents(F.col("p"))).collect()
    assert [r[0] for r in got] == [f"{p:.2f}" for p in prices]
    duckdb.execute(f"COPY (SELECT * REPLACE (8.0::DOUBLE AS l_quantity, CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 196.92 END::DOUBLE AS l_extendedprice) FROM '{shared_codes}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{shared_codes}/{t}.parquet", tmp_path)
    same(spark, str(tmp_path), "A-16")


@pytest.mark.parametrize("name", ["DQ-01", "DQ-07", "DQ-12", "DQ-13"])
def test_suppliers_of_one_code_are_told_apart(spark, shared_codes, name):
    same(spark, shared_codes, name)


@pytest.mark.parametrize("name", ["A-10", "DQ-03", "DQ-15", "DQ-17", "DQ-20", "DQ-21", "DQ-22", "DQ-23"])
def test_rows_of_one_code_and_day_have_an_order(spark, shared_codes, tmp_path, name):
    """The SQL leaves their order open; whatever it is, it doesn't depend on the order of the input."""
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{shared_codes}/{t}.parquet", tmp_path)
    duckdb.execute(f"COPY (SELECT * FROM '{shared_codes}/lineitem.parquet' ORDER BY l_suppkey DESC, l_orderkey DESC, l_linenumber) TO '{tmp_path}/lineitem.parquet'")
    one, other = (QUERIES[name](spark, p) for p in (shared_codes, str(tmp_path)))
    assert rows(one.columns, one.collect()) == rows(other.columns, other.collect())
