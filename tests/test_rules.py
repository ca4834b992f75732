"""Golden values of trading rules, field normalisation, ledgers, lifetimes and comparisons."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.functions import codes, rules
from barloom.operators import acceptance, ledger, lifetimes, merge, storage
from barloom.sources import fields


def day(s):
    return F.lit(s).cast("date")


@pytest.mark.parametrize("code,on,listed,want", [("600000.SH", "1991-01-02", None, 0.1), ("600000.SH", "1993-01-04", None, None), ("300750.SZ", "2020-08-23", None, 0.1), ("300750.SZ", "2020-08-24", None, 0.2), ("688001.SH", "2019-07-24", "2019-07-22", None), ("688001.SH", "2019-07-29", "2019-07-22", 0.2), ("830001.BJ", "2021-11-15", "2021-11-15", None), ("830001.BJ", "2021-11-16", "2021-11-15", 0.3), ("688001.SH", "2018-01-02", None, 0.1)])
def test_price_limit(spark, code, on, listed, want):
    row = spark.range(1).select(F.lit(code).alias("ts_code"), day(on).alias("trade_date"), day(listed).alias("list_date"))
    assert rules.with_price_limit(row, "list_date" if listed else None).first().price_limit == want


@pytest.mark.parametrize("board,shares,want", [("main", 550, 500), ("STAR", 150, 0), ("STAR", 250, 250), ("BSE", 101, 101), ("main", 99, 0), ("main", 0, 0)])
def test_lots(spark, board, shares, want):
    assert spark.range(1).select(rules.round_shares(F.lit(shares), F.lit(board), day("2024-01-02"))).first()[0] == want


@pytest.mark.parametrize("on,want", [("1991-10-01", 0.006), ("1991-10-02", 0.003), ("1997-05-10", 0.005), ("2007-05-30", 0.003), ("2023-08-27", 0.001), ("2023-08-28", 0.0005), ("1980-01-01", 0.0005)])
def test_stamp_tax(spark, on, want):
    assert spark.range(1).select(rules.stamp_tax(day(on))).first()[0] == want


def test_tradability(spark):
    rows = [("s", True, 10, 10.0, 10.0, 10.0), ("z", False, 0, 10.0, 10.0, 10.0), ("n", False, None, 10.0, 10.0, 10.0), ("b", False, 10, None, 10.0, 10.0), ("u", False, 10, 10.0, 11.0, 11.0), ("t", False, 10, 10.0, 11.0, 10.0), ("d", False, 10, 10.0, 9.0, 9.0), ("o", False, 10, 10.0, 10.0, 9.0)]
    got = spark.createDataFrame(rows, "k string, is_suspend boolean, volume long, pre_close double, high double, low double").select("k", rules.tradability(F.lit(0.1)).alias("x"))
    assert {r.k: tuple(r.x) for r in got.collect()} == {"s": (False, False, "suspended"), "z": (False, False, "suspended"), "n": (False, False, "suspended"), "b": (False, False, "bad_pre_close"), "u": (False, True, "limit_up"), "t": (True, True, "normal"), "d": (True, False, "limit_down"), "o": (True, True, "normal")}


@pytest.mark.parametrize("name,want", [("被吸收合并", "merger"), ("收购退", "acquisition"), ("破产清算", "bankruptcy"), ("主动退市", "voluntary"), ("终止上市", "mandatory"), ("G重机", "code_change"), ("重机", "unknown"), ("", "unknown")])
def test_delist_reason(spark, name, want):
    assert spark.range(1).select(codes.delist_reason(F.lit(name))).first()[0] == want


def test_standardize(spark):
    raw = spark.createDataFrame([("600000.SH", "2024-01-02", "1.5", "x", True), ("600001.SH", "nope", "bad", "7", None)], "ts_code string, date string, close string, vol string, is_trading boolean")
    got = {r.ts_code: r for r in fields.standardize(raw).collect()}
    assert got["600000.SH"].trade_date == date(2024, 1, 2) and got["600000.SH"].close == 1.5 and got["600000.SH"].volume == 0 and got["600000.SH"].is_suspend is False
    assert got["600001.SH"].trade_date is None and got["600001.SH"].close is None and got["600001.SH"].volume == 7 and got["600001.SH"].open is None
    with pytest.raises(ValueError):
        fields.normalize(raw.withColumn("odd", F.lit(1)), strict=True)
    both = raw.select(F.lit(1).alias("vol"), F.lit(2).alias("volume"))
    assert fields.normalize(both).columns == ["volume"] and fields.normalize(both).first().volume == 2


def test_ledger(spark):
    trades = spark.createDataFrame([("a", "x", date(2024, 1, 2), "buy", 300), ("a", "x", date(2024, 1, 3), "sell", 100), ("a", "x", date(2024, 1, 3), "buy", 50)], "account string, ts_code string, trade_date date, side string, shares long")
    got = {r.trade_date.day: (r.shares, r.available) for r in ledger.positions(trades).collect()}
    assert got == {2: (300, 0), 3: (250, 200)}


def test_fills(spark):
    orders = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "order_id int, wanted long")
    trades = spark.createDataFrame([(1, 60), (1, 40), (2, 10)], "order_id int, shares long")
    assert {r.order_id: (r.filled, r.status) for r in ledger.fills(orders, trades).collect()} == {1: (100, "FILLED"), 2: (10, "PARTIAL"), 3: (0, "PENDING")}


def test_flag_intervals(spark):
    log = spark.createDataFrame([("a", date(2024, 1, d), f) for d, f in ((1, False), (2, True), (3, True), (5, False), (6, True), (7, None))], "ts_code string, eff_date date, st boolean")
    got = [(r.start_date.day, r.end_date and r.end_date.day) for r in lifetimes.flag_intervals(log, "st").orderBy("start_date").collect()]
    assert got == [(2, 4), (6, 6)]


def test_corrections_keep_history(spark):
    log = spark.createDataFrame([("a", 1, "superseded", None), ("a", 2, "active", None), ("b", 1, "active", None)], "k string, version int, status string, correction_note string")
    fix = spark.createDataFrame([("a", "typo"), ("c", "new")], "k string, correction_note string")
    got = {(r.k, r.version): (r.status, r.correction_note) for r in lifetimes.correct(log, fix, ["k"]).collect()}
    assert got == {("a", 1): ("superseded", None), ("a", 2): ("corrected", "typo"), ("a", 3): ("active", "typo"), ("b", 1): ("active", None), ("c", 1): ("active", "new")}


def test_incremental_write_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, year int, x double").write.partitionBy("year").parquet(path)
    new = spark.createDataFrame([("a", 1, 9.0), ("c", 3, 3.0)], "k string, year int, x double")
    for _ in range(2):
        storage.write_incremental(spark, new, path, "year", ["k", "year"])
    assert sorted((r.k, r.year, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1, 9.0), ("b", 2, 2.0), ("c", 3, 3.0)]
    touched = storage.touched_partitions(spark.read.parquet(path), new, "year")
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in plan and sorted(r.year for r in touched.collect()) == [1, 3]
    assert sorted(r.year for r in storage.touched_partitions(spark.read.parquet(path), new, "year", most=1).collect()) == [1, 3], "too many values: by a join"
    assert [p.name for p in tmp_path.iterdir()] == ["t"], "nothing staged is left"


def test_export_whitelist(spark, tmp_path):
    with pytest.raises(ValueError):
        storage.export(spark.range(1), "secrets", str(tmp_path))


def test_golden_comparison(spark):
    schema = "ts_code string, trade_date date, open double, high double, low double, close double, adj_factor double"
    row = lambda k, x, f: (k, date(2024, 1, 2), 10.0, 10.0, 10.0, x, f)
    golden = spark.createDataFrame([row("a", 10.0, 1.0), row("b", 10.0, 1.0), row("c", 10.0, 1.0)], schema)
    bars = spark.createDataFrame([row("a", 10.04, 1.005), row("b", 10.06, 1.02)], schema)
    assert {(r.ts_code, r.alert_type) for r in acceptance.compare_golden(golden, bars).collect()} == {("b", "close"), ("b", "adj_factor"), ("c", "missing")}


def test_range_overwrite(spark):
    old = spark.createDataFrame([("a", date(2024, 1, d), 1.0) for d in (1, 2, 3, 4)] + [("b", date(2024, 1, 2), 1.0)], "k string, d date, x double")
    new = spark.createDataFrame([("a", date(2024, 1, d), 2.0) for d in (2, 4)], "k string, d date, x double")
    assert sorted((r.k, r.d.day, r.x) for r in merge.overwrite_range(old, new, "k", "d").collect()) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 2.0), ("b", 2, 1.0)]


@pytest.mark.parametrize("strict,want", [(True, {2: None, 4: 1.0, 6: 1.0, 7: 3.0}), (False, {1: None, 2: 1.0, 4: 1.0, 6: 3.0, 7: 3.0})])
def test_factors_carry_the_last_known_value(spark, strict, want):
    from barloom.operators import pit

    on = lambda n: date(2024, 1, n)
    rows = [("a", on(1), on(1), 1, None), ("a", on(2), on(1), 2, 1.0), ("a", on(5), on(1), 3, None), ("a", on(6), on(1), 4, 2.0), ("a", on(6), on(2), 5, 3.0), ("a", None, on(9), 6, 9.0)]
    f = spark.createDataFrame(rows, "ts_code string, ann_date date, end_date date, report int, roe double")
    dates = spark.createDataFrame([(on(n),) for n in (1, 2, 4, 6, 7)], "t date")
    assert {r.t.day: r.roe for r in pit.factors(f, dates, ["roe"], strict).collect()} == want
