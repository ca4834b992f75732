"""Golden values of codes, costs, calendars, versions and streams."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import codes
from barloom.operators import asof, calendar, factors, lifetimes, merge, pit, portfolio, quality, windows
from barloom.streaming import sync


@pytest.mark.parametrize("code,want", [("600000", "600000.SH"), ("000001", "000001.SZ"), ("688001", "688001.SH"), ("300750", "300750.SZ"), ("430001", "430001.BJ"), ("830001", "830001.BJ"), ("920001", "920001.BJ"), ("1", "000001.SZ"), ("6881", "006881.SZ"), ("8", "000008.BJ"), ("000008", "000008.SZ"), ("4301", "004301.BJ")])
def test_codes(spark, code, want):
    assert spark.range(1).select(codes.ts_code(F.lit(code))).first()[0] == want


def test_limits_and_tax(spark):
    d = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(codes.limit_pct(F.lit("300750.SZ"), d("2020-08-23")), codes.limit_pct(F.lit("300750.SZ"), d("2020-08-24")), codes.limit_pct(F.lit("920001.BJ"), d("2020-08-24")), codes.stamp_tax(d("2023-08-27")), codes.stamp_tax(d("2023-08-28")), codes.limit_hit(F.lit(10.0), F.lit(0.1)), codes.limit_hit(F.lit(9.98), F.lit(0.1))).first()
    assert tuple(row) == (0.1, 0.2, 0.3, 0.001, 0.0005, "up", "none")


def test_costs(spark):
    t = spark.createDataFrame([("buy", 10_000.0), ("sell", 10_000.0), ("buy", 1e6)], "side string, amount double").withColumn("trade_date", F.lit("2020-01-02").cast("date"))
    got = [tuple(map(float, (r.commission, r.tax, r.slippage, r.net_amount))) for r in portfolio.costs(t).collect()]
    assert got == [(5.0, 0.0, 10.0, 10_015.0), (5.0, 10.0, 10.0, 9_975.0), (300.0, 0.0, 1000.0, 1_001_300.0)]


def test_calendar(spark):
    span = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 12))], "a date, b date")
    got = {r.cal_date: r for r in calendar.neighbours(calendar.build(span)).collect()}
    assert not got[date(2024, 1, 1)].is_trading_day and not got[date(2024, 1, 6)].is_trading_day and got[date(2024, 1, 2)].is_trading_day
    assert got[date(2024, 1, 5)].next_trade_date == date(2024, 1, 8) and got[date(2024, 1, 8)].prev_trade_date == date(2024, 1, 5) and got[date(2024, 1, 2)].prev_trade_date is None


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), ("b", 2, 20)], "k string, u int, v int")
    loose = {(r.k, r.t): r.v for r in asof.join(left, right, ["k"], "t", "u", ["v"]).collect()}
    strict = {(r.k, r.t): r.v for r in asof.join(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert loose == {("a", 5): 50, ("a", 3): 30, ("b", 1): None} and strict == {("a", 5): 30, ("a", 3): None, ("b", 1): None}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, d int, x double")
    new = spark.createDataFrame([("a", 1, 9.0), ("c", 1, 3.0)], "k string, d int, x double")
    once = merge.upsert(old, new, ["k", "d"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.upsert(once, new, ["k", "d"]).collect())) == [("a", 1, 9.0), ("b", 1, 2.0), ("c", 1, 3.0)]


def test_corrected_version(spark):
    log = spark.createDataFrame([("a", 1, "2024-03-25", 1), ("a", 2, "2024-05-01", 2)], "k string, event_id int, effective_at string, version int")
    seen = lambda t, strict=True: [r.version for r in pit.as_of(log, ["k"], F.lit(t), strict=strict).collect()]
    assert seen("2024-04-01") == [1] and seen("2024-05-02") == [2] and seen("2024-03-25") == [] and seen("2024-03-25", False) == [1]


def test_code_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")
    assert {r.code: r.final for r in pit.resolve_codes(edges).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}


def test_fill_and_interpolate(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, None, 4.0, None])], "ts_code string, trade_date int, x double")
    assert [r.x for r in windows.ffill(rows, ["x"], limit=1).orderBy("trade_date").collect()] == [1.0, 1.0, None, 4.0, 4.0]
    assert [r.x for r in windows.interpolate(rows, "x").orderBy("trade_date").collect()] == [1.0, 2.0, 3.0, 4.0, None]


def test_checks_find_planted_rows(spark):
    d = date(2024, 1, 2)
    rows = [("600000.SH", d, 10.0, 9.0, 11.0, 10.0, 100, 1000.0, 1.0, False, 0.0), ("600001.SH", d, -1.0, 10.0, 9.0, 10.0, 0, 0.0, None, False, 70.0)]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, volume long, amount double, adj_factor double, is_suspend boolean, pct_chg double")
    found = {(r.alert_type, r.ts_code) for r in quality.run(bars.unionByName(bars.limit(1))).collect()}
    assert ("duplicate_rows", "600000.SH") in found and ("ohlc_violation", "600000.SH") in found
    assert {("ohlc_violation", "600001.SH"), ("pct_chg_extreme", "600001.SH"), ("zero_volume_non_suspend", "600001.SH"), ("adj_factor_invalid", "600001.SH"), ("over_limit", "600001.SH")} <= found


def test_stream_sync_is_idempotent(spark, tmp_path):
    schema = "ts_code string, trade_date date, open double, high double, low double, close double, volume long, amount double, adj_factor double, is_suspend boolean, pct_chg double"
    src = str(tmp_path / "in")
    row = lambda k, x: (k, date(2024, 1, 2), x, x, x, x, 10, 10 * x, 1.0, False, 0.0)
    for batch in ([row("a", 1.0), row("b", 2.0)], [row("a", 3.0), row("c", 4.0)], [row("a", 3.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        sync.sync(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    got = sync.read_synced(spark, str(tmp_path / "out"))
    assert {r.ts_code: r.close for r in got.collect()} == {"a": 3.0, "b": 2.0, "c": 4.0}
    totals = lambda: {r.ts_code: r.total_records for r in sync.progress(spark, str(tmp_path / "out")).collect()}
    assert totals() == {"a": 1, "b": 1, "c": 1}
    sync.sync(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "alerts"), str(tmp_path / "again")).awaitTermination()
    assert totals() == {"a": 1, "b": 1, "c": 1} and sync.read_synced(spark, str(tmp_path / "out")).count() == 3


def test_stream_checks_see_earlier_rows(spark, tmp_path):
    """A factor that jumps between two micro-batches is found."""
    schema = "ts_code string, trade_date date, open double, high double, low double, close double, volume long, amount double, adj_factor double, is_suspend boolean, pct_chg double"
    src, out = str(tmp_path / "in"), str(tmp_path / "alerts")
    for day, factor in ((2, 1.0), (3, 2.0)):
        spark.createDataFrame([("a", date(2024, 1, day), 1.0, 1.0, 1.0, 1.0, 10, 10.0, factor, False, 0.0)], schema).write.mode("append").parquet(src)
        sync.sync(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), out, str(tmp_path / "cp")).awaitTermination()
    found = sorted((r.alert_type, r.trade_date, r.detail) for r in spark.read.parquet(out).collect())
    assert found == [("adj_factor_jump", date(2024, 1, 3), "over 0.05"), ("factor_change", date(2024, 1, 3), "1.0")]


def test_stream_state_counts_days_once(spark, tmp_path):
    """Late days, days that come again, rows of one day in one batch, and rows without a key or a day."""
    schema = "ts_code string, trade_date date, open double, high double, low double, close double, volume long, amount double, adj_factor double, is_suspend boolean, pct_chg double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda k, n, x: (k, None if n is None else date(2024, 1, 1) + timedelta(days=n), x, x, x, x, 10, 10 * x, 1.0, False, None)
    batches = ([row("a", n, 1.0) for n in range(30)], [row("a", -40, 2.0), row("a", 5, 3.0), row("a", 5, 4.0), row("b", 7, 1.0)], [row(None, 1, 1.0), row("a", None, 1.0), row("a", 31, 5.0), row("a", -40, 9.0)])
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        sync.sync(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "alerts"), str(tmp_path / "cp"), context=3).awaitTermination()
    assert {(r.ts_code, r.last_date, r.total_records) for r in sync.progress(spark, out).collect()} == {("a", date(2024, 2, 1), 32), ("b", date(2024, 1, 8), 1)}
    got = {(r.ts_code, r.trade_date): r.close for r in sync.read_synced(spark, out).collect()}
    assert len(got) == 33 and got["a", date(2024, 1, 6)] == 4.0 and got["a", date(2023, 11, 22)] == 9.0
    assert sorted(x for x in __import__("os").listdir(tmp_path) if "staged" in x) == []


def test_days_of_intervals(spark):
    """Slices of a list of days, against a comparison of each interval with each day."""
    import random

    rng, start = random.Random(4), date(2020, 1, 1)
    day = lambda n: start + timedelta(days=n)
    days = [day(n) for n in rng.sample(range(400), 40)]
    rows = [(k, day(rng.randrange(-50, 450)) if k % 9 else None, day(rng.randrange(-50, 450)) if k % 7 else None) for k in range(200)]
    t = spark.createDataFrame(rows, "k int, a date, b date")
    got = {(r.k, r.t) for r in asof.on_days(t, spark.createDataFrame([(x,) for x in days], "t date"), F.col("a"), F.col("b")).collect()}
    assert got == {(k, x) for k, a, b in rows for x in days if a is not None and a <= x and (b is None or x <= b)}
    none = spark.createDataFrame([], "t date")
    assert asof.on_days(t, none, F.col("a"), F.col("b")).count() == 0


def test_long_chains_of_codes(spark):
    """Chains beyond eight changes, their end on a date, and cycles."""
    rows = [(f"a{k}", f"a{k + 1}", k) for k in range(100)] + [("b0", "b1", 3)]
    edges = spark.createDataFrame(rows, "old string, new string, day int")
    ends = lambda df: {r.code: r.final for r in df.collect()}
    assert ends(pit.resolve_codes(edges)) == {f"a{k}": "a100" for k in range(100)} | {"b0": "b1"}
    assert ends(pit.resolve_codes(edges, F.lit(49))) == {f"a{k}": "a50" for k in range(50)} | {"b0": "b1"}
    with pytest.raises(ValueError):
        pit.resolve_codes(edges.union(spark.createDataFrame([("a100", "a0", 1)], edges.schema)))


def test_counts_by_sweep_and_missing_days(spark):
    """Against comparisons of each interval with each day; the plans make no row for a day that is present."""
    import random

    rng, start = random.Random(9), date(2020, 1, 1)
    day = lambda n: start + timedelta(days=n)
    spans = [(f"k{i}", day(a := rng.randint(-30, 200)), day(a + rng.randint(-3, 90)) if rng.random() < 0.8 else None) for i in range(80)] + [("none", None, day(5))]
    asked = [day(n) for n in rng.sample(range(-10, 260), 60)]
    t, dates = spark.createDataFrame(spans, "k string, a date, b date"), spark.createDataFrame([(x,) for x in [*asked, asked[0], None]], "t date")
    got = {r.t: r.n for r in asof.count_active(t, dates, F.col("a"), F.col("b")).collect()}
    assert got == {x: n for x in asked if (n := sum(a is not None and a <= x and (b is None or x <= b) for _, a, b in spans))}
    assert asof.count_active(t.where("false"), dates, F.col("a"), F.col("b")).count() == 0

    cal = sorted(rng.sample(range(0, 200), 120))
    bars = [(k, day(n), float(n), n, False) for k in ("a", "b", "c") for n in sorted(rng.sample(range(-20, 230), 60))] + [("one", day(cal[3]), 1.0, 1, False)]
    rows = spark.createDataFrame(bars + bars[:2], "ts_code string, trade_date date, close double, volume long, is_suspend boolean")
    calendar_days, keys = spark.createDataFrame([(day(n),) for n in cal], "cal_date date"), spark.createDataFrame([("a",), ("none",), ("none",)], "ts_code string")
    want = {}
    for k in ("a", "b", "c"):
        have = {x[1] for x in bars if x[0] == k}
        lost = [x for x in map(day, cal) if min(have) <= x <= max(have) and x not in have]
        want[k] = (len(lost), lost[0]) if lost else None
    found = {r.ts_code: (r.missing, r.first_missing) for r in quality.completeness(rows, calendar_days, keys=keys).collect()}
    assert found == {k: v for k, v in want.items() if v} | {"none": (120, day(cal[0]))}
    plan = quality.completeness(rows, calendar_days)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan.split("scalar-subquery")[0]
    filled = quality.fill_missing(rows.distinct(), calendar_days)
    made = filled.where("filled").collect()
    assert len(made) == sum(v[0] for v in want.values() if v) and all(r.is_suspend and r.volume == 0 for r in made)
    severity = {r.ts_code: r.severity for r in quality.completeness_findings(rows, calendar_days, keys).collect()}
    assert severity["none"] == "ERROR" and severity["a"] == "WARNING"


def test_exchange_calendar(spark):
    bounds = spark.createDataFrame([(date(2018, 1, 1), date(2027, 12, 31))], "a date, b date")
    days = {r.cal_date: r.is_trading_day for r in calendar.build(bounds, calendar.exchange_holidays(spark)).collect()}
    closed = [date(2024, 2, 9), date(2024, 2, 16), date(2020, 10, 8), date(2023, 1, 2), date(2021, 9, 21), date(2018, 4, 30), date(2024, 1, 6)]
    assert not any(days[x] for x in closed) and days[date(2024, 2, 8)] and days[date(2024, 2, 19)] and days[date(2021, 9, 22)]
    assert all(235 <= sum(v for x, v in days.items() if x.year == y) <= 250 for y in range(2018, 2028))


def test_medians_without_gathering_groups(spark):
    """Against statistics.median, whatever the values are: ties, gaps, even counts, infinities, one value, nulls."""
    import random
    import statistics

    rng = random.Random(4)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(500)], "odd": [rng.expovariate(1) ** 9 for _ in range(501)], "ties": [float(rng.randint(0, 3)) for _ in range(400)], "one": [7.5],
        "two": [1.0, 4.0], "gap": [float(k) for k in range(50)] + [1e12 + k for k in range(50)], "same": [2.0] * 30, "close": [1 + k * 2.0**-52 for k in range(9)] + [1e9],
        "far": [-1e308, 1e308, 5.0, 6.0, 1e307], "ends": [float("-inf"), 1.0, 2.0, 9.0, float("inf")],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for cells, passes in [(1024, 2), (4, 2), (3, 0), (2, 5)]:
        got = {r.g: r.m for r in factors.medians(df, ["g"], "x", "m", cells, passes).collect()}
        assert got == {k: pytest.approx(statistics.median(v), rel=1e-15) for k, v in groups.items()}
    plan = factors.medians(df, ["g"], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan and "collect_" not in plan
    kept = factors.winsorize_mad(df.withColumnRenamed("g", "trade_date"), "x").collect()
    assert len(kept) == len(rows) and sum(r.x is None for r in kept) == 2
    assert factors.medians(df.where("false"), ["g"], "x").count() == 0


def test_successors_by_prefixes_of_names(spark):
    """Equal to all pairs; far fewer candidates than pairs of near dates; a name is never its own successor."""
    import random

    rng, start = random.Random(6), date(2020, 1, 1)
    letters = [chr(0x4E00 + k) for k in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    name = lambda: "".join(rng.choices(letters, weights, k=rng.randint(1, 7))) + rng.choice(["", "股份", "ST"])
    day = lambda: start + timedelta(days=rng.randint(0, 150))
    old = [(f"o{i}", name(), day()) for i in range(300)]
    old += [("both", "甲乙丙丁", start), ("both2", "甲乙丙丁", start), ("x", None, start), ("y", "股份", start), ("z", "甲乙", None)]
    new = [(f"n{i}", rng.choice(old)[1] if rng.random() < 0.3 else name(), day()) for i in range(300)]
    new += [("both", "丁丙乙甲", start), ("both2", "甲乙丙丁", start), ("both", "甲乙丙", start), ("y", "公司", start), ("w", None, start)]
    gone, listed = spark.createDataFrame(old, "ts_code string, name string, delist_date date"), spark.createDataFrame(new, "ts_code string, name string, list_date date")

    def chars(x):
        for s in codes.NAME_SUFFIXES:
            x = (x or "").replace(s, "")
        return set(x)

    for least in (0.5, 0.3, 0.8):
        want, near, true = {}, 0, set()
        for o, a, d in old:
            for n, b, l in new:
                if d and 0 <= (l - d).days <= 60 and chars(a) and chars(b):
                    near += 1
                    s = len(chars(a) & chars(b)) / len(chars(a) | chars(b))
                    if s > least:
                        true.add((d, "".join(sorted(chars(a))), l, "".join(sorted(chars(b)))))
                        if o != n:
                            want[o] = min(want.get(o, (date.max,)), (l, n, -s))
        got = {r.old: (r.new, round(r.similarity, 12)) for r in lifetimes.successors(gone, listed, least=least).collect()}
        assert got == {o: (n, round(-s, 12)) for o, (_, n, s) in want.items()} and got["both"][0] == "both2"
        sets = [x.select(c, F.array_join(F.array_sort(codes.name_chars(F.col("name"))), "").alias("chars")).where(f"chars != '' and {c} is not null").distinct() for x, c in ((gone, "delist_date"), (listed, "list_date"))]
        pairs = lambda verify: [tuple(r)[:4] for r in lifetimes.similar_sets(*sets, 60, least, verify).collect()]
        found, tried = pairs(True), pairs(False)
        assert sorted(found) == sorted(true) and len(set(tried)) == len(tried) and true <= set(tried) and len(tried) < near / 2
    assert lifetimes.successors(gone.where("false"), listed).count() == 0
