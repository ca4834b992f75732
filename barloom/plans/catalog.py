"""Queries by inventory id, each with the SQL that an oracle can run on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import codes
from barloom.operators import acceptance, asof, calendar, factors, merge, pit, portfolio, quality, storage, windows
from barloom.sources import derived as d
from barloom.sources.derived import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = "1999-06-30"


def query(name: str, tables: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(tables, oracle)
        return f

    return add


def plain(name: str, table: str, oracle_tables: str, oracle: str, build) -> None:
    """A query of one derived table."""
    query(name, oracle_tables, oracle)(lambda spark, sf_dir: build(getattr(d, table)(spark, sf_dir)))


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


at = lambda day: F.lit(day).cast("date")
BAR = "ts_code, trade_date, open, high, low, close, volume"
bar = BAR.split(", ")

plain("S-01", "bars", "bars", "SELECT ts_code, trade_date, close, volume FROM bars", lambda b: b.select("ts_code", "trade_date", "close", "volume"))
plain("S-05", "bars", "bars", "SELECT ts_code, trade_date, CASE WHEN 2001 - year(trade_date) <= 2 THEN 'hot' WHEN 2001 - year(trade_date) <= 5 THEN 'warm' ELSE 'cold' END AS tier FROM bars", lambda b: b.select("ts_code", "trade_date", merge.tier(F.col("trade_date"), "2001-06-01").alias("tier")))
plain("S-10", "bars", "bars", "SELECT ts_code, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars GROUP BY ts_code", lambda b: b.groupBy("ts_code").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")))


def layered(spark: SparkSession, sf_dir: str) -> str:
    """A table of two layers: raw bars, and bars adjusted by their factor."""
    root, b = storage.shared_folder(spark, "layers"), d.bars(spark, sf_dir).select(*bar, "adj_factor")
    storage.write_layer(b.drop("adj_factor"), root, "raw")
    storage.write_layer(b.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")}).drop("adj_factor"), root, "adjusted")
    return root


@query("S-02", "bars", f"SELECT {BAR} FROM bars WHERE ts_code IN ('600000.SH', '688001.SH', '000002.SZ') AND trade_date BETWEEN '1997-01-01' AND '1998-12-31'")
def layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.read_layer(spark, layered(spark, sf_dir), "raw", ["600000.SH", "688001.SH", "000002.SZ"], "1997-01-01", "1998-12-31").select(bar)


@query("S-02-adjusted", "bars", "SELECT ts_code, trade_date, round(close * adj_factor, 6) AS close FROM bars WHERE ts_code LIKE '688%' AND trade_date >= '1998-01-01'")
def adjusted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.read_layer(spark, layered(spark, sf_dir), "adjusted", first="1998-01-01").where(F.startswith("ts_code", F.lit("688"))).select("ts_code", "trade_date", r6("close"))


@query("S-03", "bars", "SELECT ts_code, trade_date, close FROM bars WHERE trade_date BETWEEN '1997-03-01' AND '1998-02-28'")
def year_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.shared_folder(spark, "bars-by-year")
    merge.write_by_year(d.bars(spark, sf_dir), path)
    return merge.read_years(spark, path, "1997-03-01", "1998-02-28").select("ts_code", "trade_date", "close")


@query("S-04", "bars", "SELECT ts_code, trade_date, CASE WHEN trade_date >= '1999-01-01' THEN close ELSE close + 1 END AS close FROM bars")
def hot_and_cold(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close")
    return merge.keep_last([b.withColumn("close", F.col("close") + 1), b.where(F.col("trade_date") >= at("1999-01-01"))], ["ts_code", "trade_date"])


@query("S-12", "bars", "SELECT ts_code, trade_date, CASE WHEN year(trade_date) = 1998 THEN close * 2 ELSE close END AS close FROM bars")
def upserted(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close")
    return merge.upsert(b, b.where("year(trade_date) = 1998").withColumn("close", F.col("close") * 2), ["ts_code", "trade_date"])


@query("S-16", "bars", "SELECT ts_code, max(trade_date) AS last_date, count(*) AS total_records FROM bars GROUP BY ts_code")
def progressed(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    none = spark.createDataFrame([], "ts_code string, last_date date, total_records long, last_batch string")
    one = merge.merge_progress(none, b.where("year(trade_date) < 1998"), "1")
    again = merge.merge_progress(one, b.where("year(trade_date) < 1998"), "1")
    return merge.merge_progress(again, b.where("year(trade_date) >= 1998"), "2").drop("last_batch")


@query("S-21", "bars", "SELECT ts_code, trade_date, close, CASE WHEN ts_code LIKE '6%' THEN 0 ELSE 1 END AS priority FROM bars")
def fallback(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close")
    return merge.first_source([b.where(F.startswith("ts_code", F.lit("6"))), b], "ts_code")


@query("S-29", "bars", "SELECT ts_code, trade_date, close FROM bars")
def first_write_wins(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close")
    return merge.insert_or_ignore(b.where("year(trade_date) < 1999"), b.where("year(trade_date) >= 1999").unionByName(b.where("year(trade_date) = 1998").withColumn("close", F.lit(0.0))), ["ts_code", "trade_date"])


plain("S-25", "membership", "membership", "SELECT ts_code, in_date, coalesce(out_date, DATE '2002-01-01') AS out_date FROM membership", lambda m: m.select("ts_code", "in_date", F.coalesce("out_date", at("2002-01-01")).alias("out_date")))
plain("P-01", "bars", "bars", f"SELECT {BAR} FROM bars WHERE ts_code = '000002.SZ' AND trade_date >= '1997-01-01'", lambda b: b.where((F.col("ts_code") == "000002.SZ") & (F.col("trade_date") >= at("1997-01-01"))).select(bar))
plain("P-02", "bars", "bars", "SELECT ts_code, trade_date, round(close * adj_factor, 6) AS close, round(pre_close * adj_factor, 6) AS pre_close, round(CASE WHEN pre_close > 0 THEN (close / pre_close - 1) * 100 ELSE 0 END, 6) AS pct_chg FROM bars", lambda b: b.select("ts_code", "trade_date", F.round(F.col("close") * F.col("adj_factor"), 6).alias("close"), F.round(F.col("pre_close") * F.col("adj_factor"), 6).alias("pre_close"), F.round(F.when(F.col("pre_close") > 0, F.col("pct_chg")).otherwise(0.0), 6).alias("pct_chg")))
plain("P-03", "bars", "bars", "SELECT ts_code, left(ts_code, 6) AS symbol, close FROM bars WHERE trade_date = '1998-06-01'", lambda b: b.where(F.col("trade_date") == at("1998-06-01")).select("ts_code", F.left("ts_code", F.lit(6)).alias("symbol"), "close"))
plain("P-04", "bars", "bars", f"SELECT {BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1", lambda b: windows.latest(b.select(bar), ["ts_code"], F.col("trade_date").desc()))
plain("P-05", "bars", "bars", "SELECT ts_code, max(trade_date) AS last_day FROM bars GROUP BY ts_code", lambda b: b.groupBy("ts_code").agg(F.max("trade_date").alias("last_day")))
plain("P-08", "bars", "bars", "SELECT ts_code FROM bars WHERE ts_code NOT LIKE '6%' OR year(trade_date) < 1998 GROUP BY ts_code HAVING max(trade_date) < '1998-06-01'", lambda b: b.where(~F.startswith("ts_code", F.lit("6")) | (F.year("trade_date") < 1998)).groupBy("ts_code").agg(F.max("trade_date").alias("m")).where(F.col("m") < at("1998-06-01")).select("ts_code"))
plain("P-12", "history", "history", "SELECT ts_code FROM history QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY eff_date DESC) = 1 AND (delist_date IS NULL OR delist_date > '2000-01-01')", lambda h: windows.latest(h, ["ts_code"], F.col("eff_date").desc()).where("delist_date is null or delist_date > '2000-01-01'").select("ts_code"))
plain("P-24", "history", "history", "SELECT ts_code, eff_date FROM history WHERE eff_date = (SELECT max(eff_date) FROM history)", lambda h: h.join(F.broadcast(h.agg(F.max("eff_date").alias("eff_date"))), "eff_date").select("ts_code", "eff_date"))
plain("P-18", "calendar", "calendar", "SELECT cal_date FROM calendar WHERE is_trading_day AND cal_date BETWEEN '1998-01-01' AND '1998-12-31'", lambda c: c.where(F.col("is_trading_day") & F.col("cal_date").between("1998-01-01", "1998-12-31")).select("cal_date"))


def universe_sizes(spark, sf_dir):
    return asof.count_active(windows.validity(d.history(spark, sf_dir)), d.dates(spark, sf_dir), F.col("eff_date"), F.date_sub("valid_to", 1))


@query("J-05", "history dates", "SELECT t, ts_code, eff_date, status FROM (SELECT *, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS n FROM history) JOIN dates ON eff_date <= t AND (n IS NULL OR t < n)")
def active_versions(spark, sf_dir):
    return asof.active(windows.validity(d.history(spark, sf_dir)), d.dates(spark, sf_dir)).select("t", "ts_code", "eff_date", "status")


@query("J-06", "history fundamentals", "SELECT h.ts_code, h.eff_date, f.ann_date FROM history h ASOF LEFT JOIN (SELECT DISTINCT ts_code, ann_date FROM fundamentals) f ON h.ts_code = f.ts_code AND h.eff_date > f.ann_date")
def asof_strict(spark, sf_dir):
    h, f = d.history(spark, sf_dir), d.fundamentals(spark, sf_dir)
    return asof.join(h.select("ts_code", "eff_date"), f.select("ts_code", "ann_date"), ["ts_code"], "eff_date", "ann_date", ["ann_date"], strict=True)


@query("J-07", "membership dates", "SELECT t, ts_code, index_code FROM membership JOIN dates ON in_date <= t AND t <= coalesce(out_date, DATE '9999-12-31')")
def members_on(spark, sf_dir):
    return asof.members(d.membership(spark, sf_dir), d.dates(spark, sf_dir)).select("t", "ts_code", "index_code")


@query("J-10", "history", "SELECT DISTINCT ts_code FROM history WHERE eff_date < '1997-01-01' AND ts_code NOT IN (SELECT ts_code FROM history WHERE eff_date >= '2000-01-01')")
def left_behind(spark, sf_dir):
    h = d.history(spark, sf_dir)
    return h.where(F.col("eff_date") < at("1997-01-01")).select("ts_code").distinct().join(h.where(F.col("eff_date") >= at("2000-01-01")), "ts_code", "left_anti")


@query("J-11", "bars", "SELECT ts_code, trade_date, CASE WHEN volume % 5 = 0 THEN 'b' ELSE 'a' END AS side FROM bars WHERE volume % 5 = 0 OR volume % 5 = 1")
def one_sided(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return quality.missing_keys(b.where("volume % 5 != 0"), b.where("volume % 5 != 1"), ["ts_code", "trade_date"])


@query("J-17", "bars", "SELECT s.ts_code, count(*) AS missing, min(g.w) AS first_missing FROM (SELECT ts_code, min(trade_date) a, max(trade_date) b FROM bars GROUP BY ts_code) s JOIN (SELECT DISTINCT trade_date AS w FROM bars) g ON g.w BETWEEN a AND b ANTI JOIN bars x ON x.ts_code = s.ts_code AND x.trade_date = g.w GROUP BY s.ts_code")
def missing_weeks(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return quality.completeness(b, b.select(F.col("trade_date").alias("cal_date")).distinct())


@query("DQ-31", "bars", "SELECT s.ts_code, g.w AS trade_date, last_value(x.close IGNORE NULLS) OVER (PARTITION BY s.ts_code ORDER BY g.w) AS close, coalesce(x.volume, 0) AS volume, coalesce(x.is_suspend, true) AS is_suspend, x.close IS NULL AS filled FROM (SELECT ts_code, min(trade_date) a, max(trade_date) b FROM bars GROUP BY ts_code) s JOIN (SELECT DISTINCT trade_date AS w FROM bars) g ON g.w BETWEEN a AND b LEFT JOIN bars x ON x.ts_code = s.ts_code AND x.trade_date = g.w")
def filled_weeks(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return quality.fill_missing(b, b.select(F.col("trade_date").alias("cal_date")).distinct())


plain("A-01", "fundamentals", "fundamentals", "SELECT ts_code, end_date, count(*) AS n FROM fundamentals GROUP BY 1, 2 HAVING count(*) > 1", lambda f: f.groupBy("ts_code", "end_date").agg(F.count("*").alias("n")).where("n > 1"))
plain("A-06", "bars", "bars", "SELECT count(*) AS total, count(*) FILTER (volume % 11 = 0) AS anomalies, round(1 - count(*) FILTER (volume % 11 = 0) / nullif(count(*), 0), 6) AS score FROM bars", lambda b: b.agg(F.count("*").alias("total"), F.count_if(F.col("volume") % 11 == 0).alias("anomalies"), F.round(1 - F.try_divide(F.count_if(F.col("volume") % 11 == 0), F.count("*")), 6).alias("score")))
plain("A-08", "history", "history", "SELECT ts_code, count(*) AS n, string_agg(strftime(eff_date, '%Y-%m-%d') || ':' || status, ',' ORDER BY eff_date) AS events FROM history GROUP BY ts_code", lambda h: h.groupBy("ts_code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("eff_date", "status"))).alias("e")).select("ts_code", "n", F.array_join(F.transform("e", lambda x: F.concat(x["eff_date"].cast("string"), F.lit(":"), x["status"])), ",").alias("events")))
plain("A-09", "history", "history", "SELECT board, status, count(*) AS n FROM history GROUP BY 1, 2", lambda h: h.groupBy("board", "status").agg(F.count("*").alias("n")))
plain("A-12", "fundamentals", "fundamentals", "SELECT 'roe' AS field, count(*) FILTER (roe IS NULL) AS nulls FROM fundamentals UNION ALL SELECT 'revenue', count(*) FILTER (revenue IS NULL) FROM fundamentals", lambda f: f.agg(F.count_if(F.col("roe").isNull()).alias("roe"), F.count_if(F.col("revenue").isNull()).alias("revenue")).unpivot([], ["roe", "revenue"], "field", "nulls"))
plain("A-17", "bars", "bars", "SELECT count(*) AS n, count(DISTINCT ts_code) AS keys, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars", lambda b: b.agg(F.count("*").alias("n"), F.countDistinct("ts_code").alias("keys"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")))
query("A-04", "history dates", "SELECT t, count(DISTINCT ts_code) AS n FROM (SELECT *, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS n FROM history) JOIN dates ON eff_date <= t AND (n IS NULL OR t < n) GROUP BY t")(lambda spark, sf_dir: universe_sizes(spark, sf_dir))

RETURNS = "SELECT ts_code, trade_date, ret_5, ret_20 FROM (SELECT ts_code, trade_date, row_number() OVER w AS rn, round(exp(sum(ln(1 + pct_chg / 100)) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 4 PRECEDING)) - 1, 4) AS ret_5, round(exp(sum(ln(1 + pct_chg / 100)) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING)) - 1, 4) AS ret_20 FROM bars WHERE volume > 0 AND pct_chg > -100 WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)) WHERE rn >= 20"
plain("W-01", "bars", "bars", RETURNS, lambda b: windows.rolling_return(b, (5, 20)))
plain("W-02", "bars", "bars", "SELECT ts_code, trade_date, round(avg(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 4 PRECEDING), 2) AS ma_5 FROM bars", lambda b: windows.rolling_mean(b, (5,)))
plain("W-03", "bars", "bars", "SELECT ts_code, trade_date, round(stddev_samp(pct_chg) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING), 4) AS vol_20 FROM bars", lambda b: windows.rolling_vol(b, (20,)))
plain("W-05", "bars", "bars", "SELECT ts_code, trade_date, round(j, 6) AS jump FROM (SELECT *, abs((adj_factor - lag(adj_factor) OVER w) / nullif(lag(adj_factor) OVER w, 0)) AS j FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)) WHERE j > 0.05", lambda b: b.select("ts_code", "trade_date", windows.ratio_to_previous("adj_factor").alias("jump")).where("jump > 0.05").withColumn("jump", F.round("jump", 6)))
plain("W-10", "bars", "bars", "SELECT ts_code, trade_date FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) QUALIFY count(*) OVER w = 20 AND volume > 3 * avg(volume) OVER w", lambda b: quality.volume_spike(b, 3.0).select("ts_code", "trade_date"))
plain("W-11", "fundamentals", "fundamentals", "SELECT report, last_value(roe IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY ann_date, report) AS roe FROM fundamentals", lambda f: windows.ffill(f.withColumn("o", F.struct("ann_date", "report")), ["roe"], order="o").select("report", "roe"))
plain("W-13", "bars", "bars", "SELECT ts_code, trade_date, after, days, CASE WHEN days <= 35 THEN 'minor' WHEN days <= 70 THEN 'moderate' ELSE 'severe' END AS severity FROM (SELECT ts_code, trade_date, lag(trade_date) OVER w AS after, (trade_date - lag(trade_date) OVER w)::INTEGER AS days FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)) WHERE days > 7", lambda b: windows.gaps(b))
plain("W-15", "bars", "bars", "SELECT ts_code, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS n_rows FROM (SELECT *, sum(CASE WHEN is_suspend THEN 0 ELSE 1 END) OVER (PARTITION BY ts_code ORDER BY trade_date) AS g FROM bars) WHERE is_suspend GROUP BY ts_code, g", lambda b: windows.runs(b, "is_suspend"))
plain("W-16", "bars", "bars", "SELECT ts_code, trade_date, round(close / nullif(lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1, 6) AS ret FROM bars", lambda b: b.select("ts_code", "trade_date", F.round(F.try_divide("close", F.lag("close").over(windows.by())) - 1, 6).alias("ret")))
plain("W-17", "history", "history", "SELECT ts_code, eff_date, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS valid_to FROM history", lambda h: windows.validity(h).select("ts_code", "eff_date", "valid_to"))
plain("W-06", "history", "history", "SELECT ts_code, eff_date FROM history WINDOW w AS (PARTITION BY ts_code ORDER BY eff_date) QUALIFY lag(eff_date) OVER w IS NULL OR eff_date - lag(eff_date) OVER w > 180", lambda h: h.withColumn("b", F.lag("eff_date").over(windows.by(day="eff_date"))).where("b is null or datediff(eff_date, b) > 180").select("ts_code", "eff_date"))
plain("L-05", "bars", "bars", "SELECT ts_code, trade_date, amount FROM bars QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, ts_code) <= 5", lambda b: b.withColumn("rn", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("amount").desc(), "ts_code"))).where("rn <= 5").select("ts_code", "trade_date", "amount"))
plain("F-01", "bars", "bars", "SELECT DISTINCT ts_code, CASE WHEN ts_code LIKE '688%' THEN 'STAR' WHEN ts_code LIKE '%.BJ' THEN 'BSE' WHEN ts_code LIKE '30%' THEN 'ChiNext' ELSE 'main' END AS board, right(ts_code, 2) AS exchange FROM bars", lambda b: b.select("ts_code").distinct().select("ts_code", codes.board(F.left("ts_code", F.lit(6))).alias("board"), codes.exchange(F.left("ts_code", F.lit(6))).alias("exchange")))
plain("F-06", "bars", "bars", "SELECT ts_code, trade_date, CASE WHEN ts_code LIKE '688%' THEN 0.2 WHEN ts_code LIKE '%.BJ' THEN 0.3 ELSE 0.1 END::DOUBLE AS limit_pct FROM bars", lambda b: b.select("ts_code", "trade_date", codes.limit_pct(F.col("ts_code"), F.col("trade_date")).alias("limit_pct")))
plain("F-07", "bars", "bars", "SELECT ts_code, trade_date, CASE WHEN pct_chg >= p - 0.01 THEN 'up' WHEN pct_chg <= 0.01 - p THEN 'down' ELSE 'none' END AS hit FROM (SELECT *, CASE WHEN ts_code LIKE '688%' THEN 20 WHEN ts_code LIKE '%.BJ' THEN 30 ELSE 10 END AS p FROM bars)", lambda b: b.select("ts_code", "trade_date", codes.limit_hit(F.col("pct_chg"), codes.limit_pct(F.col("ts_code"), F.col("trade_date"))).alias("hit")))


@query("D-01", "bars", "SELECT cal_date, dayofweek(cal_date) BETWEEN 1 AND 5 AND NOT (strftime(cal_date, '%m-%d') BETWEEN '10-01' AND '10-07' OR strftime(cal_date, '%m-%d') BETWEEN '05-01' AND '05-03' OR strftime(cal_date, '%m-%d') = '01-01') AS is_trading_day FROM (SELECT unnest(generate_series(min(l_shipdate)::DATE::TIMESTAMP, max(l_shipdate)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS cal_date FROM lineitem)")
def with_holidays(spark, sf_dir):
    """A calendar with a table of holidays: here weeks and days of every year, as a rule; a user gives the exchange's own."""
    bounds = d.read(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    day = F.date_format("cal_date", "MM-dd")
    closed = bounds.select(F.explode(F.sequence("a", "b")).alias("cal_date")).where(day.between("10-01", "10-07") | day.between("05-01", "05-03") | (day == "01-01"))
    return calendar.build(bounds, closed).select("cal_date", "is_trading_day")


#: Derived days are moved by a whole number of years, into the ones whose closures are known.
YEARS_ON = 26
CLOSED = ", ".join(f"('{a}', '{b}')" for a, b in calendar.closures())


@query("D-01-exchange", "bars", f"SELECT cal_date, dayofweek(cal_date) BETWEEN 1 AND 5 AND NOT EXISTS (SELECT 1 FROM (VALUES {CLOSED}) c(a, b) WHERE cal_date BETWEEN a::DATE AND b::DATE) AS is_trading_day FROM (SELECT unnest(generate_series((min(l_shipdate)::DATE + INTERVAL {YEARS_ON} YEAR)::TIMESTAMP, (max(l_shipdate)::DATE + INTERVAL {YEARS_ON} YEAR)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS cal_date FROM lineitem)")
def exchange_days(spark, sf_dir):
    """The exchange's own calendar, over the ship dates moved into its years."""
    moved = lambda f: F.to_date(F.add_months(F.to_date(f("l_shipdate")), 12 * YEARS_ON))
    bounds = d.read(spark, sf_dir, "lineitem").agg(moved(F.min).alias("a"), moved(F.max).alias("b"))
    return calendar.build(bounds, calendar.exchange_holidays(spark)).select("cal_date", "is_trading_day")


plain("D-02", "calendar", "calendar", "SELECT c.cal_date, (SELECT max(x.cal_date) FROM calendar x WHERE x.is_trading_day AND x.cal_date < c.cal_date) AS prev_trade_date, (SELECT min(x.cal_date) FROM calendar x WHERE x.is_trading_day AND x.cal_date > c.cal_date) AS next_trade_date FROM calendar c", lambda c: calendar.neighbours(c).select("cal_date", "prev_trade_date", "next_trade_date"))
plain("D-05", "calendar", "calendar", "SELECT max(cal_date) AS cal_date FROM calendar WHERE is_trading_day GROUP BY date_trunc('month', cal_date)", lambda c: calendar.rebalance_days(c))


@query("M-03", "history dates", "SELECT t, ts_code, board, delist_date IS NULL OR delist_date > t AS is_tradable FROM (SELECT *, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS n FROM history WHERE board IN ('1-URGENT', '3-MEDIUM', '5-LOW')) JOIN dates ON eff_date <= t AND (n IS NULL OR t < n) WHERE t - list_date >= 60 AND (delist_date IS NULL OR delist_date >= t)")
def universe(spark, sf_dir):
    """Boards stand for exchanges here."""
    return pit.universe(d.history(spark, sf_dir), d.dates(spark, sf_dir), min_days=60, inclusive=True, exchanges=["1-URGENT", "3-MEDIUM", "5-LOW"], exchange="board").select("t", "ts_code", "board", "is_tradable")


@query("M-08", "fundamentals dates", "SELECT t, ts_code, report, end_date FROM fundamentals JOIN dates ON ann_date BETWEEN t - 90 AND t - 1 QUALIFY row_number() OVER (PARTITION BY t, ts_code ORDER BY end_date DESC, ann_date DESC, report DESC) = 1")
def visible(spark, sf_dir):
    return pit.visible(d.fundamentals(spark, sf_dir), d.dates(spark, sf_dir)).select("t", "ts_code", "report", "end_date")


@query("M-10", "fundamentals dates", "SELECT t, ts_code, arg_max(roe, (ann_date, end_date, report)) FILTER (roe IS NOT NULL) AS roe FROM fundamentals JOIN dates ON ann_date < t GROUP BY t, ts_code")
def pit_factors(spark, sf_dir):
    return pit.factors(d.fundamentals(spark, sf_dir), d.dates(spark, sf_dir), ["roe"])


EVENTS = "SELECT event_id, user_id, event_type, row_number() OVER w AS version, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


#: Of the second of three appends, the second one repeated.
APPENDS = ("ts < TIMESTAMP '2024-01-10'", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-20'")


def appended(spark, sf_dir) -> str:
    """Events stored as versions in three batches, of which the second comes twice; the folder."""
    folder, events = storage.shared_folder(spark, "versions"), d.read(spark, sf_dir, "events")
    for k in (0, 1, 1, 2):
        pit.append_versions(spark, folder, events.where(APPENDS[k]), ["user_id", "event_type"], ["ts", "event_id"], k)
    return folder


@query("M-12", "dates", EVENTS)
def versions(spark, sf_dir):
    return pit.read_versions(spark, appended(spark, sf_dir), ["user_id", "event_type"]).select("event_id", "user_id", "event_type", "version", "status")


@query("M-12-changelog", "dates", f"SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, 'store' AS action, CASE WHEN {APPENDS[0]} THEN 0 WHEN {APPENDS[1]} THEN 1 ELSE 2 END AS batch FROM events")
def changes(spark, sf_dir):
    return spark.read.parquet(f"{appended(spark, sf_dir)}/changelog").select("user_id", "event_type", "version", "action", "batch")


@query("M-13", "dates", "SELECT event_id, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def version_as_of(spark, sf_dir):
    log = pit.number_versions(d.read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    return pit.as_of(log, ["user_id", "event_type"], F.lit("2024-01-15").cast("timestamp_ntz"), "ts").select("event_id", "user_id", "event_type")


@query("M-06", "membership", "SELECT index_code, ts_code, in_date, CASE WHEN out_date IS NULL AND hash_bit THEN DATE '2001-12-31' ELSE out_date END AS out_date FROM (SELECT *, length(ts_code) % 2 = 0 AS hash_bit FROM membership)")
def snapshot_diff(spark, sf_dir):
    m = d.membership(spark, sf_dir)
    return pit.diff_snapshots(m, m.where("out_date is null and length(ts_code) % 2 = 1").select("index_code", "ts_code"), "2002-01-01")


#: Bars with faults of every kind, by the volume; each check finds its own.
FLAWED = "flawed AS (SELECT * REPLACE (CASE WHEN volume % 11 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN volume % 13 = 0 THEN -open ELSE open END AS open, CASE WHEN volume % 17 = 0 THEN NULL WHEN volume % 19 = 0 THEN adj_factor * 1000 ELSE adj_factor END AS adj_factor, CASE WHEN volume % 23 = 0 THEN 0 WHEN volume % 7 = 0 THEN volume * 1000 ELSE volume END AS volume) FROM bars)"


def flawed(b):
    v, c = F.col("volume"), F.col
    return b.withColumns({
        "high": F.when(v % 11 == 0, c("low") - 1).otherwise(c("high")), "open": F.when(v % 13 == 0, -c("open")).otherwise(c("open")),
        "adj_factor": F.when(v % 17 == 0, None).when(v % 19 == 0, c("adj_factor") * 1000).otherwise(c("adj_factor")), "volume": F.when(v % 23 == 0, 0).when(v % 7 == 0, v * 1000).otherwise(v),
    })


WHERE = {
    "DQ-02": ("ohlc_violation", "high < low OR open NOT BETWEEN low * 0.999 AND high * 1.001 OR close NOT BETWEEN low * 0.999 AND high * 1.001"),
    "DQ-03": ("pct_chg_extreme", "abs(pct_chg) > 60"), "DQ-05": ("zero_volume_non_suspend", "volume = 0 AND NOT is_suspend"),
    "DQ-08": ("volume_amount_inconsistent", "abs((amount - volume * close) / nullif(volume * close, 0)) > 0.2"), "DQ-14": ("adj_factor_invalid", "adj_factor IS NULL OR adj_factor <= 0 OR adj_factor > 100"),
    "DQ-19": ("suspended_with_volume", "is_suspend AND volume > 1000"), "DQ-20": ("over_limit", "abs(pct_chg) > CASE WHEN ts_code LIKE '688%' THEN 21 WHEN ts_code LIKE '%.BJ' THEN 31 ELSE 11 END"),
}
for _name, _where in WHERE.items():
    plain(_name, "bars", "bars", f"WITH {FLAWED} SELECT '{_where[0]}' AS alert_type, ts_code, trade_date FROM flawed WHERE {_where[1]}", lambda b, n=_where[0]: quality.CHECKS[n](flawed(b)).drop("detail"))

plain("DQ-04", "bars", "bars", "SELECT ts_code, trade_date FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date) QUALIFY abs(adj_factor / lag(adj_factor) OVER w - 1) > 0.05", lambda b: quality.adj_factor_jump(b).select("ts_code", "trade_date"))
BACKWARDS = "backwards AS (SELECT * REPLACE (CASE WHEN length(ts_code) % 2 = 0 THEN in_date - 5 ELSE out_date END AS out_date) FROM membership)"


def backwards(m):
    """Memberships of which some end before they begin."""
    return m.withColumn("out_date", F.when(F.length("ts_code") % 2 == 0, F.date_sub("in_date", 5)).otherwise(F.col("out_date")))


plain("DQ-09", "membership", "membership", f"WITH {BACKWARDS} SELECT ts_code, in_date AS trade_date FROM backwards WHERE out_date < in_date", lambda m: quality.index_dates(backwards(m)).select("ts_code", "trade_date"))
PRICES = "SELECT * FROM (SELECT unnest([CASE WHEN high < low THEN 'high_low:ERROR' END, CASE WHEN high < open THEN 'high_open:ERROR' END, CASE WHEN high < close THEN 'high_close:ERROR' END, CASE WHEN low > open THEN 'low_open:ERROR' END, CASE WHEN low > close THEN 'low_close:ERROR' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive:CRITICAL' END]) AS x, ts_code, trade_date FROM flawed) WHERE x IS NOT NULL"
plain("DQ-16", "bars", "bars", f"WITH {FLAWED} SELECT split_part(x, ':', 1) AS alert_type, split_part(x, ':', 2) AS severity, ts_code, trade_date FROM ({PRICES})", lambda b: quality.price_logic(flawed(b)))

#: Every check of the fourteen: bars with faults and repeated rows, adjusted bars that lack some, memberships, universe.
FOURTEEN = f"""{FLAWED}, {BACKWARDS}, raw AS (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE volume % 29 = 0), adj AS (SELECT * REPLACE (close * adj_factor * CASE WHEN volume % 13 = 0 THEN 1.05 ELSE 1.0 END AS close) FROM flawed WHERE volume % 31 <> 0),
  gone AS (SELECT ts_code, max(trade_date) - 10 AS delist_date FROM raw GROUP BY ts_code), listed AS (SELECT t, count(DISTINCT ts_code) AS n FROM (SELECT *, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS n FROM history) JOIN dates ON eff_date <= t AND (n IS NULL OR t < n) GROUP BY t),
  alerts AS (SELECT 'duplicate_rows' AS alert_type, ts_code, trade_date FROM raw GROUP BY ts_code, trade_date HAVING count(*) > 1
  {" ".join(f"UNION ALL SELECT '{n}', ts_code, trade_date FROM raw WHERE {w}" for k, (n, w) in WHERE.items() if k in ("DQ-02", "DQ-03", "DQ-05", "DQ-08", "DQ-14"))}
  UNION ALL (SELECT 'adj_factor_jump', ts_code, trade_date FROM raw WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date) QUALIFY abs(adj_factor / nullif(lag(adj_factor) OVER w, 0) - 1) > 0.05)
  UNION ALL SELECT 'delisted_with_future_data', ts_code, trade_date FROM raw JOIN gone USING (ts_code) WHERE trade_date > delist_date
  UNION ALL SELECT 'adj_raw_ratio_invalid', ts_code, trade_date FROM raw JOIN adj USING (ts_code, trade_date) WHERE abs(adj.close / nullif(raw.close, 0) - raw.adj_factor) > raw.adj_factor * 0.01
  UNION ALL SELECT 'index_date_invalid', ts_code, in_date FROM backwards WHERE out_date < in_date
  UNION ALL SELECT 'pit_universe_size_suspicious', NULL, t FROM listed WHERE n NOT BETWEEN 100 AND 1200
  UNION ALL SELECT 'raw_adj_row_count_mismatch', ts_code, NULL FROM (SELECT ts_code, count(*) AS a FROM raw GROUP BY 1) FULL JOIN (SELECT ts_code, count(*) AS b FROM adj GROUP BY 1) USING (ts_code) WHERE coalesce(a, 0) <> coalesce(b, 0)
  UNION ALL SELECT 'raw_adj_pk_missing', ts_code, trade_date FROM raw ANTI JOIN adj USING (ts_code, trade_date)
  UNION ALL SELECT 'qfq_close_mismatch', ts_code, trade_date FROM raw JOIN adj USING (ts_code, trade_date) WHERE abs((adj.close - raw.close * raw.adj_factor) / nullif(raw.close * raw.adj_factor, 0)) > 0.001)"""


def fourteen(spark, sf_dir, **limits):
    f = flawed(d.bars(spark, sf_dir)).withColumn("delist_date", F.date_sub(F.max("trade_date").over(Window.partitionBy("ts_code")), 10))
    copies = F.array_compact(F.array(F.lit(False), F.when(F.col("volume") % 29 == 0, False), F.when(F.col("volume") % 31 != 0, True)))
    close = F.when(F.col("is_adjusted"), F.col("close") * F.col("adj_factor") * F.when(F.col("volume") % 13 == 0, 1.05).otherwise(1.0)).otherwise(F.col("close"))
    rows = f.withColumn("is_adjusted", F.explode(copies)).withColumn("close", close)
    return quality.summary(acceptance.data_quality(rows, backwards(d.membership(spark, sf_dir)), universe_sizes(spark, sf_dir), universe=(100, 1200), **limits), "n")


TALLY = "SELECT alert_type, count(*) AS n, count(DISTINCT ts_code) AS keys FROM alerts"
query("DQ-15", "bars history membership dates", f"WITH {FOURTEEN} {TALLY} GROUP BY alert_type")(fourteen)
query("DQ-15-range", "bars history membership dates", f"WITH {FOURTEEN} {TALLY} WHERE trade_date BETWEEN '1996-01-01' AND '1997-12-31' AND (ts_code IS NULL OR ts_code LIKE '60%' OR ts_code IN ('c1', 'c10')) GROUP BY alert_type")(lambda spark, sf_dir: fourteen(spark, sf_dir, first="1996-01-01", last="1997-12-31", keys=lambda c: c.like("60%") | c.isin("c1", "c10")))


@query("DQ-26", "bars", "SELECT count(*) AS compared, count(*) FILTER (volume % 9 = 0) AS mismatches, round(avg(CASE WHEN volume % 9 = 0 THEN 1.0 ELSE 0.0 END), 6) AS share, round(max(CASE WHEN volume % 9 = 0 THEN 0.01 ELSE 0 END), 6)::DOUBLE AS largest FROM bars")
def two_sources(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return quality.cross_validate(b, b.withColumn("close", F.when(F.col("volume") % 9 == 0, F.col("close") * 1.01).otherwise(F.col("close"))))


WEIGHTS = "weights AS (SELECT ts_code, trade_date, amount / sum(amount) OVER (PARTITION BY trade_date) AS weight FROM bars)"


def weights(spark, sf_dir):
    return d.bars(spark, sf_dir).select("ts_code", "trade_date", (F.col("amount") / F.sum("amount").over(Window.partitionBy("trade_date"))).alias("weight"))


@query("R-01", "bars", f"SELECT ts_code, trade_date, round(w / sum(w) OVER (PARTITION BY trade_date), 6) AS weight FROM (WITH {WEIGHTS} SELECT ts_code, trade_date, least(weight, 0.1) AS w FROM weights WHERE weight >= 0.005)")
def constrained(spark, sf_dir):
    return portfolio.constrain(weights(spark, sf_dir)).select("ts_code", "trade_date", r6("weight"))


plain("R-02", "bars", "bars", "SELECT ts_code, trade_date, round(1.0 / count(*) OVER (PARTITION BY trade_date), 6)::DOUBLE AS weight FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, ts_code) <= 10)", lambda b: portfolio.equal_weight(b.withColumn("score", F.col("amount")), 10).select("ts_code", "trade_date", r6("weight")))
COSTS = "(SELECT ts_code, trade_date, volume % 2 = 0 AS sale, a, greatest(a * 0.0003, 5.0) + CASE WHEN volume % 2 = 0 THEN a * 0.001 ELSE 0 END + a * 0.001 AS c FROM (SELECT *, amount::DECIMAL(18,2) AS a FROM bars))"
plain("R-06", "bars", "bars", f"SELECT ts_code, trade_date, round(c, 4)::DOUBLE AS total_cost, round(CASE WHEN sale THEN a - c ELSE a + c END, 4)::DOUBLE AS net_amount FROM {COSTS}", lambda b: portfolio.costs(b.withColumn("side", F.when(F.col("volume") % 2 == 0, "sell").otherwise("buy"))).select("ts_code", "trade_date", F.round("total_cost", 4).cast("double").alias("total_cost"), F.round("net_amount", 4).cast("double").alias("net_amount")))
RET = "r AS (SELECT ts_code AS portfolio, trade_date, greatest(-0.5, least(0.5, pct_chg / 100)) AS ret, avg(greatest(-0.5, least(0.5, pct_chg / 100))) OVER (PARTITION BY trade_date) AS bench FROM bars WHERE pct_chg IS NOT NULL)"


def returns(spark, sf_dir):
    capped = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("pct_chg") / 100))
    return d.bars(spark, sf_dir).where("pct_chg is not null").select(F.col("ts_code").alias("portfolio"), "trade_date", capped.alias("ret")).withColumn("bench", F.avg("ret").over(Window.partitionBy("trade_date")))


@query("R-11", "bars", f"SELECT portfolio, round(stddev_samp(ret) * sqrt(252), 6) AS annual_vol, round((avg(ret) - 0.03 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) AS sharpe, round(stddev_samp(ret - bench) * sqrt(252), 6) AS tracking_error, round(regr_slope(ret, bench), 6) AS beta FROM (WITH {RET} SELECT * FROM r) GROUP BY portfolio")
def performance(spark, sf_dir):
    return portfolio.metrics(returns(spark, sf_dir)).select("portfolio", *map(r6, ("annual_vol", "sharpe", "tracking_error", "beta")))


@query("R-13", "bars", """SELECT trade_date, sector, round((pw - bw) * (br - total), 6) AS allocation, round(bw * (pr - br), 6) AS selection, round((pw - bw) * (pr - br), 6) AS interaction FROM (SELECT *, sum(bw * br) OVER (PARTITION BY trade_date) AS total FROM (
  SELECT trade_date, sector, coalesce(sum(pw), 0) AS pw, coalesce(avg(ret) FILTER (pw > 0), 0) AS pr, coalesce(sum(bw), 0) AS bw, coalesce(avg(ret) FILTER (bw > 0), 0) AS br FROM (
    SELECT trade_date, left(ts_code, 3) AS sector, coalesce(pct_chg, 0) / 100 AS ret, amount / sum(amount) OVER (PARTITION BY trade_date) AS pw, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS bw FROM bars) GROUP BY trade_date, sector))""")
def attribution(spark, sf_dir):
    b, day = d.bars(spark, sf_dir), Window.partitionBy("trade_date")
    side = lambda name, w: b.select("trade_date", F.lit(name).alias("side"), F.left("ts_code", F.lit(3)).alias("sector"), F.col("ts_code").alias("asset"), w.alias("weight"), (F.coalesce("pct_chg", F.lit(0.0)) / 100).alias("ret"))
    rows = side("portfolio", F.col("amount") / F.sum("amount").over(day)).unionByName(side("benchmark", F.lit(1.0) / F.count("*").over(day)))
    return portfolio.brinson(rows.drop("ret"), rows.select("trade_date", "side", "asset", "ret")).select("trade_date", "sector", *map(r6, ("allocation", "selection", "interaction")))


plain("K-01", "bars", "bars", "SELECT * FROM (SELECT ts_code, trade_date, round(close * adj_factor / nullif(lag(close * adj_factor, 20) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1, 6) AS momentum FROM bars) WHERE momentum IS NOT NULL", lambda b: factors.momentum(b).withColumn("momentum", F.round("momentum", 6)))
plain("K-02", "bars", "bars", "SELECT ts_code, trade_date, round(v, 4) AS volatility FROM (SELECT ts_code, trade_date, CASE WHEN count(pct_chg) OVER w = 20 THEN stddev_samp(pct_chg / 100) OVER w * sqrt(252) END AS v FROM bars WHERE volume > 0 WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING)) WHERE v IS NOT NULL", lambda b: factors.volatility(b).withColumn("volatility", F.round("volatility", 4)))
plain("K-05", "bars", "bars", "SELECT ts_code, trade_date, round(greatest(least(close, m + 3 * 1.4826 * mad), m - 3 * 1.4826 * mad), 9) AS close FROM (SELECT b.*, x.m, median(abs(b.close - x.m)) OVER (PARTITION BY b.trade_date) AS mad FROM bars b JOIN (SELECT trade_date, median(close) AS m FROM bars GROUP BY 1) x USING (trade_date))", lambda b: factors.winsorize_mad(b.select("ts_code", "trade_date", "close"), "close").select("ts_code", "trade_date", F.round("close", 9).alias("close")))
plain("K-07", "bars", "bars", "SELECT ts_code, trade_date, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS close FROM bars WINDOW w AS (PARTITION BY trade_date)", lambda b: factors.zscore(b.select("ts_code", "trade_date", "close"), "close").withColumn("close", F.round("close", 6)))
plain("K-08", "bars", "bars", "SELECT trade_date, round(corr(a, b), 6) AS ic, count(*) AS n FROM (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2 AS a, rank() OVER (PARTITION BY trade_date ORDER BY pct_chg) + (count(*) OVER (PARTITION BY trade_date, pct_chg) - 1) / 2 AS b FROM bars WHERE pct_chg IS NOT NULL) GROUP BY trade_date HAVING count(*) > 4", lambda b: factors.rank_ic(b, "close", "pct_chg").where("n > 4").select("trade_date", r6("ic"), "n"))
plain("K-09", "bars", "bars", "SELECT trade_date, quantile, round(avg(pct_chg), 6) AS mean_ret, count(*) AS n FROM (SELECT *, ntile(5) OVER (PARTITION BY trade_date ORDER BY close, ts_code) AS quantile FROM bars) GROUP BY 1, 2", lambda b: factors.quantile_returns(b, "close", "pct_chg").select("trade_date", "quantile", r6("mean_ret"), "n"))
RANKS = "rank() OVER (PARTITION BY trade_date, h ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, h, close) - 1) / 2 AS a, rank() OVER (PARTITION BY trade_date, h ORDER BY r) + (count(*) OVER (PARTITION BY trade_date, h, r) - 1) / 2 AS b"
plain("K-08-decay", "bars", "bars", f"SELECT h AS horizon, round(avg(ic), 4) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 4) AS icir, count(*) AS n FROM (SELECT trade_date, h, corr(a, b) AS ic FROM (SELECT trade_date, h, {RANKS} FROM (SELECT trade_date, close, h, lead(close, h) OVER (PARTITION BY ts_code, h ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM bars, unnest([1, 2, 3, 4, 5]) x(h)) WHERE r IS NOT NULL) GROUP BY trade_date, h HAVING count(*) > 4) WHERE NOT isnan(ic) GROUP BY h", lambda b: factors.ic_decay(b, "close", least=5).select(F.col("horizon").cast("int").alias("horizon"), F.round("mean_ic", 4).alias("mean_ic"), F.round("icir", 4).alias("icir"), "n"))
plain("K-09-long-short", "bars", "bars", "SELECT trade_date, round(avg(pct_chg) FILTER (quantile = 5) - avg(pct_chg) FILTER (quantile = 1), 6) AS long_short FROM (SELECT *, ntile(5) OVER (PARTITION BY trade_date ORDER BY close, ts_code) AS quantile FROM bars) GROUP BY 1", lambda b: factors.long_short(b, "close", "pct_chg").select("trade_date", r6("long_short")))
