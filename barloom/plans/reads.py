"""Queries of scans, joins, aggregates, orders and set operations on bars and versions (P, J, A, W, L, U, X)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import asof, lifetimes, merge, storage, windows
from barloom.plans.catalog import at, bar, plain, query, r6
from barloom.plans.lifetimes import ENDS, KEY, LATEST, LOG, ends, last_versions, log
from barloom.sources import adapters, fields
from barloom.sources import derived as d
from barloom.sources.derived import read

KEYS = ["ts_code", "trade_date"]
W = "(PARTITION BY ts_code ORDER BY trade_date)"


def cents(price):
    """Two decimals, rounded by the number itself as in C; %.2f of Java rounds its shortest text, so 24.615 (a little less) would go up."""
    return F.call_function("format_number", price, F.lit("0.00"))


# The last usable day of a key: its progress day, or the calendar day before it, if the bar there has a price and volume.
plain("P-06", "bars", "bars", "SELECT k.ts_code, max(b.trade_date) FILTER (b.close > 0 AND b.volume >= 0 AND b.trade_date BETWEEN k.m - 1 AND k.m) AS last_day FROM (SELECT ts_code, max(trade_date) AS m FROM bars GROUP BY 1) k JOIN bars b USING (ts_code) GROUP BY k.ts_code", lambda b: windows.last_usable(b))
plain("P-07", "bars", "bars", "SELECT k.ts_code, coalesce(CASE WHEN k.ts_code LIKE '6%' THEN DATE '2005-01-01' END, max(trade_date)) AS last_day FROM bars k GROUP BY 1", lambda b: windows.last_days(b, b.where(F.startswith("ts_code", F.lit("6"))).select("ts_code").distinct().withColumn("last_sync_date", at("2005-01-01"))))
plain("P-19", "bars", "bars", "SELECT ts_code, trade_date, close AS raw_close, round(close * adj_factor, 6) AS adj_close FROM bars", lambda b: b.select(*KEYS, F.col("close").alias("raw_close")).join(b.select(*KEYS, F.round(F.col("close") * F.col("adj_factor"), 6).alias("adj_close")), KEYS, "left"))
plain("P-20", "history", "history", "SELECT ts_code, eff_date FROM history WHERE board LIKE '%URGENT%'", lambda h: h.where(F.contains("board", F.lit("URGENT"))).select("ts_code", "eff_date"))
plain("P-21", "history", "history", f"WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (delist_date IS NULL) AS active, count(*) FILTER (delist_date IS NOT NULL) AS delisted FROM latest", lambda h: last_versions(h).agg(F.count("*").alias("total"), F.count_if(F.col("delist_date").isNull()).alias("active"), F.count_if(F.col("delist_date").isNotNull()).alias("delisted")))
plain("P-22", "bars", "bars", "SELECT ts_code, trade_date FROM bars WHERE right(ts_code, 2) IN ('SH', 'BJ')", lambda b: b.where(F.right("ts_code", F.lit(2)).isin("SH", "BJ")).select(KEYS))


@query("P-23", "bars calendar dates", "SELECT t, ts_code, trade_date, amount FROM (SELECT t, (SELECT max(cal_date) FROM calendar WHERE is_trading_day AND cal_date < t) AS before FROM dates) JOIN bars ON trade_date BETWEEN before - 6 AND before")
def market_value(spark, sf_dir):
    from barloom.plans.books import bars_of_week_before

    return bars_of_week_before(spark, sf_dir).select("t", *KEYS, "amount")


plain("P-25", "bars", "bars", f"WITH {ENDS} SELECT b.ts_code, b.trade_date, b.close FROM bars b JOIN ends e ON b.ts_code = e.ts_code AND b.trade_date <= least(DATE '2001-06-30', delist_date) AND b.trade_date >= '1998-01-01'", lambda b: b.join(ends(b), "ts_code").where((F.col("trade_date") >= at("1998-01-01")) & (F.col("trade_date") <= F.least(at("2001-06-30"), F.col("delist_date")))).select(*KEYS, "close"))

plain("J-01", "bars", "bars", "SELECT ts_code, trade_date, close FROM bars WHERE ts_code IN (SELECT ts_code FROM bars GROUP BY 1 HAVING sum(volume) % 2 = 0)", lambda b: b.join(b.groupBy("ts_code").agg(F.sum("volume").alias("v")).where("v % 2 = 0"), "ts_code", "left_semi").select(*KEYS, "close"))
plain("J-02", "history", "history", "SELECT h.ts_code, h.eff_date, h.status FROM history h JOIN (SELECT ts_code, max(eff_date) AS m FROM history GROUP BY 1) x ON x.ts_code = h.ts_code AND x.m = h.eff_date", lambda h: last_versions(h).select("ts_code", "eff_date", "status"))
plain("J-03", "bars", "bars", "SELECT a.ts_code, a.trade_date, a.close, b.close AS other FROM bars a LEFT JOIN (SELECT * FROM bars WHERE volume % 3 = 0) b USING (ts_code, trade_date)", lambda b: b.select(*KEYS, "close").join(b.where("volume % 3 = 0").select(*KEYS, F.col("close").alias("other")), KEYS, "left"))
plain("J-04", "bars", "bars", "SELECT a.ts_code, a.trade_date, a.close FROM bars a JOIN (SELECT * FROM bars WHERE volume % 3 = 0) b USING (ts_code, trade_date) WHERE a.volume % 2 = 0", lambda b: b.where("volume % 2 = 0").select(*KEYS, "close").join(b.where("volume % 3 = 0").select(KEYS), KEYS))
plain("J-09", "history", "history", "SELECT ts_code, eff_date FROM history WHERE ts_code IN (SELECT ts_code FROM history WHERE status = 'P')", lambda h: h.join(h.where("status = 'P'").select("ts_code"), "ts_code", "left_semi").select("ts_code", "eff_date"))
plain("J-13", "bars", "bars", "SELECT a.ts_code, a.trade_date, a.close AS close_a, round(b.close + 1, 6) AS close_b FROM bars a JOIN bars b USING (ts_code, trade_date)", lambda b: b.select(*KEYS, F.col("close").alias("close_a")).join(b.select(*KEYS, F.round(F.col("close") + 1, 6).alias("close_b")), KEYS))
plain("J-14", "bars", "bars", "SELECT ts_code, trade_date, CASE WHEN volume % 4 = 0 THEN 1.0 ELSE round(adj_factor, 6) END AS factor FROM bars", lambda b: b.select(*KEYS, "close").join(b.where("volume % 4 != 0").select(*KEYS, (F.col("close") * F.col("adj_factor")).alias("q")), KEYS, "left").select(*KEYS, F.round(fields.finite(F.try_divide("q", "close")), 6).alias("factor")))
plain("J-15", "history", "history", f"WITH {LATEST} SELECT DISTINCT h.ts_code, l.board FROM history h JOIN latest l USING (ts_code) WHERE h.eff_date BETWEEN '1998-01-01' AND '1998-01-31' AND h.status = 'P'", lambda h: h.where(F.col("eff_date").between(at("1998-01-01"), at("1998-01-31")) & (F.col("status") == "P")).select("ts_code").distinct().join(last_versions(h).select("ts_code", "board"), "ts_code"))
plain("J-18", "history", "history", f"WITH {LATEST} SELECT h.ts_code, h.eff_date, l.list_date, l.delist_date FROM history h LEFT JOIN latest l USING (ts_code)", lambda h: h.select("ts_code", "eff_date").join(last_versions(h).select("ts_code", "list_date", "delist_date"), "ts_code", "left"))
plain("J-21", "bars", "bars", "SELECT a.trade_date, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.trade_date = b.trade_date WHERE a.ts_code = '688001.SH' AND b.ts_code = '000002.SZ'", lambda b: b.where("ts_code = '688001.SH'").select("trade_date", F.col("close").alias("a")).join(b.where("ts_code = '000002.SZ'").select("trade_date", F.col("close").alias("b")), "trade_date"))
plain("J-22", "bars", "bars", "SELECT sector, coalesce(x.n, 0) AS n_odd, coalesce(y.n, 0) AS n_large FROM (SELECT left(ts_code, 3) AS sector, count(*) AS n FROM bars WHERE volume % 2 = 1 GROUP BY 1) x FULL JOIN (SELECT left(ts_code, 3) AS sector, count(*) AS n FROM bars WHERE volume > 150 GROUP BY 1) y USING (sector)", lambda b: b.where("volume % 2 = 1").groupBy(F.left("ts_code", F.lit(3)).alias("sector")).agg(F.count("*").alias("n_odd")).join(b.where("volume > 150").groupBy(F.left("ts_code", F.lit(3)).alias("sector")).agg(F.count("*").alias("n_large")), "sector", "full_outer").fillna(0))

plain("A-02", "bars", "bars", "SELECT ts_code, max(trade_date) AS last_day FROM bars GROUP BY 1", lambda b: b.groupBy("ts_code").agg(F.max("trade_date").alias("last_day")))
plain("A-03", "bars", "bars", "SELECT ts_code, max(trade_date) AS last_day, count(*) AS n FROM bars GROUP BY 1", lambda b: b.groupBy("ts_code").agg(F.max("trade_date").alias("last_day"), F.count("*").alias("n")))
plain("A-05", "bars", "bars", "SELECT year(trade_date)::BIGINT AS year, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars GROUP BY 1", lambda b: b.groupBy(F.year("trade_date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")))
plain("A-07", "fundamentals", "fundamentals", "SELECT ts_code, arg_max(roe, (ann_date, end_date, report)) FILTER (roe IS NOT NULL) AS roe, arg_max(revenue, (ann_date, end_date, report)) AS revenue FROM fundamentals GROUP BY 1", lambda f: f.groupBy("ts_code").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ann_date", "end_date", "report"))).alias(c) for c in ("roe", "revenue")]))
plain("A-13", "bars", "bars", "SELECT count(*) AS n, count(*) FILTER (abs(close - open) > open * 0.05) AS mismatches, round(avg(CASE WHEN abs(close - open) > open * 0.05 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share, round(max(abs(close - open)), 6) AS largest FROM bars", lambda b: b.withColumn("x", F.abs(F.col("close") - F.col("open")) > F.col("open") * 0.05).agg(F.count("*").alias("n"), F.count_if("x").alias("mismatches"), F.round(F.avg(F.col("x").cast("double")), 6).alias("share"), F.round(F.max(F.abs(F.col("close") - F.col("open"))), 6).alias("largest")))
plain("A-14", "history", "history", f"WITH {LATEST} SELECT ts_code, board FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY md5(ts_code), ts_code) AS rn, count(*) OVER (PARTITION BY board) AS n FROM latest) WHERE rn <= greatest(1, least(n, n // 10 + 1))", lambda h: windows.stratified(last_versions(h), "board", "ts_code").select("ts_code", "board"))
plain("A-15", "bars", "bars", "SELECT ts_code, trade_date FROM bars WHERE md5(ts_code || trade_date) < '0ccccccccccccccccccccccccccccccc' OR md5(ts_code || trade_date) = (SELECT min(md5(ts_code || trade_date)) FROM bars)", lambda b: windows.sampled(b, 0.05, *KEYS).select(KEYS))
plain("A-16", "bars", "bars", "SELECT ts_code, count(*) AS n, printf('%.2f~%.2f', min(low), max(high)) AS price_range FROM bars GROUP BY 1", lambda b: b.groupBy("ts_code").agg(F.count("*").alias("n"), F.concat(cents(F.min("low")), F.lit("~"), cents(F.max("high"))).alias("price_range")))

plain("W-04", "bars", "bars", f"SELECT ts_code, trade_date, row_number() OVER {W} AS rn FROM bars", lambda b: b.select(*KEYS, F.row_number().over(windows.by()).cast("long").alias("rn")))


@query("W-07", "dates", f"WITH {LOG} SELECT event_id, user_id, event_type, version FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC) = 1")
def newest_version(spark, sf_dir):
    return windows.latest(log(spark, sf_dir), KEY, F.col("version").desc()).select("event_id", *KEY, "version")


@query("W-08", "dates", f"WITH {LOG} SELECT event_id, user_id, event_type, version FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY effective_at DESC, version DESC) = 1")
def newest_effective(spark, sf_dir):
    return windows.latest(log(spark, sf_dir), KEY, F.col("effective_at").desc(), F.col("version").desc()).select("event_id", *KEY, "version")


plain("W-09", "bars", "bars", f"SELECT ts_code, trade_date, lag(close) OVER {W} AS close_before, lag(volume) OVER {W} AS volume_before FROM bars", lambda b: b.select(*KEYS, F.lag("close").over(windows.by()).alias("close_before"), F.lag("volume").over(windows.by()).alias("volume_before")))
plain("W-12", "bars", "bars", """SELECT ts_code, trade_date, round(CASE WHEN x IS NOT NULL THEN x WHEN rn - i <= 10 THEN a + (b - a) * (rn - i) / (j - i) END, 6) AS x FROM (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS i, last_value(x IGNORE NULLS) OVER w AS a, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER v AS j, first_value(x IGNORE NULLS) OVER v AS b FROM (
    SELECT ts_code, trade_date, CASE WHEN volume % 3 <> 0 THEN close END AS x, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn FROM bars)
  WINDOW w AS (PARTITION BY ts_code ORDER BY rn), v AS (PARTITION BY ts_code ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", lambda b: windows.interpolate(b.select(*KEYS, F.when(F.col("volume") % 3 != 0, F.col("close")).alias("x")), "x").withColumn("x", F.round("x", 6)))
plain("W-19", "bars", "bars", "SELECT ts_code, trade_date, close FROM bars WHERE trade_date <= '1999-06-30' AND trade_date > DATE '1999-06-30' - 280 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 20", lambda b: windows.trailing(b, "1999-06-30", 20, step=7).select(*KEYS, "close"))
plain("L-01", "bars", "bars", "SELECT ts_code, trade_date, close FROM bars", lambda b: b.select(*KEYS, "close").orderBy(*KEYS))
plain("L-02", "bars", "bars", "SELECT ts_code, max(trade_date) AS last_day, arg_max(close, trade_date) AS close FROM bars GROUP BY 1", lambda b: b.groupBy("ts_code").agg(F.max("trade_date").alias("last_day"), F.max_by("close", "trade_date").alias("close")))
plain("L-03", "bars", "bars", "SELECT ts_code, trade_date, pct_chg FROM bars WHERE abs(pct_chg) > 20 ORDER BY trade_date DESC, ts_code LIMIT 100", lambda b: b.where(F.abs("pct_chg") > 20).select(*KEYS, "pct_chg").orderBy(F.col("trade_date").desc(), "ts_code").limit(100))
plain("L-04", "bars", "bars", "SELECT ts_code, trade_date FROM bars WHERE abs(pct_chg) > 20 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) <= 10", lambda b: b.where(F.abs("pct_chg") > 20).select(KEYS).withColumn("rn", F.row_number().over(windows.by())).where("rn <= 10").drop("rn"))


@query("L-06", "history dates", f"WITH {LATEST} SELECT t, ts_code, (delist_date - t)::BIGINT AS days_remaining FROM latest JOIN dates ON delist_date - t BETWEEN 0 AND 60")
def by_days_left(spark, sf_dir):
    found = lifetimes.warnings(last_versions(d.history(spark, sf_dir)), d.dates(spark, sf_dir), 60)
    return found.select("t", "ts_code", F.col("days_remaining").cast("long").alias("days_remaining")).orderBy("days_remaining", "t", "ts_code")


plain("U-01", "bars", "bars", "SELECT 'odd' AS kind, ts_code, trade_date FROM bars WHERE volume % 2 = 1 UNION ALL SELECT 'large', ts_code, trade_date FROM bars WHERE volume > 150", lambda b: b.where("volume % 2 = 1").select(F.lit("odd").alias("kind"), *KEYS).unionByName(b.where("volume > 150").select(F.lit("large").alias("kind"), *KEYS)))
plain("U-02", "bars", "bars", "SELECT ts_code, trade_date, close, CASE WHEN volume % 2 = 1 THEN volume END AS volume FROM bars", lambda b: b.where("volume % 2 = 1").select(*KEYS, "close", "volume").unionByName(b.where("volume % 2 = 0").select(*KEYS, "close"), allowMissingColumns=True))
plain("U-03", "bars", "bars", "SELECT ts_code, trade_date, CASE WHEN volume % 2 = 0 THEN 0.0 ELSE close END AS close FROM bars", lambda b: merge.keep_last([b.select(*KEYS, "close"), b.where("volume % 2 = 0").select(*KEYS, F.lit(0.0).alias("close"))], KEYS))
plain("U-04", "bars", "bars", "SELECT ts_code, trade_date FROM bars EXCEPT SELECT ts_code, trade_date FROM bars WHERE volume % 3 = 0", lambda b: b.select(KEYS).join(b.where("volume % 3 = 0").select(KEYS), KEYS, "left_anti"))
plain("U-05", "bars", "bars", "SELECT ts_code, len(list_intersect(list_distinct(string_split(ts_code, '')), list_distinct(string_split('600010.SZ', ''))))::BIGINT AS shared, len(list_distinct(list_concat(string_split(ts_code, ''), string_split('600010.SZ', ''))))::BIGINT AS together FROM (SELECT DISTINCT ts_code FROM bars)", lambda b: b.select("ts_code").distinct().select("ts_code", F.size(F.array_intersect(F.split("ts_code", ""), F.split(F.lit("600010.SZ"), ""))).cast("long").alias("shared"), F.size(F.array_union(F.split("ts_code", ""), F.split(F.lit("600010.SZ"), ""))).cast("long").alias("together")))


def stored_bars(path: str, prefix: str):
    """fetch of a vendor who knows the codes of a prefix, served from Parquet files."""

    def fetch(first, last):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        day = ds.field("trade_date")
        known = (day >= first) & (day <= last) & pc.starts_with(ds.field("ts_code"), prefix)
        yield from ds.dataset(path.removeprefix("file:"), format="parquet").to_batches(columns=[*KEYS, "close"], filter=known)

    return fetch


@query("X-03", "bars", "SELECT ts_code, trade_date, close, CASE WHEN ts_code LIKE '6%' THEN 0 ELSE 1 END AS priority FROM bars WHERE trade_date BETWEEN '1997-01-01' AND '1997-12-31'")
def sources_in_order(spark, sf_dir):
    """Two registered sources; the first one that knows a code serves it, and both are asked for the range only."""
    path = storage.shared_folder(spark, "vendor")
    d.bars(spark, sf_dir).select(*KEYS, "close").write.parquet(path)
    for name, prefix in (("barloom_main", "6"), ("barloom_all", "")):
        adapters.register(spark, name, stored_bars(path, prefix), "ts_code string, trade_date date, close double", date(1990, 1, 1), date(2030, 12, 31))
    asked = [spark.read.format(name).load().where(F.col("trade_date").between(at("1997-01-01"), at("1997-12-31"))) for name in ("barloom_main", "barloom_all")]
    return merge.first_source(asked, "ts_code")


@query("X-04", "bars", "SELECT ts_code, count(*) AS n FROM bars WHERE volume > 50 GROUP BY ts_code")
def passthrough(spark, sf_dir):
    """SQL with parameters over a table that is given as a DataFrame."""
    return spark.sql("SELECT ts_code, count(*) AS n FROM {bars} WHERE volume > :least GROUP BY ts_code", args={"least": 50}, bars=d.bars(spark, sf_dir))
