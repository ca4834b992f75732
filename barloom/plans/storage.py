"""Queries of layouts, merges and logs (S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import merge, quality, storage, windows
from barloom.plans.catalog import BAR, at, bar, plain, query
from barloom.plans.lifetimes import LATEST, last_versions
from barloom.sources import derived as d

YEARLY = "SELECT ts_code, trade_date, close, year(trade_date)::BIGINT AS year FROM bars"


def yearly(b):
    return b.select("ts_code", "trade_date", "close", F.year("trade_date").alias("year"))


@query("S-06", "bars", f"SELECT {BAR} FROM bars")
def exported(spark, sf_dir):
    path = storage.export(d.bars(spark, sf_dir).select(bar), "bars", storage.shared_folder(spark, "export"))
    return spark.read.parquet(path)


@query("S-07", "bars", "SELECT ts_code, trade_date, close, year(trade_date)::BIGINT AS year FROM bars WHERE year(trade_date) <> 1997 UNION ALL SELECT ts_code, trade_date, 0, 1997 FROM bars WHERE year(trade_date) = 1997")
def skipped_existing(spark, sf_dir):
    """1997 is there first, with other prices, so the second write leaves it alone."""
    path, rows = storage.shared_folder(spark, "by-key"), yearly(d.bars(spark, sf_dir))
    storage.write_new_partitions(rows.where("year = 1997").withColumn("close", F.lit(0.0)), path, "year")
    storage.write_new_partitions(rows, path, "year", spark.read.parquet(path))
    return spark.read.parquet(path).select("ts_code", "trade_date", "close", F.col("year").cast("long").alias("year"))


@query("S-08", "bars", "SELECT ts_code, trade_date, CASE WHEN year(trade_date) = 1998 AND volume % 2 = 0 THEN close * 2 ELSE close END AS close FROM bars")
def incremental(spark, sf_dir):
    path, rows = storage.shared_folder(spark, "incremental"), d.bars(spark, sf_dir).select("ts_code", "trade_date", "close", "volume", F.year("trade_date").alias("year"))
    rows.repartition("year").write.partitionBy("year").parquet(path)
    storage.write_incremental(spark, rows.where("year = 1998 and volume % 2 = 0").withColumn("close", F.col("close") * 2), path, "year", ["ts_code", "trade_date"])
    return spark.read.parquet(path).select("ts_code", "trade_date", "close")


@query("S-09", "bars", f"SELECT * FROM ({YEARLY}) WHERE year BETWEEN 1996 AND 2000")
def archived(spark, sf_dir):
    path = storage.shared_folder(spark, "archive")
    storage.archive(d.bars(spark, sf_dir).select("ts_code", "trade_date", "close"), path, "2001-06-01")
    return spark.read.parquet(path).select("ts_code", "trade_date", "close", F.col("year").cast("long").alias("year"))


@query("S-11", "bars", YEARLY)
def compacted(spark, sf_dir):
    """Years up to 1996 are cold; each has five files, which become one."""
    path = storage.shared_folder(spark, "loose")
    yearly(d.bars(spark, sf_dir)).repartition(5).write.partitionBy("year").parquet(path)
    storage.compact_cold(spark, path, "year", F.col("part").cast("int") <= 1996, least=1000)
    return spark.read.parquet(path).select("ts_code", "trade_date", "close", F.col("year").cast("long").alias("year"))


@query("S-11-files", "bars", "SELECT year(trade_date)::VARCHAR AS part, CASE WHEN year(trade_date) <= 1996 THEN 1 ELSE least(count(*), 5) END AS files FROM bars GROUP BY 1, year(trade_date)")
def compacted_files(spark, sf_dir):
    path = storage.shared_folder(spark, "loose")
    rows = yearly(d.bars(spark, sf_dir)).withColumn("_deal", F.row_number().over(Window.partitionBy("year").orderBy("ts_code", "trade_date")) % 5)
    for k in range(5):
        rows.where(F.col("_deal") == k).drop("_deal").repartition(1, "year").write.mode("append").partitionBy("year").parquet(path)
    storage.compact_cold(spark, path, "year", F.col("part").cast("int") <= 1996, least=1)
    return storage.listed(spark, path, "year").groupBy("part").agg(F.count("*").alias("files"))


@query("S-12-range", "bars", "SELECT ts_code, trade_date, close FROM bars WHERE NOT year(trade_date) = 1998 OR volume % 2 = 0 OR trade_date < (SELECT min(x.trade_date) FROM bars x WHERE x.ts_code = bars.ts_code AND year(x.trade_date) = 1998 AND x.volume % 2 = 0) OR trade_date > (SELECT max(x.trade_date) FROM bars x WHERE x.ts_code = bars.ts_code AND year(x.trade_date) = 1998 AND x.volume % 2 = 0)")
def overwritten(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close", "volume")
    return merge.overwrite_range(b, b.where("year(trade_date) = 1998 and volume % 2 = 0"), "ts_code", "trade_date").drop("volume")


@query("S-13", "fundamentals", "SELECT report, CASE WHEN report % 3 = 0 THEN revenue * 2 ELSE revenue END AS revenue FROM fundamentals")
def fundamentals_upserted(spark, sf_dir):
    f = d.fundamentals(spark, sf_dir).select("report", "revenue")
    return merge.upsert(f, f.where("report % 3 = 0").withColumn("revenue", F.col("revenue") * 2), ["report"])


@query("S-14", "history", f"WITH {LATEST} SELECT ts_code, eff_date, status FROM history WHERE NOT (eff_date = '1999-06-30' AND ts_code IN (SELECT ts_code FROM latest)) UNION ALL SELECT ts_code, DATE '1999-06-30', status FROM latest")
def snapshot(spark, sf_dir):
    h = d.history(spark, sf_dir).select("ts_code", "eff_date", "status")
    return storage.snapshot_upsert(h, last_versions(h), at("1999-06-30"))


plain("S-15", "history", "history", f"WITH {LATEST} SELECT ts_code, DATE '2000-01-01' AS status_date, coalesce(delist_date <= '2000-01-01', false) AS delisted, NOT coalesce(delist_date <= '2000-01-01', false) AS tradable FROM latest", lambda h: storage.status_snapshot(last_versions(h), at("2000-01-01")))


@query("S-17", "bars", "SELECT alert_type, ts_code, trade_date FROM (SELECT 'pct_chg_extreme' AS alert_type, ts_code, trade_date FROM bars WHERE abs(pct_chg) > 60 UNION ALL SELECT 'zero_volume_non_suspend', ts_code, trade_date FROM bars WHERE volume = 0 AND NOT is_suspend)")
def alert_log(spark, sf_dir):
    path, b = storage.shared_folder(spark, "alerts"), d.bars(spark, sf_dir)
    for name in ("pct_chg_extreme", "zero_volume_non_suspend"):
        quality.run(b, [name]).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("detail")


@query("S-18", "history", "SELECT ts_code, count(*) AS n, max(eff_date) AS last_day FROM history GROUP BY ts_code")
def lifetimes_json(spark, sf_dir):
    from barloom.operators import lifetimes

    path, rows = storage.shared_folder(spark, "lifetimes"), lifetimes.nested(d.history(spark, sf_dir))
    storage.write_json(rows, path)
    back = storage.read_json(spark, path, rows.schema)
    return back.select("ts_code", F.size("events").cast("long").alias("n"), F.element_at("events", -1)["day"].alias("last_day"))


@query("S-19", "bars", "SELECT 'pct_chg_extreme' AS alert_type, count(*) AS n, count(DISTINCT ts_code) AS keys FROM bars WHERE abs(pct_chg) > 60 HAVING count(*) > 0")
def report(spark, sf_dir):
    path, rows = storage.shared_folder(spark, "report"), quality.summary(quality.run(d.bars(spark, sf_dir), ["pct_chg_extreme"]))
    storage.write_json(rows, path)
    return storage.read_json(spark, path, rows.schema)


@query("S-20", "calendar", "SELECT cal_date, is_trading_day FROM calendar")
def calendar_loaded(spark, sf_dir):
    path = storage.export(d.calendar(spark, sf_dir).select("cal_date", "is_trading_day"), "calendar", storage.shared_folder(spark, "calendar"))
    return spark.read.parquet(path)


plain("S-23", "bars", "bars", "SELECT ts_code, trade_date, round(open * adj_factor, 6) AS open, round(high * adj_factor, 6) AS high, round(low * adj_factor, 6) AS low, round(close * adj_factor, 6) AS close, close AS raw_close FROM bars", lambda b: b.select("ts_code", "trade_date", *[F.round(F.col(c) * F.col("adj_factor"), 6).alias(c) for c in ("open", "high", "low", "close")], F.col("close").alias("raw_close")))
plain("S-24", "history", "history", f"WITH {LATEST} SELECT ts_code, eff_date, status FROM latest WHERE delist_date IS NULL", lambda h: last_versions(h).where("delist_date is null").select("ts_code", "eff_date", "status"))
plain("S-25-delete", "bars", "bars", "SELECT ts_code, trade_date FROM bars WHERE NOT (ts_code = '600000.SH' OR ts_code = '000002.SZ' AND trade_date BETWEEN '1997-01-01' AND '1997-12-31')", lambda b: storage.delete(storage.delete(b, ["600000.SH"]), ["000002.SZ"], first="1997-01-01", last="1997-12-31").select("ts_code", "trade_date"))
ADJUSTED = "adjusted AS (SELECT ts_code, trade_date, close * adj_factor * CASE WHEN volume % 13 = 0 THEN 1.05 ELSE 1.0 END AS adj_close FROM bars WHERE volume % 17 <> 0)"


@query("S-26", "bars", f"WITH {ADJUSTED} SELECT b.ts_code, b.trade_date, close AS raw_close, round(adj_close, 6) AS adj_close, coalesce(abs(adj_close - close * adj_factor) < 0.01, false) AS consistent FROM bars b LEFT JOIN adjusted a USING (ts_code, trade_date)")
def self_check(spark, sf_dir):
    """Raw bars beside a table of adjusted ones, some of which are wrong and some missing."""
    b = d.bars(spark, sf_dir)
    wrong = F.when(F.col("volume") % 13 == 0, 1.05).otherwise(1.0)
    adjusted = b.where("volume % 17 != 0").select("ts_code", "trade_date", (F.col("close") * F.col("adj_factor") * wrong).alias("adj_close"))
    both = b.join(adjusted, ["ts_code", "trade_date"], "left")
    ok = F.coalesce(F.abs(F.col("adj_close") - F.col("close") * F.col("adj_factor")) < 0.01, F.lit(False))
    return both.select("ts_code", "trade_date", F.col("close").alias("raw_close"), F.round("adj_close", 6).alias("adj_close"), ok.alias("consistent"))


@query("S-27", "bars", "SELECT ts_code, trade_date, CASE WHEN volume % 4 = 0 THEN close + 1 ELSE close END AS close FROM bars")
def golden(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("ts_code", "trade_date", "close", "volume")
    return merge.keep_last([b, b.where("volume % 4 = 0").withColumn("close", F.col("close") + 1)], ["ts_code", "trade_date"]).drop("volume")


@query("S-13-factors", "fundamentals", "SELECT ts_code, end_date, roe, CASE WHEN revenue / 50000 > 1 THEN round(1 - 1 / (revenue / 50000), 6) END AS asset_liability_ratio, net_profit FROM (SELECT ts_code, end_date, roe, CASE WHEN report % 3 = 0 THEN revenue * 2 ELSE revenue END AS revenue, CASE WHEN report % 3 = 0 THEN revenue * 2 ELSE revenue END / 10 AS net_profit, report FROM fundamentals QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY report DESC) = 1)")
def derived_factors(spark, sf_dir):
    """Saved statements bring their derived factors: what is saved later replaces the factors of its period."""
    f = windows.latest(d.fundamentals(spark, sf_dir), ["ts_code", "end_date"], F.col("report").desc())
    full = lambda df: df.select("ts_code", "end_date", F.col("roe").alias("roe_avg"), (F.col("revenue") / 50000).alias("asset_to_equity"), (F.col("revenue") / 10).alias("net_profit"))
    stored = merge.derived_factors(full(f))
    again = full(f.where("report % 3 = 0").withColumn("revenue", F.col("revenue") * 2))
    out = merge.upsert(stored, merge.derived_factors(again), ["ts_code", "end_date"])
    return out.select("ts_code", "end_date", "roe", F.round("asset_liability_ratio", 6).alias("asset_liability_ratio"), "net_profit")


plain("S-28", "bars", "bars", "SELECT 'bars' AS table_name, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS \"rows\", 'ok' AS status FROM bars", lambda b: storage.sync_log(b, "bars"))
