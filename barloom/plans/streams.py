"""Queries of incremental sync and version payloads (ST, F-12, F-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import pit, storage
from barloom.plans.catalog import FLAWED, WHERE, flawed, plain, query
from barloom.sources import derived as d
from barloom.streaming import sync


def synced(spark, sf_dir, rows=lambda b: b) -> str:
    """Syncs bars up to 1997, then later ones together with 1997 again at twice the close; the folder with bars and alerts."""
    folder, b = storage.shared_folder(spark, "stream"), rows(d.bars(spark, sf_dir))
    again = b.where("year(trade_date) = 1997").withColumn("close", F.col("close") * 2)
    for batch in (b.where("year(trade_date) < 1998"), b.where("year(trade_date) >= 1998").unionByName(again)):
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(b.schema).parquet(f"{folder}/in")
        sync.sync(stream, f"{folder}/bars", f"{folder}/alerts", f"{folder}/state").awaitTermination()
    return folder


@query("ST-01", "bars", "SELECT ts_code, trade_date, CASE WHEN year(trade_date) = 1997 THEN close * 2 ELSE close END AS close FROM bars")
def synced_bars(spark, sf_dir):
    return sync.read_synced(spark, f"{synced(spark, sf_dir)}/bars").select("ts_code", "trade_date", "close")


@query("ST-01-progress", "bars", "SELECT ts_code, max(trade_date) AS last_date, count(*) AS total_records FROM bars GROUP BY ts_code")
def synced_progress(spark, sf_dir):
    return sync.progress(spark, f"{synced(spark, sf_dir)}/bars")


#: Both batches of `synced`, each with what the state holds before a key's first row of it.
BATCHES = f"""{FLAWED}, one AS (SELECT *, 1 AS batch FROM flawed WHERE year(trade_date) < 1998),
two AS (SELECT *, 2 AS batch FROM flawed WHERE year(trade_date) >= 1998 UNION ALL SELECT * REPLACE (close * 2 AS close), 2 FROM flawed WHERE year(trade_date) = 1997),
state AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 20),
known AS (SELECT *, true AS fresh FROM one UNION ALL SELECT *, true FROM two UNION ALL SELECT s.* REPLACE (2 AS batch), false FROM state s JOIN (SELECT ts_code, min(trade_date) AS f FROM two GROUP BY ts_code) USING (ts_code) WHERE trade_date < f),
seen AS (SELECT *, lag(adj_factor) OVER w AS factor_before, lag(close) OVER w AS close_before, count(*) OVER v AS rows_seen, avg(volume) OVER v AS mean_volume FROM known
  WINDOW w AS (PARTITION BY batch, ts_code ORDER BY trade_date), v AS (PARTITION BY batch, ts_code ORDER BY trade_date ROWS 19 PRECEDING))"""
#: Rules of the checks by alert type, besides those of catalog.WHERE.
SEEN = {
    "adj_factor_jump": "abs((adj_factor - factor_before) / nullif(factor_before, 0)) > 0.05", "volume_spike": "rows_seen = 20 AND volume > 10 * mean_volume",
    "suspected_suspension": "(volume = 0 OR close = 0) AND close = close_before", **dict(WHERE.values()),
}
ALERTS = f"""WITH {BATCHES} SELECT DISTINCT alert_type, ts_code, trade_date FROM (
  SELECT unnest([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in SEEN.items())}]) AS alert_type, ts_code, trade_date FROM seen WHERE fresh
  UNION ALL SELECT 'factor_change', x.ts_code, x.trade_date FROM (SELECT t.* FROM two t JOIN (SELECT ts_code, max(trade_date) AS d FROM one GROUP BY ts_code) USING (ts_code) WHERE trade_date > d QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) = 1) x
    JOIN (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) o ON o.ts_code = x.ts_code WHERE o.adj_factor <> 0 AND abs(x.adj_factor / o.adj_factor - 1) > 0.05
) WHERE alert_type IS NOT NULL"""


@query("ST-02", "bars", ALERTS)
def synced_alerts(spark, sf_dir):
    return spark.read.parquet(f"{synced(spark, sf_dir, flawed)}/alerts").select("alert_type", "ts_code", "trade_date").distinct()


def payload(h: DataFrame) -> DataFrame:
    return h.select("ts_code", "eff_date", "board", "status")


plain("F-12", "history", "history", """SELECT ts_code, eff_date, left(sha256('{"board":"' || board || '","status":"' || status || '","ts_code":"' || ts_code || '"}'), 16) AS data_hash FROM history""", lambda h: payload(h).select("ts_code", "eff_date", pit.payload_hash(["ts_code", "status", "board"]).alias("data_hash")))
plain("F-13", "history", "history", "SELECT ts_code, eff_date, board, 'corrected' AS status, strftime(eff_date, '%Y-%m-%d') AS effective FROM history", lambda h: pit.merged_payload(payload(h).withColumn("data_json", F.to_json(F.struct("board", "status"))), "data_json", F.create_map(F.lit("status"), F.lit("corrected"), F.lit("_effective_at"), F.col("eff_date").cast("string"))).select("ts_code", "eff_date", F.col("data")["board"].alias("board"), F.col("data")["status"].alias("status"), F.col("data")["_effective_at"].alias("effective")))
