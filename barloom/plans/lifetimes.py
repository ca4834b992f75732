"""Queries of lifetimes, versions and point-in-time joins (M, J, T-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import codes
from barloom.operators import asof, lifetimes, pit, windows
from barloom.plans.catalog import at, plain, query, r6
from barloom.sources import derived as d
from barloom.sources.derived import read

LATEST = "latest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY eff_date DESC) = 1)"
ACTIVE = "act AS (SELECT t, v.* FROM (SELECT *, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) AS n FROM history) v JOIN dates ON eff_date <= t AND (n IS NULL OR t < n))"


def last_versions(h: DataFrame) -> DataFrame:
    return windows.latest(h, ["ts_code"], F.col("eff_date").desc())


def active(spark, sf_dir) -> DataFrame:
    return asof.active(windows.validity(d.history(spark, sf_dir)), d.dates(spark, sf_dir))


plain("M-01", "history", "history", "SELECT ts_code, eff_date, status FROM history WHERE eff_date <= '1999-06-30' QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY eff_date DESC) = 1 AND (delist_date IS NULL OR delist_date > '1999-06-30')", lambda h: last_versions(h.where(F.col("eff_date") <= at("1999-06-30"))).where(F.col("delist_date").isNull() | (F.col("delist_date") > at("1999-06-30"))).select("ts_code", "eff_date", "status"))
plain("M-02", "history", "history", "SELECT ts_code, eff_date, status FROM history WHERE eff_date BETWEEN '1997-01-01' AND '1997-06-30'", lambda h: h.where(F.col("eff_date").between(at("1997-01-01"), at("1997-06-30"))).select("ts_code", "eff_date", "status"))


@query("M-04", "history dates", f"WITH {ACTIVE} SELECT t, ts_code FROM act WHERE list_date <= t AND (delist_date IS NULL OR delist_date > t)")
def active_universe(spark, sf_dir):
    return pit.universe(d.history(spark, sf_dir), d.dates(spark, sf_dir)).select("t", "ts_code")


@query("M-05", "history dates", f"WITH {ACTIVE} SELECT t, ts_code FROM act WHERE status = 'P'")
def flagged(spark, sf_dir):
    return active(spark, sf_dir).where("status = 'P'").select("t", "ts_code")


@query("M-07", "membership dates", f"WITH {LATEST} SELECT t, m.ts_code, m.index_code, l.status FROM membership m JOIN dates ON in_date <= t AND t <= coalesce(out_date, DATE '9999-12-31') LEFT JOIN latest l ON m.ts_code = l.ts_code WHERE m.index_code = '1-URGENT'")
def constituents(spark, sf_dir):
    h = last_versions(d.history(spark, sf_dir)).select("ts_code", "status")
    found = asof.members(d.membership(spark, sf_dir).where("index_code = '1-URGENT'"), d.dates(spark, sf_dir))
    return found.join(h, "ts_code", "left").select("t", "ts_code", "index_code", "status")


plain("M-09", "fundamentals", "fundamentals", "SELECT report, CASE WHEN roe > 1 THEN round(1 - 1 / roe, 6) END AS asset_liability_ratio, round(revenue / 100, 4) AS margin FROM fundamentals", lambda f: f.select("report", F.round(codes.liability_ratio(F.col("roe")), 6).alias("asset_liability_ratio"), F.round(F.col("revenue") / 100, 4).alias("margin")))


@query("M-11", "fundamentals dates", "SELECT t, ts_code, max(ann_date) AS newest FROM fundamentals JOIN dates ON ann_date BETWEEN t - 90 AND t GROUP BY 1, 2 HAVING max(ann_date) >= t")
def violations(spark, sf_dir):
    """What an inclusive bound would let through: announcements on the very day."""
    near = asof.on_days(d.fundamentals(spark, sf_dir), d.dates(spark, sf_dir), F.col("ann_date"), F.date_add("ann_date", 90))
    return lifetimes.pit_violations(near)


LOG = "log AS (SELECT event_id, user_id, event_type, value, ts AS recorded_at, CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 200 DAY ELSE ts END AS effective_at, row_number() OVER w AS version, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"
KEY = ["user_id", "event_type"]


def log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").alias("recorded_at"))
    late = F.when(F.col("event_id") % 50 == 0, F.col("recorded_at") + F.expr("interval 200 days")).otherwise(F.col("recorded_at"))
    return pit.number_versions(e.withColumn("effective_at", late), KEY, "recorded_at").drop("superseded_by")


@query("M-14", "dates", f"WITH {LOG}, m AS (SELECT user_id, event_type, max(version) AS v FROM log GROUP BY 1, 2) SELECT user_id, event_type, version, CASE WHEN status = 'active' AND user_id % 4 = 0 THEN 'corrected' ELSE status END AS status, CASE WHEN status = 'active' AND user_id % 4 = 0 THEN 'restated' END AS note FROM log UNION ALL SELECT user_id, event_type, v + 1, 'active', 'restated' FROM m WHERE user_id % 4 = 0")
def corrected(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("correction_note", F.lit(None).cast("string"))
    fixes = rows.where("status = 'active' and user_id % 4 = 0").withColumn("correction_note", F.lit("restated")).drop("version", "status")
    return lifetimes.correct(rows, fixes, KEY).select(*KEY, "version", "status", F.col("correction_note").alias("note"))


@query("M-15", "dates", f"WITH {LOG} SELECT event_id, user_id, event_type, version, status FROM log WHERE event_type = (SELECT min(event_type) FROM events)")
def listing(spark, sf_dir):
    rows = log(spark, sf_dir)
    kind = read(spark, sf_dir, "events").agg(F.min("event_type").alias("event_type"))
    return rows.join(F.broadcast(kind), "event_type").select("event_id", *KEY, "version", "status")


@query("M-16", "dates", f"WITH {LOG} SELECT event_id, 'hash_mismatch' AS issue, 'critical' AS severity FROM log WHERE event_id % 97 = 0 UNION ALL SELECT event_id, 'late_effect', 'warning' FROM log WHERE event_id % 50 = 0")
def audited(spark, sf_dir):
    digest = pit.payload_hash(["event_id", "user_id", "value"])
    rows = log(spark, sf_dir).withColumn("data_hash", F.when(F.col("event_id") % 97 == 0, "damaged").otherwise(digest))
    return lifetimes.audit(rows, digest)


@query("M-17", "fundamentals", "SELECT ts_code, end_date, version, report, roe FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, end_date ORDER BY ann_date, report) AS version FROM fundamentals) WHERE ann_date < '1999-06-30' QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY ann_date DESC, version DESC) = 1")
def stored_fundamentals(spark, sf_dir):
    f = d.fundamentals(spark, sf_dir).withColumn("event_id", F.col("report"))
    versions = pit.number_versions(f, ["ts_code", "end_date"], "ann_date")
    return pit.as_of(versions, ["ts_code", "end_date"], at("1999-06-30"), "ann_date").select("ts_code", "end_date", "version", "report", "roe")


plain("M-18", "history", "history", "SELECT ts_code, eff_date, CASE WHEN status = 'F' THEN DATE '2999-12-31' ELSE eff_date END AS effective_at FROM history", lambda h: h.select("ts_code", "eff_date", F.when(F.col("status") == "F", at("2999-12-31")).otherwise(F.col("eff_date")).alias("effective_at")))


@query("M-19", "history dates", f"WITH {ACTIVE}, k AS (SELECT ts_code, min(list_date) AS a, max(delist_date) AS b FROM history GROUP BY 1) SELECT k2.t, k2.ts_code, CASE WHEN k2.t < a THEN 'not_listed' WHEN b <= k2.t THEN 'delisted' ELSE status END AS status, NOT (k2.t < a OR coalesce(b <= k2.t, false)) AS is_tradable FROM (SELECT t, k.* FROM k CROSS JOIN dates) k2 LEFT JOIN act ON act.t = k2.t AND act.ts_code = k2.ts_code")
def statuses(spark, sf_dir):
    return lifetimes.status_on(lifetimes.nested(d.history(spark, sf_dir)), d.dates(spark, sf_dir)).select("t", "ts_code", "status", "is_tradable")


@query("T-07", "history dates", f"WITH {ACTIVE} SELECT t, ts_code, status, status = 'P' AS is_st, status <> 'P' AND (delist_date IS NULL OR delist_date > t) AS tradable FROM act")
def daily_status(spark, sf_dir):
    listed = F.col("delist_date").isNull() | (F.col("delist_date") > F.col("t"))
    return active(spark, sf_dir).select("t", "ts_code", "status", (F.col("status") == "P").alias("is_st"), ((F.col("status") != "P") & listed).alias("tradable"))


INTERVALS = "SELECT ts_code, eff_date AS start_date, e - 1 AS end_date FROM (SELECT *, min(CASE WHEN status <> 'F' THEN eff_date END) OVER (PARTITION BY ts_code ORDER BY eff_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, lag(status) OVER (PARTITION BY ts_code ORDER BY eff_date) AS p FROM history) WHERE status = 'F' AND (p IS NULL OR p <> 'F')"
plain("M-20", "history", "history", "SELECT ts_code, min(list_date) AS list_date, max(delist_date) AS delist_date, count(*) AS n_events, arg_min(status, eff_date) AS first_status, arg_max(status, eff_date) AS last_status FROM history GROUP BY ts_code", lambda h: lifetimes.nested(h).select("ts_code", "list_date", "delist_date", F.size("events").cast("long").alias("n_events"), F.element_at("events", 1)["status"].alias("first_status"), F.element_at("events", -1)["status"].alias("last_status")))
plain("W-18", "history", "history", INTERVALS, lambda h: lifetimes.flag_intervals(h.withColumn("f", F.col("status") == "F"), "f"))
plain("W-18-transitions", "history", "history", 'SELECT * FROM (SELECT ts_code, eff_date, lag(status) OVER (PARTITION BY ts_code ORDER BY eff_date) AS "before", status AS "after" FROM history) WHERE "before" <> "after"', lambda h: lifetimes.transitions(h, "status"))


@query("M-21", "history dates", f"WITH {ACTIVE} SELECT t, ts_code FROM act WHERE t - list_date >= 60")
def seasoned(spark, sf_dir):
    return pit.universe(d.history(spark, sf_dir), d.dates(spark, sf_dir), min_days=60, include_delisted=True).select("t", "ts_code")


@query("M-22", "history dates", f"WITH {LATEST} SELECT t, ts_code, delist_date, (delist_date - t)::BIGINT AS days_remaining, CASE WHEN delist_date - t <= 10 THEN 'high' WHEN delist_date - t <= 20 THEN 'medium' ELSE 'low' END AS urgency FROM latest JOIN dates ON delist_date - t BETWEEN 0 AND 30")
def warned(spark, sf_dir):
    return lifetimes.warnings(last_versions(d.history(spark, sf_dir)), d.dates(spark, sf_dir)).withColumn("days_remaining", F.col("days_remaining").cast("long"))


ENDS = "ends AS (SELECT ts_code, max(trade_date) - 10 AS delist_date FROM bars GROUP BY ts_code)"


def ends(b: DataFrame) -> DataFrame:
    """Ten days before the last bar, as a delisting day after which bars still come."""
    return b.groupBy("ts_code").agg(F.date_sub(F.max("trade_date"), 10).alias("delist_date"))


plain("M-23", "bars", "bars", f"WITH {ENDS} SELECT ts_code, max(trade_date) AS last_day, arg_max(close, trade_date) AS last_close, count(*) AS n_rows FROM (SELECT b.* FROM bars b JOIN ends e ON b.ts_code = e.ts_code AND trade_date BETWEEN delist_date - 30 AND delist_date QUALIFY row_number() OVER (PARTITION BY b.ts_code ORDER BY trade_date DESC) <= 5) GROUP BY ts_code", lambda b: lifetimes.final_state(b, ends(b)))
plain("J-08", "bars", "bars", f"WITH {ENDS} SELECT b.ts_code, b.trade_date FROM bars b JOIN ends e ON b.ts_code = e.ts_code AND trade_date > delist_date + 5", lambda b: b.join(ends(b), "ts_code").where(F.col("trade_date") > F.date_add("delist_date", 5)).select("ts_code", "trade_date"))
NAMES = "names AS (SELECT c_custkey::VARCHAR AS ts_code, c_name AS name, DATE '1995-01-01' + (c_custkey * 7 % 2000)::INTEGER AS list_date, DATE '1995-01-01' + (c_custkey * 11 % 2000)::INTEGER AS delist_date FROM customer)"


def names(spark, sf_dir) -> DataFrame:
    """Customers with made-up listing and delisting days, a rule of their keys."""
    day = lambda m: F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * m % 2000).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ts_code"), F.col("c_name").alias("name"), day(7).alias("list_date"), day(11).alias("delist_date"))


@query("J-19", "dates", f"WITH {NAMES} SELECT o.ts_code AS old, n.ts_code AS new, round(len(list_intersect(list_distinct(string_split(o.name, '')), list_distinct(string_split(n.name, '')))) / len(list_distinct(list_concat(string_split(o.name, ''), string_split(n.name, '')))), 6) AS similarity FROM names o JOIN names n ON n.list_date - o.delist_date BETWEEN 0 AND 60 AND n.ts_code <> o.ts_code WHERE len(list_intersect(list_distinct(string_split(o.name, '')), list_distinct(string_split(n.name, '')))) / len(list_distinct(list_concat(string_split(o.name, ''), string_split(n.name, '')))) > 0.5 QUALIFY row_number() OVER (PARTITION BY o.ts_code ORDER BY n.list_date, n.ts_code) = 1")
def succeeded(spark, sf_dir):
    n = names(spark, sf_dir)
    return lifetimes.successors(n, n).select("old", "new", r6("similarity"))


#: Chains between square numbers, so the longest grow with the table.
CHAIN = "edges AS (SELECT c_custkey AS o, c_custkey + 1 AS n FROM customer WHERE floor(sqrt(c_custkey)) ** 2 <> c_custkey)"


@query("J-20", "dates", f"WITH RECURSIVE {CHAIN}, walk(code, final) AS (SELECT o, n FROM edges UNION ALL SELECT w.code, e.n FROM walk w JOIN edges e ON e.o = w.final) SELECT code, max(final) AS final FROM walk GROUP BY code")
def resolved(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("pow(floor(sqrt(c_custkey)), 2) != c_custkey")
    return pit.resolve_codes(c.select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new")))


@query("M-24", "dates", f"WITH RECURSIVE {CHAIN}, walk(code, final) AS (SELECT o, n FROM edges UNION ALL SELECT w.code, e.n FROM walk w JOIN edges e ON e.o = w.final) SELECT final AS code, count(DISTINCT code) AS predecessors FROM (SELECT code, max(final) AS final FROM walk GROUP BY code) GROUP BY final")
def predecessors(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy(F.col("final").alias("code")).agg(F.count("*").alias("predecessors"))


plain("M-25", "history", "history", f"WITH {LATEST} SELECT ts_code, delist_date, delist_date IS NOT NULL AS is_delisted FROM latest", lambda h: h.groupBy("ts_code").agg(F.max_by("delist_date", "eff_date").alias("delist_date")).withColumn("is_delisted", F.col("delist_date").isNotNull()))
plain("M-26", "bars", "bars", "SELECT DISTINCT ts_code, left(ts_code, 6) AS symbol, right(ts_code, 2) AS exchange, CASE WHEN ts_code LIKE '688%' THEN 'STAR' WHEN ts_code LIKE '%.BJ' THEN 'BSE' WHEN ts_code LIKE '30%' THEN 'ChiNext' ELSE 'main' END AS board FROM bars", lambda b: b.select(F.left("ts_code", F.lit(6)).alias("symbol")).distinct().select(codes.ts_code(F.col("symbol")).alias("ts_code"), "symbol", codes.exchange(F.col("symbol")).alias("exchange"), codes.board(F.col("symbol")).alias("board")))


@query("J-12", "history bars", f"WITH {LATEST} SELECT DISTINCT k.c AS ts_code FROM (SELECT ts_code AS c FROM history UNION SELECT ts_code FROM bars) k LEFT JOIN latest l ON l.ts_code = k.c WHERE l.delist_date IS NULL OR l.delist_date > '2000-01-01'")
def not_known_gone(spark, sf_dir):
    h = d.history(spark, sf_dir)
    keys = h.select("ts_code").union(d.bars(spark, sf_dir).select("ts_code")).distinct()
    return keys.join(last_versions(h).select("ts_code", "delist_date"), "ts_code", "left").where(F.col("delist_date").isNull() | (F.col("delist_date") > at("2000-01-01"))).select("ts_code")


@query("J-16", "membership", f"WITH {LATEST} SELECT m.ts_code, m.in_date, l.board, l.status FROM membership m LEFT JOIN latest l ON l.ts_code = m.ts_code")
def with_attributes(spark, sf_dir):
    return d.membership(spark, sf_dir).join(last_versions(d.history(spark, sf_dir)).select("ts_code", "board", "status"), "ts_code", "left").select("ts_code", "in_date", "board", "status")


@query("P-26", "history", "SELECT ts_code, min(list_date) AS list_date, max(delist_date) AS delist_date FROM history WHERE ts_code IN ('c1', 'c2', 'c4') GROUP BY ts_code")
def one_lifetime(spark, sf_dir):
    return lifetimes.nested(d.history(spark, sf_dir).where(F.col("ts_code").isin("c1", "c2", "c4"))).drop("events")
