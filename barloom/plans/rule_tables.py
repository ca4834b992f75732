"""Queries of trading rules, codes and field rules (F, T, D, P-09 to P-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import codes, rules
from barloom.operators import asof, calendar
from barloom.plans.catalog import at, plain, query, r6
from barloom.sources import derived as d
from barloom.sources import fields

BOARD = "CASE WHEN ts_code LIKE '688%' THEN 'STAR' WHEN ts_code LIKE '%.BJ' THEN 'BSE' WHEN ts_code LIKE '30%' THEN 'ChiNext' ELSE 'main' END"


def board():
    return codes.board(F.left("ts_code", F.lit(6)))


def _case(day: str, periods, show=lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE") -> str:
    """SQL of a rule's periods."""
    return "".join(f" WHEN {day} >= DATE '{a}'" + (f" AND {day} <= DATE '{b}'" if b else "") + f" THEN {show(v)}" for a, b, v in periods)


# Half up on the shortest decimal form of a double, as Spark rounds.
ROUND = lambda x: f"round(({x})::VARCHAR::DECIMAL(30,14), 2)::DOUBLE"
LIMIT = "CASE " + " ".join(f"WHEN {BOARD} = '{b}' THEN CASE{_case('trade_date', p)} ELSE 0.1 END" for b, p in rules.PRICE_LIMITS.items()) + " END"
# Days shifted by 22 years put the given bars into the years in which rules changed.
LATER = "bars2 AS (SELECT * REPLACE ((trade_date + INTERVAL 264 MONTH)::DATE AS trade_date) FROM bars)"


def later(b):
    return b.withColumn("trade_date", F.add_months("trade_date", 264))


plain("F-02", "bars", "bars", "SELECT DISTINCT l AS code, CASE WHEN length(l) < 6 THEN lpad(l, 6, '0') ELSE l END AS padded FROM (SELECT volume::VARCHAR AS l FROM bars)", lambda b: b.select(F.col("volume").cast("string").alias("code")).distinct().withColumn("padded", codes.padded(F.col("code"))))
plain("F-03", "bars", "bars", "SELECT DISTINCT ts_code, lower(split_part(ts_code, '.', 2)) || '.' || split_part(ts_code, '.', 1) AS prefixed FROM bars", lambda b: b.select("ts_code").distinct().withColumn("prefixed", codes.prefixed(F.col("ts_code"))))
plain("F-04", "bars", "bars", r"SELECT ts_code, regexp_extract(c, '^(\d{6})\.(SH|SZ|BJ)$', 1) AS symbol, regexp_extract(c, '^(\d{6})\.(SH|SZ|BJ)$', 2) AS exchange, regexp_matches(c, '^\d{6}\.(SH|SZ|BJ)$') AS valid FROM (SELECT ts_code, CASE WHEN ts_code LIKE '9%' THEN replace(ts_code, 'BJ', 'XX') ELSE ts_code END AS c FROM (SELECT DISTINCT ts_code FROM bars))", lambda b: b.select("ts_code").distinct().select("ts_code", codes.parsed(F.when(F.startswith("ts_code", F.lit("9")), F.replace("ts_code", F.lit("BJ"), F.lit("XX"))).otherwise(F.col("ts_code"))).alias("x")).select("ts_code", "x.*"))
plain("F-05", "bars", "bars", "SELECT ts_code, CASE trade_date % 3 WHEN 0 THEN c || '.SH' WHEN 1 THEN c || '.SZ' ELSE c || '.SH' END AS index_code FROM (SELECT DISTINCT ts_code, left(ts_code, 6) AS c, volume % 3 AS trade_date FROM bars)", lambda b: b.select("ts_code", (F.col("volume") % 3).alias("k")).distinct().select("ts_code", codes.index_code(F.concat(F.left("ts_code", F.lit(6)), F.when(F.col("k") == 0, ".XSHG").when(F.col("k") == 1, ".XSHE").otherwise(""))).alias("index_code")))
plain("F-08", "bars", "bars", "SELECT ts_code, trade_date, round(CASE WHEN pre_close > 0 THEN (close / pre_close - 1) * 100 ELSE 0 END, 6) AS pct FROM bars", lambda b: b.select("ts_code", "trade_date", F.round(F.when(F.col("pre_close") > 0, (F.try_divide("close", "pre_close") - 1) * 100).otherwise(0.0), 6).alias("pct")))
plain("F-09", "bars", "bars", "SELECT ts_code, trade_date, coalesce(pre_close, close) AS base, round(exp(ln(close)), 6) AS back, greatest(open, close) AS upper, nullif(volume % 7, 0)::BIGINT AS rest FROM bars", lambda b: b.select("ts_code", "trade_date", F.coalesce("pre_close", "close").alias("base"), F.round(F.exp(F.ln("close")), 6).alias("back"), F.greatest("open", "close").alias("upper"), F.nullif(F.col("volume") % 7, F.lit(0)).cast("long").alias("rest")))
plain("F-10", "bars", "bars", "SELECT ts_code, trade_date, TRY_CAST(CASE WHEN volume % 4 = 0 THEN 'n/a' ELSE volume::VARCHAR END AS BIGINT) AS parsed FROM bars", lambda b: b.select("ts_code", "trade_date", F.when(F.col("volume") % 4 == 0, "n/a").otherwise(F.col("volume").cast("string")).try_cast("long").alias("parsed")))
plain("F-11", "bars", "bars", "SELECT ts_code, trade_date, round(coalesce(close / nullif(volume % 7, 0), 1.0), 6) AS factor FROM bars", lambda b: b.select("ts_code", "trade_date", F.round(fields.finite(F.when(F.col("volume") % 14 == 0, F.lit(float("inf"))).otherwise(F.try_divide("close", F.col("volume") % 7))), 6).alias("factor")))
plain("F-15", "history", "history", "SELECT ts_code, eff_date, CASE WHEN board LIKE '%URGENT%' THEN 'bankruptcy' WHEN board LIKE '%HIGH%' THEN 'merger' ELSE 'unknown' END AS reason FROM history", lambda h: h.select("ts_code", "eff_date", codes.delist_reason(F.when(F.contains("board", F.lit("URGENT")), "破产").when(F.contains("board", F.lit("HIGH")), "吸收合并").otherwise("")).alias("reason")))
plain("F-16", "bars", "bars", "SELECT ts_code, strftime(trade_date, '%Y-%m-%d') AS day, year(trade_date)::BIGINT AS y, trade_date - 30 AS month_before FROM bars", lambda b: b.select("ts_code", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), F.year("trade_date").cast("long").alias("y"), F.date_sub("trade_date", 30).alias("month_before")))
plain("F-17", "fundamentals", "fundamentals", "SELECT report, CASE WHEN roe / 10 > 1 THEN round(1 - 1 / (roe / 10), 6) END AS ratio FROM fundamentals", lambda f: f.select("report", F.round(codes.liability_ratio(F.col("roe") / 10), 6).alias("ratio")))
plain("F-18", "bars", "bars", "SELECT ts_code, trade_date, 'volume=' || volume || ', suspended=' || is_suspend AS detail FROM bars", lambda b: b.select("ts_code", "trade_date", F.format_string("volume=%d, suspended=%s", "volume", F.col("is_suspend").cast("string")).alias("detail")))
plain("F-19", "history", "history", "SELECT ts_code, bool_or(board = '1-URGENT') AS was_urgent FROM history GROUP BY ts_code", lambda h: h.groupBy("ts_code").agg(F.collect_set("board").alias("b")).select("ts_code", F.array_contains("b", "1-URGENT").alias("was_urgent")))
STRIPPED = lambda x: f"[c FOR c IN list_distinct(string_split({'replace(' * len(codes.NAME_SUFFIXES)}{x}{''.join(f", '{w}', '')" for w in codes.NAME_SUFFIXES)}, '')) IF c <> '']"
FULL_NAME = "CASE WHEN ts_code LIKE '60%' THEN '*ST' || left(ts_code, 6) WHEN ts_code LIKE '00%' THEN left(ts_code, 6) || '股份有限公司' WHEN ts_code LIKE '30%' THEN '集团公司' ELSE ts_code END"


def full_name(code):
    start = lambda p: F.startswith(code, F.lit(p))
    return F.when(start("60"), F.concat(F.lit("*ST"), F.left(code, F.lit(6)))).when(start("00"), F.concat(F.left(code, F.lit(6)), F.lit("股份有限公司"))).when(start("30"), F.lit("集团公司")).otherwise(code)


plain("F-14", "bars", "bars", f"SELECT ts_code, coalesce(round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6), 0) AS similarity FROM (SELECT ts_code, {STRIPPED(FULL_NAME)} AS a, {STRIPPED(chr(39) + '600010集团' + chr(39))} AS b FROM (SELECT DISTINCT ts_code FROM bars))", lambda b: b.select("ts_code").distinct().select("ts_code", F.round(codes.name_similarity(full_name(F.col("ts_code")), F.lit("600010集团")), 6).alias("similarity")))

plain("T-01", "bars", "bars", f"WITH {LATER} SELECT ts_code, trade_date, {LIMIT} AS price_limit FROM bars2", lambda b: rules.with_price_limit(later(b)).select("ts_code", "trade_date", "price_limit"))
plain("T-02", "bars", "bars", f"WITH {LATER} SELECT ts_code, trade_date, CASE WHEN v < least_lot THEN 0 ELSE v - v % step END::BIGINT AS shares FROM (SELECT ts_code, trade_date, volume * 3 AS v, CASE WHEN star THEN 200 ELSE 100 END AS least_lot, CASE WHEN star OR bse THEN 1 ELSE 100 END AS step FROM (SELECT *, {BOARD} = 'STAR' AND trade_date >= '2019-07-22' AS star, {BOARD} = 'BSE' AND trade_date >= '2021-11-15' AS bse FROM bars2))", lambda b: later(b).select("ts_code", "trade_date", rules.round_shares(F.col("volume") * 3, board(), F.col("trade_date")).alias("shares")))
plain("T-03", "bars", "bars", f"SELECT ts_code, trade_date, CASE{_case('trade_date', rules.STAMP_TAX)} ELSE 0.0005 END AS rate FROM bars", lambda b: b.select("ts_code", "trade_date", rules.stamp_tax(F.col("trade_date")).alias("rate")))
plain("T-04", "bars", "bars", f"SELECT ts_code, trade_date, {ROUND('pre_close * (1 + p)')} AS up, {ROUND('pre_close * (1 - p)')} AS down FROM (SELECT *, {LIMIT} AS p FROM bars)", lambda b: rules.with_price_limit(b).select("ts_code", "trade_date", rules.limit_prices(F.col("pre_close"), F.col("price_limit")).alias("x")).select("ts_code", "trade_date", "x.*"))
STATE = f"""state AS (SELECT *, CASE WHEN is_suspend OR volume = 0 THEN 'suspended' WHEN coalesce(pre_close, 0) <= 0 THEN 'bad_pre_close' WHEN p IS NULL THEN 'no_limit' WHEN low >= up * 0.999 THEN 'limit_up' WHEN high < up * 0.999 AND high <= down * 1.001 AND low <= down * 1.001 THEN 'limit_down' ELSE 'normal' END AS reason FROM (
  SELECT *, {ROUND('pre_close * (1 + p)')} AS up, {ROUND('pre_close * (1 - p)')} AS down FROM (SELECT *, {LIMIT} AS p FROM bars)))"""


def state(b):
    return rules.with_price_limit(b).withColumn("x", rules.tradability(F.col("price_limit")))


plain("T-05", "bars", "bars", f"WITH {STATE} SELECT ts_code, trade_date, reason IN ('no_limit', 'limit_down', 'normal') AS can_buy, reason IN ('no_limit', 'limit_up', 'normal') AS can_sell, reason FROM state", lambda b: state(b).select("ts_code", "trade_date", "x.*"))
plain("T-06", "bars", "bars", f"WITH {STATE} SELECT ts_code, trade_date, CASE WHEN reason IN ('no_limit', 'limit_down', 'normal') THEN open END AS buy_at, CASE WHEN reason IN ('no_limit', 'limit_up', 'normal') THEN close END AS sell_at FROM state", lambda b: state(b).select("ts_code", "trade_date", rules.execution_price(F.col("x"), F.lit("buy"), F.lit("market")).alias("buy_at"), rules.execution_price(F.col("x"), F.lit("sell"), F.lit("limit")).alias("sell_at")))
plain("P-13", "bars", "bars", f"WITH {STATE} SELECT ts_code, trade_date FROM state WHERE reason NOT IN ('suspended', 'bad_pre_close')", lambda b: state(b).where("x.can_buy or x.can_sell").select("ts_code", "trade_date"))

plain("D-03", "calendar", "calendar", "SELECT c.cal_date, max(x.cal_date) AS prev_trade_date FROM calendar c LEFT JOIN calendar x ON x.is_trading_day AND x.cal_date < c.cal_date GROUP BY c.cal_date", lambda c: calendar.neighbours(c).select("cal_date", "prev_trade_date"))
plain("D-06", "calendar", "calendar", "SELECT cal_date FROM calendar WHERE is_trading_day AND cal_date BETWEEN '1996-02-01' AND '1996-08-31'", lambda c: c.where(F.col("is_trading_day") & F.col("cal_date").between("1996-02-01", "1996-08-31")).select("cal_date"))


@query("D-04", "calendar dates", "SELECT t, (SELECT max(cal_date) FROM calendar WHERE is_trading_day AND cal_date < t) AS prev_trade_date FROM dates")
def previous_of_dates(spark, sf_dir):
    """Days outside the calendar have no previous day of their own row, so the last one before them is carried to them."""
    open_days = d.calendar(spark, sf_dir).where("is_trading_day").select(F.col("cal_date").alias("prev_trade_date"))
    return asof.join(d.dates(spark, sf_dir), open_days, [], "t", "prev_trade_date", ["prev_trade_date"], strict=True)



REQUEST = "SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY ts_code"


def requests(b):
    return b.groupBy("ts_code").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))


plain("P-09", "bars", "bars", f"SELECT ts_code, greatest(a, DATE '1996-01-01') AS \"start\", least(b, DATE '1997-12-31') AS \"end\" FROM ({REQUEST}) WHERE ts_code LIKE '6%' AND a <= '1997-12-31' AND b >= '1996-01-01'", lambda b: fields.in_scope(requests(b), b.where(F.startswith("ts_code", F.lit("6"))), "1996-01-01", "1997-12-31").select("ts_code", "start", "end"))
plain("P-10", "bars", "bars", "SELECT ts_code, close FROM bars", lambda b: fields.project(b, ["ts_code", "close"]))
plain("P-11", "bars", "bars", "SELECT ts_code, trade_date FROM bars WHERE volume % 6 <> 0", lambda b: fields.dated(b.select("ts_code", F.when(F.col("volume") % 6 == 0, "bad day").otherwise(F.col("trade_date").cast("string")).alias("trade_date")), "ts_code", "trade_date"))
plain("P-14", "bars", "bars", "SELECT ts_code, trade_date, volume, NOT is_suspend AS is_suspend FROM bars", lambda b: fields.normalize(b.select("ts_code", F.col("trade_date").alias("dt"), F.col("volume").alias("vol"), F.col("is_suspend").alias("is_trading"))))
plain("P-15", "bars", "bars", "SELECT ts_code, close, 0::BIGINT AS volume, false AS is_st, NULL::DOUBLE AS turnover, NULL::DATE AS list_date FROM bars", lambda b: fields.ensure(b.select("ts_code", "close"), ["ts_code", "volume", "is_st", "turnover", "list_date"]))
plain("P-17", "bars", "bars", "SELECT ts_code, trade_date, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, close, CASE WHEN volume % 3 = 0 THEN 0 ELSE volume END AS volume FROM bars", lambda b: fields.standardize(b.select("ts_code", F.col("trade_date").cast("string").alias("date"), F.col("close").cast("string").alias("close"), F.when(F.col("volume") % 3 == 0, "?").otherwise(F.col("volume").cast("string")).alias("vol"))).select(*fields.REQUIRED))


plain("P-16", "bars", "bars", "SELECT * FROM (SELECT unnest(['open', 'close', 'turnover']) AS field, unnest([count(*) FILTER (volume % 5 = 0), count(*) FILTER (volume % 3 = 0), count(*)]) AS lacking, count(*) AS \"rows\" FROM bars)", lambda b: fields.lacking(b.withColumns({"open": F.when(F.col("volume") % 5 != 0, F.col("open")), "close": F.when(F.col("volume") % 3 != 0, F.col("close"))}), [*fields.REQUIRED, "turnover"]))


@query("S-22", "bars", "SELECT ts_code, trade_date, close, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close, volume, volume = 0 AS is_suspend, 'vendor' AS data_source FROM (SELECT ts_code, trade_date, close, CASE WHEN volume % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars)")
def vendor(spark, sf_dir):
    raw = d.bars(spark, sf_dir).select(F.left("ts_code", F.lit(6)).alias("code"), F.col("trade_date").cast("string").alias("date"), F.col("close").cast("string").alias("close"), F.when(F.col("volume") % 5 == 0, "-").otherwise(F.col("volume").cast("string")).alias("vol"))
    return fields.from_vendor(raw, "vendor").select("ts_code", "trade_date", "close", "pre_close", "volume", "is_suspend", "data_source")
