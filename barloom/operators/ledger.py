"""Orders, fills, ledgers and valuations as tables (R-03 to R-05, R-07, R-08, R-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import codes, rules
from barloom.operators import asof


def target_deltas(targets: DataFrame, holdings: DataFrame, value: float) -> DataFrame:
    """Shares to trade: target value over price, rounded to the lot, less what is held; sales stop at what is available.

    targets: trade_date, ts_code, weight, price; holdings: trade_date, ts_code, shares, available. A holding without a
    target is sold; one without a price stays.
    """
    lots = rules.round_shares(F.floor(F.try_divide(F.col("weight") * value, "price")), F.col("_board"), F.col("trade_date"))
    # Rules are applied to a target and not to its pairs, of which there are many where a code has many holdings in a day.
    wanted = targets.withColumn("_board", codes.board(F.left("ts_code", F.lit(6)))).select("trade_date", "ts_code", F.when(F.col("weight").isNull(), 0).otherwise(lots).alias("_wanted"), F.lit(True).alias("_target"))
    both = wanted.join(holdings.select("trade_date", "ts_code", "shares", "available"), ["trade_date", "ts_code"], "full_outer")
    delta = F.when(F.col("_target").isNull(), 0).otherwise(F.col("_wanted")) - F.coalesce("shares", F.lit(0))
    return both.select("trade_date", "ts_code", F.greatest(delta, -F.coalesce("available", F.lit(0))).cast("long").alias("delta")).where("delta != 0")


def liquidity_cap(mean_volume: Column, volume: Column, board: Column, day: Column, share: float = 0.1) -> Column:
    """Most shares that an order may take: a share of the mean volume (of the day's volume where that is unknown), in lots."""
    return rules.round_shares(F.floor(F.coalesce(mean_volume, volume) * share), board, day)


def settlements(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """Cash flow of each trade with the day it settles (the next trading day for sales) and the day after, when it may be withdrawn.

    trades: trade_id, trade_date, ts_code, side, shares, price, fees; calendar: cal_date, next_trade_date.
    """
    amount, sale = F.col("shares") * F.col("price"), F.col("side") == "sell"
    days = calendar.select(F.col("cal_date").alias("trade_date"), "next_trade_date")
    out = trades.join(days, "trade_date", "left")
    return out.select(
        "trade_id", "trade_date", F.when(sale, amount - F.col("fees")).otherwise(-amount - F.col("fees")).alias("cash"),
        F.when(sale, F.col("next_trade_date")).otherwise(F.col("trade_date")).alias("settle_date"), F.when(sale, F.date_add("next_trade_date", 1)).alias("withdrawable_date"),
    )


def positions(trades: DataFrame, group: str = "account") -> DataFrame:
    """Shares held after each day with trades, and those that may be sold on it: what was held before, less the day's sales."""
    signed = F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares"))
    day = trades.groupBy(group, "ts_code", "trade_date").agg(F.sum(signed).alias("change"), F.sum(F.when(F.col("side") == "sell", F.col("shares")).otherwise(0)).alias("sold"))
    w = Window.partitionBy(group, "ts_code").orderBy("trade_date")
    held = day.withColumn("shares", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.select(group, "ts_code", "trade_date", "shares", (F.col("shares") - F.col("change") - F.col("sold")).alias("available"))


def valuation(held: DataFrame, prices: DataFrame, days: DataFrame, group: str = "account") -> DataFrame:
    """Market value and number of positions on each day, at the last price at or before it.

    Every pair of group and code gets a row for each day from its first trade, since values are needed on those days; days
    is a calendar, small by nature.
    """
    spans = held.withColumn("_until", F.lead("trade_date").over(Window.partitionBy(group, "ts_code").orderBy("trade_date"))).where("shares != 0")
    rows = asof.on_days(spans, days, F.col("trade_date"), F.date_sub("_until", 1)).select(group, "ts_code", "t", "shares")
    priced = asof.join(rows, prices, ["ts_code"], "t", "trade_date", ["close"])
    return priced.groupBy(group, "t").agg(F.sum(F.col("shares") * F.col("close")).alias("value"), F.count("*").alias("positions"))


def fills(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Filled and remaining shares of each order, with its status."""
    got = trades.groupBy("order_id").agg(F.sum("shares").alias("filled"))
    out = orders.join(got, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    status = F.when(F.col("filled") >= F.col("wanted"), "FILLED").when(F.col("filled") > 0, "PARTIAL").otherwise("PENDING")
    return out.select("order_id", "filled", (F.col("wanted") - F.col("filled")).alias("remaining"), status.alias("status"))


def trade_stats(trades: DataFrame, group: str, gain: str = "gain") -> DataFrame:
    """Win rate and expectancy of each group's trades."""
    g = F.col(gain)
    return trades.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.when(g > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(g).alias("expectancy"))
