"""Trading rules that change over time, as column expressions (T-01 to T-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import codes

# Fixed values: (first day, last day, value) of each rule; null means no limit or no end.
PRICE_LIMITS = {
    "main": [("1990-12-19", "1992-05-20", 0.10), ("1992-05-21", "1996-12-15", None), ("1996-12-16", None, 0.10)],
    "ChiNext": [("2009-10-30", "2020-08-23", 0.10), ("2020-08-24", None, 0.20)],
    "STAR": [("2019-07-22", None, 0.20)],
    "BSE": [("2021-11-15", None, 0.30)],
}
LOTS = {
    "main": [("1990-12-19", None, (100, 100))],
    "ChiNext": [("2009-10-30", None, (100, 100))],
    "STAR": [("2019-07-22", None, (200, 1))],
    "BSE": [("2021-11-15", None, (100, 1))],
}
STAMP_TAX = [
    ("1990-12-19", "1991-10-01", 0.006), ("1991-10-02", "1997-05-09", 0.003), ("1997-05-10", "1998-06-11", 0.005),
    ("1998-06-12", "2001-11-15", 0.004), ("2001-11-16", "2005-01-23", 0.002), ("2005-01-24", "2007-05-29", 0.001),
    ("2007-05-30", "2008-04-23", 0.003), ("2008-04-24", "2023-08-27", 0.001), ("2023-08-28", None, 0.0005),
]


def _during(day: Column, first: str, last: str | None) -> Column:
    begun = day >= F.lit(first).cast("date")
    return begun if last is None else begun & (day <= F.lit(last).cast("date"))


def _pick(day: Column, periods: list, default: Column, make=F.lit) -> Column:
    out = default
    for first, last, value in reversed(periods):
        out = F.when(_during(day, first, last), make(value)).otherwise(out)
    return out


def _by_board(board: Column, day: Column, rules: dict, default: Column, make) -> Column:
    out = _pick(day, rules["main"], default, make)
    for name, periods in rules.items():
        if name != "main":
            out = F.when(board == name, _pick(day, periods, default, make)).otherwise(out)
    return out


def with_price_limit(bars: DataFrame, listed: str | None = None) -> DataFrame:
    """Adds price_limit, the share that a price may move in a day; null where there is no limit, 0.1 before a board's first rule.

    With a listing day, the first five calendar days of STAR and reformed ChiNext and the first of BSE have no limit.
    The rules are broadcast: they are the few rows above, whatever the size of the bars.
    """
    rows = [(board, first, last, limit) for board, periods in PRICE_LIMITS.items() for first, last, limit in periods]
    table = bars.sparkSession.createDataFrame(rows, "_board string, _first string, _last string, _limit double").select("_board", F.col("_first").cast("date").alias("_first"), F.coalesce(F.col("_last").cast("date"), F.lit("9999-12-31").cast("date")).alias("_last"), "_limit")
    here = bars.withColumn("_here", codes.board(F.left("ts_code", F.lit(6))))
    out = here.join(F.broadcast(table), (F.col("_here") == F.col("_board")) & F.col("trade_date").between(F.col("_first"), F.col("_last")), "left")
    limit = F.when(F.col("_first").isNull(), F.lit(0.10)).otherwise(F.col("_limit"))
    if listed is not None:
        age, day = F.datediff("trade_date", listed), F.col("trade_date")
        reformed = ((F.col("_here") == "STAR") & _during(day, "2019-07-22", None)) | ((F.col("_here") == "ChiNext") & _during(day, "2020-08-24", None))
        limit = F.when(~((reformed & (age < 5)) | ((F.col("_here") == "BSE") & (age < 1))), limit)
    return out.withColumn("price_limit", limit).drop("_here", "_board", "_first", "_last", "_limit")


def lot(board: Column, day: Column) -> Column:
    """Struct of the smallest order and the step above it."""
    make = lambda v: F.struct(F.lit(v[0]).alias("least"), F.lit(v[1]).alias("step"))
    return _by_board(board, day, LOTS, make((100, 100)), make)


def round_shares(shares: Column, board: Column, day: Column) -> Column:
    """Shares of an order after rounding down to its lot; zero below the smallest order."""
    rule = lot(board, day)
    return F.when(shares < rule["least"], F.lit(0)).otherwise(shares - shares % rule["step"]).cast("long")


def stamp_tax(day: Column) -> Column:
    return _pick(day, STAMP_TAX, F.lit(0.0005))


def limit_prices(pre_close: Column, limit: Column) -> Column:
    return F.struct(F.round(pre_close * (1 + limit), 2).alias("up"), F.round(pre_close * (1 - limit), 2).alias("down"))


def tradability(limit: Column) -> Column:
    """Struct (can_buy, can_sell, reason) of a bar; a bar that stays at its limit all day trades one way only.

    Reasons: suspended, bad_pre_close, no_limit, limit_up, limit_down, normal. Null volume counts as none.
    """
    at = limit_prices(F.col("pre_close"), limit)
    sealed_up = F.col("low") >= at["up"] * 0.999
    sealed_down = (F.col("high") < at["up"] * 0.999) & (F.col("high") <= at["down"] * 1.001) & (F.col("low") <= at["down"] * 1.001)
    reason = (
        F.when(F.coalesce("is_suspend", F.lit(False)) | (F.coalesce("volume", F.lit(0)) == 0), "suspended")
        .when(F.col("pre_close").isNull() | (F.col("pre_close") <= 0), "bad_pre_close")
        .when(limit.isNull(), "no_limit").when(sealed_up, "limit_up").when(sealed_down, "limit_down").otherwise("normal")
    )
    return F.struct(reason.isin("no_limit", "limit_down", "normal").alias("can_buy"), reason.isin("no_limit", "limit_up", "normal").alias("can_sell"), reason.alias("reason"))


def execution_price(state: Column, side: Column, order: Column) -> Column:
    """Open for market orders, close for limit orders; null where the side is blocked."""
    allowed = F.when(side == "buy", state["can_buy"]).otherwise(state["can_sell"])
    return F.when(allowed, F.when(order == "market", F.col("open")).otherwise(F.col("close")))


def blocked(side: Column, limit: Column, mean_volume: Column) -> Column:
    """Orders that can't fill: suspended, without a price before, or opening at the limit on little volume (unknown counts as little)."""
    thin = mean_volume.isNull() | (mean_volume <= 0) | (F.col("volume") < mean_volume * 0.1)
    up, down = F.col("pre_close") * (1 + limit) * 0.999, F.col("pre_close") * (1 - limit) * 1.001
    hit = F.when(side == "buy", F.col("open") >= up).otherwise(F.col("open") <= down)
    return F.col("is_suspend") | F.col("pre_close").isNull() | (F.col("pre_close") <= 0) | (F.coalesce(hit, F.lit(False)) & thin)
