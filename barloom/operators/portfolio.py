"""Weights, costs, performance and attribution over tables (R-01 to R-17)."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.codes import stamp_tax


def constrain(weights: DataFrame, low: float = 0.005, high: float = 0.10) -> DataFrame:
    """Drops small weights, caps large ones, then scales each date to one (so a weight may pass the cap again)."""
    kept = weights.where(F.col("weight") >= low).withColumn("weight", F.least("weight", F.lit(high)))
    return kept.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("trade_date"))))


def equal_weight(scores: DataFrame, n: int = 50) -> DataFrame:
    w = Window.partitionBy("trade_date").orderBy(F.col("score").desc(), "ts_code")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("trade_date")))


def costs(trades: DataFrame) -> DataFrame:
    """Commission of 0.03 % (5 at least), stamp tax on sales by date, slippage of 0.1 %, their total and the net amount.

    Money is decimal: the amount in hundredths, the costs exact until they are rounded. A buyer pays the costs on top of the
    amount, a seller gets what they leave of it.
    """
    amount, rate = F.col("amount").cast("decimal(18,2)"), lambda r: F.lit(Decimal(r))
    tax = F.when(F.col("side") == "sell", amount * stamp_tax(F.col("trade_date")).cast("decimal(6,4)")).otherwise(rate("0"))
    out = trades.withColumns({"commission": F.greatest(amount * rate("0.0003"), rate("5")), "tax": tax, "slippage": amount * rate("0.001")})
    total = F.col("commission") + F.col("tax") + F.col("slippage")
    return out.withColumn("total_cost", total).withColumn("net_amount", F.when(F.col("side") == "sell", amount - total).otherwise(amount + total))


def nav(returns: DataFrame, group: str = "portfolio", day: str = "trade_date") -> DataFrame:
    w = Window.partitionBy(group).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)


def metrics(returns: DataFrame, group: str = "portfolio", periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """Return, volatility, Sharpe, drawdown and, against the column bench, tracking error, information ratio, beta, alpha."""
    year, active = math.sqrt(periods), F.col("ret") - F.col("bench")
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    return nav(returns, group).groupBy(group).agg(
        total.alias("total_return"), (F.pow(total + 1, F.lit(float(periods)) / F.count("*")) - 1).alias("annual_return"), (F.stddev_samp("ret") * year).alias("annual_vol"),
        (F.try_divide(F.avg("ret") - risk_free / periods, F.stddev_samp("ret")) * year).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        (F.stddev_samp(active) * year).alias("tracking_error"), (F.try_divide(F.avg(active), F.stddev_samp(active)) * year).alias("information_ratio"),
        F.regr_slope("ret", "bench").alias("beta"), (F.regr_intercept("ret", "bench") * periods).alias("alpha"),
    )


def brinson(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Allocation, selection and interaction of each date's sectors, from (trade_date, side, sector, asset, weight) and (trade_date, side, asset, ret)."""
    each = weights.join(returns, ["trade_date", "side", "asset"]).groupBy("trade_date", "sector", "side").agg(F.sum("weight").alias("w"), F.avg(F.when(F.col("weight") > 0, F.col("ret"))).alias("r"))
    at = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0.0))
    s = each.groupBy("trade_date", "sector").agg(at("portfolio", "w").alias("pw"), at("portfolio", "r").alias("pr"), at("benchmark", "w").alias("bw"), at("benchmark", "r").alias("br"))
    total = F.sum(F.col("bw") * F.col("br")).over(Window.partitionBy("trade_date"))
    return s.select("trade_date", "sector", ((F.col("pw") - F.col("bw")) * (F.col("br") - total)).alias("allocation"), (F.col("bw") * (F.col("pr") - F.col("br"))).alias("selection"), ((F.col("pw") - F.col("bw")) * (F.col("pr") - F.col("br"))).alias("interaction"))


def turnover(weights: DataFrame, group: str = "portfolio") -> DataFrame:
    """One-sided turnover between consecutive dates."""
    days = weights.select(group, "trade_date").distinct().withColumn("next_date", F.lead("trade_date").over(Window.partitionBy(group).orderBy("trade_date")))
    before = weights.join(days, [group, "trade_date"]).where("next_date is not null").select(group, F.col("next_date").alias("trade_date"), "ts_code", (-F.col("weight")).alias("weight"))
    after = weights.join(days.select(group, F.col("next_date").alias("trade_date")).where("trade_date is not null"), [group, "trade_date"]).select(group, "trade_date", "ts_code", "weight")
    return after.unionByName(before).groupBy(group, "trade_date", "ts_code").agg(F.sum("weight").alias("d")).groupBy(group, "trade_date").agg((F.sum(F.abs("d")) / 2).alias("turnover"))


def longest_drawdown(navs: DataFrame, group: str = "portfolio", day: str = "trade_date", least: float = 1e-9) -> DataFrame:
    """Longest run of rows below the highest value so far; zero where there is none."""
    from barloom.operators.windows import runs

    found = runs(navs.withColumn("_under", F.col("drawdown") < -least), "_under", group, day).groupBy(group).agg(F.max("n_rows").alias("longest"))
    return navs.select(group).distinct().join(found, group, "left").select(group, F.coalesce("longest", F.lit(0)).alias("longest"))


def summary(navs: DataFrame, group: str = "portfolio", day: str = "trade_date") -> DataFrame:
    return navs.groupBy(group).agg(F.count("*").alias("n_days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max_by("nav", day).alias("final_nav"), F.min("drawdown").alias("max_drawdown"))


def yearly(returns: DataFrame, group: str = "portfolio", day: str = "trade_date", periods: int = 252) -> DataFrame:
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    return returns.groupBy(group, F.year(day).cast("long").alias("y")).agg(total.alias("total_return"), (F.stddev_samp("ret") * math.sqrt(periods)).alias("annual_vol"))


def run_strategy(frames: DataFrame, strategy, schema: str = "trade_date date, ts_code string, weight double") -> DataFrame:
    """Weights by a function of each date's rows (a pandas frame); prefer column expressions where they can say it."""
    return frames.groupBy("trade_date").applyInPandas(strategy, schema)
