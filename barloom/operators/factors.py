"""Cross-sectional and time-series factors (K-01 to K-13)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import by


def each_date():
    return Window.partitionBy("trade_date")


def adjusted(bars: DataFrame) -> DataFrame:
    return bars.withColumn("adj", F.col("close") * F.col("adj_factor"))


def momentum(bars: DataFrame, n: int = 20) -> DataFrame:
    return adjusted(bars).select("ts_code", "trade_date", (F.try_divide("adj", F.lag("adj", n).over(by())) - 1).alias("momentum")).where("momentum is not null")


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    w = by().rowsBetween(1 - n, 0)
    out = bars.where("volume > 0").select("ts_code", "trade_date", F.when(F.count("pct_chg").over(w) == n, F.stddev_samp(F.col("pct_chg") / 100).over(w) * math.sqrt(252)).alias("volatility"))
    return out.where("volatility is not null")


def amihud(bars: DataFrame, n: int = 20) -> DataFrame:
    w = by().rowsBetween(1 - n, 0)
    return bars.select("ts_code", "trade_date", F.avg(F.try_divide(F.abs("pct_chg") / 100, "amount")).over(w).alias("amihud"))


def medians(df: DataFrame, group: list[str], column: str, name: str = "median", cells: int = 1024, passes: int = 2) -> DataFrame:
    """(group, name): the exact median of a column's values in each group; groups without values or keys have no row.

    A group's values are never gathered. Each pass counts the values of a group in equal cells between its bounds and keeps
    the bounds, as values, of the cell that holds the middle rank; of two where the two middle ranks of an even count
    part. What is left after the passes, a cell of a cell, is counted value by value.
    """
    rows = df.select(*group, F.col(column).cast("double").alias("_v")).where("_v is not null")
    ends = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ends = ends.select(*group, "_lo", "_hi", F.floor((F.col("_n") - 1) / 2).alias("_k1"), F.floor(F.col("_n") / 2).alias("_k2"))
    key = [*group, "_lo", "_k1", "_k2"]
    for last in [False] * passes + [True]:
        inside = rows.join(ends, group).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        small = [F.col(c) * 2.0**-40 for c in ("_v", "_lo", "_hi")]  # so that no difference of two values overflows
        cell = F.col("_v") if last else F.width_bucket(*small, F.lit(cells))
        counts = inside.groupBy(*key, cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_below", upto - F.col("_n"))
        k1, k2 = (F.when(F.col(k).between(F.col("_below"), F.col("_below") + F.col("_n") - 1), F.col(k) - F.col("_below")) for k in ("_k1", "_k2"))
        ends = counts.select(*group, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), k1.alias("_k1"), k2.alias("_k2")).where("_k1 is not null or _k2 is not null")
    return ends.groupBy(*group).agg(F.avg("_lo").alias(name))


def winsorize_mad(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Values within threshold median absolute deviations of their date's median; rows without a value or a date stay as they are."""
    rows = df.join(medians(df, ["trade_date"], column, "_m"), "trade_date", "left")
    away = rows.select("trade_date", F.abs(F.col(column) - F.col("_m")).alias("_x"))
    reach = F.col("_d") * threshold * 1.4826
    rows = rows.join(medians(away, ["trade_date"], "_x", "_d"), "trade_date", "left")
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.col("_m") + reach), F.col("_m") - reach))).drop("_m", "_d")


def zscore(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.try_divide(F.col(column) - F.avg(column).over(each_date()), F.stddev_samp(column).over(each_date())))


def neutralize(df: DataFrame, column: str, size: str, industry: str) -> DataFrame:
    """Residual of the column on size and industry dummies: both are centred within industries, then regressed."""
    group = Window.partitionBy("trade_date", "_i")
    rows = df.withColumn("_i", F.coalesce(industry, F.lit("other")))
    y, x = F.col(column) - F.avg(column).over(group), F.col(size) - F.avg(size).over(group)
    rows = rows.withColumns({"_y": y, "_x": x})
    slope = F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(each_date()), F.sum(F.col("_x") * F.col("_x")).over(each_date()) + 1e-6)
    return rows.withColumn(column, F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")).drop("_i", "_x", "_y")


def rank_ic(df: DataFrame, factor: str, ret: str, group: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks, date by date (or group by group)."""
    group = group or ["trade_date"]

    def rank(c):
        return F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2

    both = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    return both.select(*group, rank(factor).alias("a"), rank(ret).alias("b")).groupBy(*group).agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n"))


def quantile_returns(df: DataFrame, factor: str, ret: str, n: int = 5) -> DataFrame:
    q = df.withColumn("quantile", F.ntile(n).over(each_date().orderBy(factor, "ts_code")))
    return q.groupBy("trade_date", "quantile").agg(F.avg(ret).alias("mean_ret"), F.count("*").alias("n"))


def long_short(df: DataFrame, factor: str, ret: str, n: int = 5) -> DataFrame:
    """Each date's mean return of the highest quantile less that of the lowest."""
    leg = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_ret")))
    return quantile_returns(df, factor, ret, n).groupBy("trade_date").agg((leg(n) - leg(1)).alias("long_short"))


def ic_decay(bars: DataFrame, factor: str, horizons: tuple[int, ...] = (1, 2, 3, 4, 5), price: str = "close", least: int = 5) -> DataFrame:
    """Mean rank IC, its ratio to its deviation (ICIR) and the number of dates, for returns 1 to 5 rows ahead.

    Dates with fewer than least codes don't count.
    """
    ahead = [F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead(price, h).over(by()), price) - 1).alias("ret")) for h in horizons]
    rows = bars.select("trade_date", F.col(factor).alias("_f"), F.array(*ahead).alias("_a")).select("trade_date", "_f", F.explode("_a").alias("x")).select("trade_date", "_f", "x.*")
    ic = rank_ic(rows, "_f", "ret", ["trade_date", "horizon"]).where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    return ic.groupBy("horizon").agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.count("*").alias("n"))


def mean_turnover(bars: DataFrame, n: int = 20, column: str = "volume") -> DataFrame:
    return bars.select("ts_code", "trade_date", F.avg(column).over(by().rowsBetween(1 - n, 0)).alias(f"turnover_{n}"))


def reversal_and_size(bars: DataFrame, n: int = 5, size: str = "amount") -> DataFrame:
    """The negated return of the last n rows, and the log of a size column."""
    back = F.try_divide("close", F.lag("close", n).over(by())) - 1
    return bars.select("ts_code", "trade_date", (-back).alias("reversal"), F.ln(size).alias("size"))


def monthly_universe(bars: DataFrame, n: int) -> DataFrame:
    """The n codes with the highest amount in each month."""
    month = bars.groupBy(F.to_date(F.trunc("trade_date", "month")).alias("month"), "ts_code").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("a"))
    w = Window.partitionBy("month").orderBy(F.col("a").desc(), "ts_code")
    return month.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("month", "ts_code")
