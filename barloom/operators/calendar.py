"""Trading calendars (D-01 to D-06)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed holidays (month-day) of the rule calendar; give your own dates for moving ones.
HOLIDAYS = ("01-01", "05-01", "10-01")

#: Fixed closures of the exchange, first and last day, by year; those of 2027 are a forecast.
EXCHANGE_CLOSURES = """
2018: 01-01, 02-15..02-21, 04-05..04-07, 04-29..05-01, 06-18, 09-24..09-25, 10-01..10-07
2019: 01-01, 02-04..02-10, 04-05, 05-01..05-04, 06-07, 09-13..09-15, 10-01..10-07
2020: 01-01, 01-24..01-30, 04-04..04-06, 05-01..05-05, 06-25..06-27, 10-01..10-08
2021: 01-01, 02-11..02-17, 04-03..04-05, 05-01..05-05, 06-14, 09-20..09-21, 10-01..10-07
2022: 01-01..01-03, 01-31..02-06, 04-04..04-05, 04-30..05-04, 06-03..06-05, 09-10..09-12, 10-01..10-07
2023: 01-01..01-02, 01-21..01-27, 04-05, 04-29..05-03, 06-22..06-24, 09-29, 10-01..10-06
2024: 01-01, 02-09..02-16, 04-04..04-06, 05-01..05-05, 06-10, 09-15..09-17, 10-01..10-07
2025: 01-01, 01-28..02-04, 04-04..04-06, 05-01..05-05, 05-31..06-02, 10-01..10-08
2026: 01-01..01-02, 02-16..02-22, 04-05..04-07, 05-01..05-05, 06-19..06-21, 10-01..10-08
2027: 01-01, 02-06..02-12, 04-05, 05-01..05-03, 06-09..06-11, 10-01..10-07
"""


def closures() -> list[tuple[date, date]]:
    """First and last day of each closure of the exchange."""
    out = []
    for line in EXCHANGE_CLOSURES.split("\n"):
        year, _, spans = line.partition(": ")
        for span in filter(None, spans.split(", ")):
            first, _, last = span.partition("..")
            out.append((date.fromisoformat(f"{year}-{first}"), date.fromisoformat(f"{year}-{last or first}")))
    return out


def exchange_holidays(spark: SparkSession) -> DataFrame:
    """cal_date: the exchange's closed days, 2018 to 2027, for build()."""
    spans = spark.createDataFrame(closures(), "a date, b date")
    return spans.select(F.explode(F.sequence("a", "b")).alias("cal_date"))


def build(bounds: DataFrame, holidays: DataFrame | tuple[str, ...] = HOLIDAYS, first: str = "a", last: str = "b") -> DataFrame:
    """One row for each day between the two dates of the one-row frame, with trading and period-end flags.

    holidays is a table of the exchange's closed days (cal_date), or days (month-day) that are closed in every year.
    """
    days = bounds.select(F.explode(F.sequence(first, last)).alias("cal_date"))
    if isinstance(holidays, DataFrame):
        days = days.join(holidays.select("cal_date").distinct().withColumn("_closed", F.lit(True)), "cal_date", "left").withColumn("_closed", F.coalesce("_closed", F.lit(False)))
    else:
        days = days.withColumn("_closed", F.date_format("cal_date", "MM-dd").isin(*holidays))
    trading = F.dayofweek("cal_date").between(2, 6) & ~F.col("_closed")
    month = F.last_day("cal_date") == F.col("cal_date")
    return days.withColumns({"is_trading_day": trading, "month_end_flag": month, "quarter_end_flag": month & (F.month("cal_date") % 3 == 0), "year_end_flag": month & (F.month("cal_date") == 12)}).drop("_closed")


def neighbours(calendar: DataFrame) -> DataFrame:
    """Previous and next trading day of every calendar day. A calendar is small (a row a day), so one window is right."""
    day = F.when(F.col("is_trading_day"), F.col("cal_date"))
    w = Window.orderBy("cal_date")
    before = F.last(day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(day, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return calendar.withColumns({"prev_trade_date": before, "next_trade_date": after})


def rebalance_days(calendar: DataFrame, rule: str = "last_trading_day") -> DataFrame:
    """Days of rule ME (calendar month ends that trade), W-FRI, D, or the last trading day of each month."""
    open_days = calendar.where("is_trading_day")
    if rule == "ME":
        return open_days.where(F.last_day("cal_date") == F.col("cal_date")).select("cal_date")
    if rule == "W-FRI":
        return open_days.where(F.dayofweek("cal_date") == 6).select("cal_date")
    if rule == "D":
        return open_days.select("cal_date")
    return open_days.groupBy(F.trunc("cal_date", "month").alias("m")).agg(F.max("cal_date").alias("cal_date")).select("cal_date")
