"""Data-quality checks: each is bars -> (alert_type, ts_code, trade_date, detail); run() unites them (DQ-01 to DQ-33)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.codes import limit_pct
from barloom.operators import asof
from barloom.operators.windows import by, ratio_to_previous

CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def check(name: str):
    """Registers a check under its alert type; anything that maps bars to alerts may be registered."""

    def add(f):
        CHECKS[name] = f
        return f

    return add


def _unlike(divisor: float = 1.0, most: float = 0.2) -> Column:
    implied = F.col("volume") * F.col("close") / divisor
    return F.abs(F.try_divide(F.col("amount") - implied, implied)) > most


def _outside() -> Column:
    outside = lambda c: ~F.col(c).between(F.col("low") * 0.999, F.col("high") * 1.001)
    return (F.col("high") < F.col("low")) | outside("open") | outside("close")


#: Rules of a bar alone: what breaks them.
RULES: dict[str, Callable[..., Column]] = {
    "ohlc_violation": _outside, "pct_chg_extreme": lambda most=60.0: F.abs("pct_chg") > most, "zero_volume_non_suspend": lambda: (F.col("volume") == 0) & ~F.col("is_suspend"),
    "volume_amount_inconsistent": _unlike, "adj_factor_invalid": lambda: F.col("adj_factor").isNull() | (F.col("adj_factor") <= 0) | (F.col("adj_factor") > 100),
}


def alerts(df: DataFrame, name: str, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("alert_type"), "ts_code", "trade_date", detail.cast("string").alias("detail"))


@check("duplicate_rows")
def duplicate_rows(bars: DataFrame, keys: list[str] = ["ts_code", "trade_date"]) -> DataFrame:  # noqa: B006
    """Keys with more than one row; keys holds ts_code and trade_date, and what else tells rows apart."""
    return alerts(bars.groupBy(*keys).count().where("count > 1"), "duplicate_rows", F.col("count"))


@check("ohlc_violation")
def ohlc_violation(bars: DataFrame) -> DataFrame:
    return alerts(bars.where(RULES["ohlc_violation"]()), "ohlc_violation", F.lit("price outside low..high"))


@check("pct_chg_extreme")
def pct_chg_extreme(bars: DataFrame, most: float = 60.0) -> DataFrame:
    return alerts(bars.where(RULES["pct_chg_extreme"](most)), "pct_chg_extreme", F.lit(f"over {most:g}"))


@check("adj_factor_jump")
def adj_factor_jump(bars: DataFrame, most: float = 0.05) -> DataFrame:
    return alerts(bars.withColumn("_jump", ratio_to_previous("adj_factor")).where(F.col("_jump") > most), "adj_factor_jump", F.lit(f"over {most:g}"))


@check("zero_volume_non_suspend")
def zero_volume(bars: DataFrame) -> DataFrame:
    return alerts(bars.where(RULES["zero_volume_non_suspend"]()), "zero_volume_non_suspend", F.lit("no volume"))


@check("volume_amount_inconsistent")
def volume_amount(bars: DataFrame, divisor: float = 1.0, most: float = 0.2) -> DataFrame:
    return alerts(bars.where(RULES["volume_amount_inconsistent"](divisor, most)), "volume_amount_inconsistent", F.lit("amount off volume x close"))


@check("adj_factor_invalid")
def adj_factor_invalid(bars: DataFrame) -> DataFrame:
    return alerts(bars.where(RULES["adj_factor_invalid"]()), "adj_factor_invalid", F.lit("null or outside 0..100"))


@check("suspended_with_volume")
def suspended_with_volume(bars: DataFrame, most: int = 1000) -> DataFrame:
    return alerts(bars.where(F.col("is_suspend") & (F.col("volume") > most)), "suspended_with_volume", F.col("volume"))


@check("over_limit")
def over_limit(bars: DataFrame) -> DataFrame:
    return alerts(bars.where(F.abs("pct_chg") > limit_pct(F.col("ts_code"), F.col("trade_date")) * 100 + 1), "over_limit", F.lit("over the board's limit"))


@check("volume_spike")
def volume_spike(bars: DataFrame, times: float = 10.0, rows: int = 20) -> DataFrame:
    w = by().rowsBetween(1 - rows, 0)
    full = F.count("*").over(w) == rows
    return alerts(bars.withColumn("_x", full & (F.col("volume") > times * F.avg("volume").over(w))).where("_x"), "volume_spike", F.lit(f"over {times:g} x mean"))


@check("suspected_suspension")
def suspected_suspension(bars: DataFrame) -> DataFrame:
    quiet = ((F.col("volume") == 0) | (F.col("close") == 0)) & (F.col("close") == F.col("_before"))
    return alerts(bars.withColumn("_before", F.lag("close").over(by())).where(quiet), "suspected_suspension", F.lit("close as before"))


def price_logic(bars: DataFrame) -> DataFrame:
    """One row for each broken price rule of each bar, with its severity."""
    rules = [("high_low", "ERROR", F.col("high") < F.col("low")), ("high_open", "ERROR", F.col("high") < F.col("open")), ("high_close", "ERROR", F.col("high") < F.col("close")), ("low_open", "ERROR", F.col("low") > F.col("open")), ("low_close", "ERROR", F.col("low") > F.col("close")), ("non_positive", "CRITICAL", F.least("open", "high", "low", "close") <= 0)]
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("alert_type"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return bars.select("ts_code", "trade_date", F.explode(broken).alias("x")).select("x.*", "ts_code", "trade_date")


def after_delisting(bars: DataFrame, latest: DataFrame, days: int = 30) -> DataFrame:
    late = bars.join(latest, "ts_code").where(F.col("trade_date") > F.date_add("delist_date", days))
    return alerts(late, "delisted_with_future_data", F.col("delist_date"))


def index_dates(membership: DataFrame) -> DataFrame:
    return membership.where(F.col("out_date") < F.col("in_date")).select(F.lit("index_date_invalid").alias("alert_type"), "ts_code", F.col("in_date").alias("trade_date"), F.col("out_date").cast("string").alias("detail"))


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one of the two tables lacks, with the side that has them."""
    return a.select(*keys).join(b, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(b.select(*keys).join(a, keys, "left_anti").withColumn("side", F.lit("b")))


def cross_validate(a: DataFrame, b: DataFrame, tolerance: float = 0.005, column: str = "close") -> DataFrame:
    """Compared rows, mismatches, their share and the largest relative difference of two sources."""
    both = a.select("ts_code", "trade_date", F.col(column).alias("x")).join(b.select("ts_code", "trade_date", F.col(column).alias("y")), ["ts_code", "trade_date"])
    d = F.abs(F.try_divide(F.col("y") - F.col("x"), F.col("x")))
    return both.agg(F.count("*").alias("compared"), F.count_if(d > tolerance).alias("mismatches"), F.round(F.avg(F.when(d > tolerance, 1.0).otherwise(0.0)), 6).alias("share"), F.round(F.max(d), 6).alias("largest"))


def _steps(bars: DataFrame, calendar: DataFrame, day: str) -> tuple[asof.Days, DataFrame]:
    """Each key's days, once each, with the next one, and of the calendar's days between them the place of the first and their number."""
    days = asof.Days(calendar.select(F.col("cal_date").alias("t")))
    rows = bars.withColumn("_next", F.lead(day).over(by(day=day)))
    start, end = days.before(F.col(day)), days.before(F.date_sub("_next", 1))
    return days, rows.withColumns({"_start": start, "_n": F.when(F.col("_next").isNull(), 0).otherwise(F.greatest(end - start, F.lit(0)))})


def completeness(bars: DataFrame, calendar: DataFrame, day: str = "trade_date", keys: DataFrame | None = None) -> DataFrame:
    """Trading days that each key misses between its first and last bar; with keys also keys without any bar, which miss them all.

    What lies between two bars is a difference of two counts of calendar days, so no row is made for a day, present or missing.
    """
    days, steps = _steps(bars, calendar, day)
    each = steps.groupBy("ts_code").agg(F.sum("_n").alias("missing"), F.min(F.when(F.col("_n") > 0, F.col("_start"))).alias("_at")).where("missing > 0")
    found = each.select("ts_code", "missing", days.at(F.col("_at")).alias("first_missing"))
    if keys is None:
        return found
    none = keys.select("ts_code").distinct().join(bars.select("ts_code").distinct(), "ts_code", "left_anti")
    return found.unionByName(none.select("ts_code", days.before(F.lit("9999-12-31").cast("date")).cast("long").alias("missing"), days.at(F.lit(0)).alias("first_missing")))


def completeness_findings(bars: DataFrame, calendar: DataFrame, keys: DataFrame | None = None, most: int = 5) -> DataFrame:
    """ts_code, missing and severity: ERROR for a key without any bar, WARNING for over `most` missing days, else INFO."""
    found = completeness(bars, calendar, keys=keys)
    seen = bars.select("ts_code").distinct().withColumn("_seen", F.lit(True))
    severity = F.when(F.col("missing") > most, "WARNING").otherwise("INFO")
    if keys is not None:
        found = found.join(seen, "ts_code", "left")
        severity = F.when(F.col("_seen").isNull(), "ERROR").otherwise(severity)
    return found.select("ts_code", "missing", severity.alias("severity"))


def fill_missing(bars: DataFrame, calendar: DataFrame, day: str = "trade_date") -> DataFrame:
    """Bars with a suspended row, at the last close, for each calendar day that is missing between a key's bars.

    Rows are made for missing days only. Bars on other days than the calendar's stay.
    """
    days, steps = _steps(bars, calendar, day)
    carried = F.last("close", True).over(by(day=day).rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.select("ts_code", day, carried.alias("close"), F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("is_suspend", F.lit(True)).alias("is_suspend"), F.col("close").isNull().alias("filled"), "_start", "_n")
    made = rows.where("_n > 0").select("ts_code", F.explode(days.some(F.col("_start"), F.col("_n"))).alias(day), "close", F.lit(0).cast(rows.schema["volume"].dataType).alias("volume"), F.lit(True).alias("is_suspend"), F.lit(True).alias("filled"))
    return rows.drop("_start", "_n").unionByName(made)


def run(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [CHECKS[n](bars) for n in names or CHECKS])


def summary(found: DataFrame, times: str | None = None) -> DataFrame:
    """Alerts and keys of each type; times: the column with how many alerts a row stands for."""
    return found.groupBy("alert_type").agg((F.count("*") if times is None else F.sum(times)).alias("n"), F.countDistinct("ts_code").alias("keys"))


def score(errors: Column, warnings: Column, infos: Column) -> Column:
    return F.greatest(F.lit(100) - errors * 30 - warnings * 10 - infos * 2, F.lit(0))


def repair(bars: DataFrame) -> DataFrame:
    """Non-positive prices become null, then the last known price."""
    from barloom.operators.windows import ffill

    prices = ["open", "high", "low", "close"]
    return ffill(bars.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in prices}), prices)
