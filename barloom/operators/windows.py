"""Rolling and gap operators over keyed series (W-01 to W-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, DAY = "ts_code", "trade_date"


def by(key: str = KEY, day: str = DAY) -> Window:
    return Window.partitionBy(key).orderBy(day)


def rolling_return(bars: DataFrame, windows=(5, 10, 20, 60), compat: bool = False) -> DataFrame:
    """Compound returns over the last w rows with volume, for rows past the longest window.

    compat filters before the windows are taken, so the first kept row sees itself alone.
    """
    rows = bars.where((F.col("volume") > 0) & F.col("pct_chg").isNotNull() & (F.col("pct_chg") > -100)).withColumn("rn", F.row_number().over(by()))
    grown = F.log1p(F.col("pct_chg") / 100)
    kept = F.col("rn") >= max(windows)
    rows = rows.where(kept) if compat else rows
    out = rows.select(KEY, DAY, "rn", *[F.round(F.exp(F.sum(grown).over(by().rowsBetween(1 - w, 0))) - 1, 4).alias(f"ret_{w}") for w in windows])
    return out.where(kept).drop("rn")


def rolling_mean(bars: DataFrame, windows=(5, 20), column: str = "close") -> DataFrame:
    return bars.select(KEY, DAY, *[F.round(F.avg(column).over(by().rowsBetween(1 - w, 0)), 2).alias(f"ma_{w}") for w in windows])


def rolling_vol(bars: DataFrame, windows=(20, 60), column: str = "pct_chg") -> DataFrame:
    return bars.select(KEY, DAY, *[F.round(F.stddev_samp(column).over(by().rowsBetween(1 - w, 0)), 4).alias(f"vol_{w}") for w in windows])


def ratio_to_previous(column: str) -> Column:
    before = F.lag(column).over(by())
    return F.abs(F.try_divide(F.col(column) - before, before))


def ffill(df: DataFrame, columns: list[str], key: str = KEY, order: str = DAY, limit: int | None = None) -> DataFrame:
    """Last non-null values, at most limit rows old."""
    reach = Window.unboundedPreceding if limit is None else -limit
    w = Window.partitionBy(key).orderBy(order).rowsBetween(reach, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate(df: DataFrame, column: str, key: str = KEY, order: str = DAY, limit: int = 10) -> DataFrame:
    """Linear interpolation over rows, at most limit rows after the last value."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col(column).isNotNull(), F.col("_rn"))
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumns({"_i": F.last(mark, True).over(back), "_j": F.first(mark, True).over(ahead), "_a": F.last(column, True).over(back), "_b": F.first(column, True).over(ahead)})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rn") - F.col("_i")) / (F.col("_j") - F.col("_i"))
    return rows.withColumn(column, F.when(F.col(column).isNull() & (F.col("_rn") - F.col("_i") <= limit), line).otherwise(F.col(column))).drop("_rn", "_i", "_j", "_a", "_b")


def gaps(df: DataFrame, key: str = KEY, day: str = DAY, step: int = 7) -> DataFrame:
    """Gaps of more than step days between rows: up to 5 steps minor, up to 10 moderate, else severe."""
    rows = df.select(key, day, F.lag(day).over(by(key, day)).alias("after")).withColumn("days", F.datediff(day, "after")).where(F.col("days") > step)
    return rows.withColumn("severity", F.when(F.col("days") <= 5 * step, "minor").when(F.col("days") <= 10 * step, "moderate").otherwise("severe"))


def runs(df: DataFrame, flag: str, key: str = KEY, order: str = DAY) -> DataFrame:
    """Maximal runs of rows whose flag holds, as (key, first_day, last_day, n_rows)."""
    w = by(key, order)
    marked = df.select(key, order, F.coalesce(F.col(flag), F.lit(False)).alias("f")).withColumn("island", F.sum(F.when(F.col("f"), 0).otherwise(1)).over(w))
    return marked.where("f").groupBy(key, "island").agg(F.min(order).alias("first_day"), F.max(order).alias("last_day"), F.count("*").alias("n_rows")).drop("island")


def validity(versions: DataFrame, key: str = KEY, day: str = "eff_date") -> DataFrame:
    """Versions with the day on which the next one takes over."""
    return versions.withColumn("valid_to", F.lead(day).over(by(key, day)))


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order; Spark prunes within partitions before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_usable(bars: DataFrame) -> DataFrame:
    """Each key's last day if its bar has a price and volume, else the day before if that one has, else null."""
    near = bars.withColumn("_m", F.max(DAY).over(Window.partitionBy(KEY))).where(F.col(DAY) >= F.date_sub("_m", 1))
    good = (F.col("close") > 0) & (F.col("volume") >= 0)
    return near.groupBy(KEY).agg(F.max(F.when(good, F.col(DAY))).alias("last_day"))


def last_days(bars: DataFrame, progress: DataFrame) -> DataFrame:
    """Each key's day of progress, or its last bar's where it has none."""
    last = bars.groupBy(KEY).agg(F.max(DAY).alias("_m")).join(progress, KEY, "left")
    return last.select(KEY, F.coalesce("last_sync_date", "_m").alias("last_day"))


def stratified(df: DataFrame, stratum: str, key: str, share: int = 10) -> DataFrame:
    """One row in `share` of each stratum, and one more; the same rows every time, in order of the key's MD5."""
    n = F.count("*").over(Window.partitionBy(stratum))
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("binary")), key))
    rows = df.withColumns({"_n": n, "_rn": rn})
    return rows.where(F.col("_rn") <= F.greatest(F.lit(1), F.least(F.col("_n"), F.floor(F.col("_n") / share) + 1))).drop("_n", "_rn")


def sampled(df: DataFrame, share: float, *keys: str) -> DataFrame:
    """Rows whose keys' MD5 is in the lowest share of all, or the lowest, so there is one at least; the same rows every time."""
    edge = f"{int(share * 16**32):032x}"
    digest = F.md5(F.concat(*[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.where((digest < edge) | (digest == df.agg(F.min(digest)).scalar()))


def trailing(bars: DataFrame, end: str, n: int, step: int = 1) -> DataFrame:
    """The last n rows of each key up to a day, looked for in twice as many days (a bar every step days)."""
    last = F.lit(end).cast("date")
    rows = bars.where((F.col(DAY) <= last) & (F.col(DAY) > F.date_sub(last, 2 * n * step)))
    rn = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col(DAY).desc()))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
