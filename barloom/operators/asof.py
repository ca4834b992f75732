"""As-of and interval joins without look-ahead (J-05 to J-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """left with the columns of the last right row at or (strict) before its time; null where there is none.

    Both sides are united and one sorted window carries the last right row forward: a shuffle on the key, no pairs.
    Rows of right at the same time: the one whose columns sort last is the last.
    """
    carried = [c for c in left.columns if c not in on]
    side, value = F.lit(1 if not strict else 0), F.struct(*columns)
    r = right.select(*on, F.col(right_time).alias("_time"), side.alias("_side"), value.alias("_value"), F.lit(None).cast(left.select(F.struct(*carried)).schema[0].dataType).alias("_row"))
    l_side = F.lit(2 if not strict else -1)
    both = left.select(*on, F.col(left_time).alias("_time"), l_side.alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct(*carried).alias("_row")).unionByName(r)
    w = Window.partitionBy(*on).orderBy("_time", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_row is not null")
    return out.select(*on, "_row.*", "_value.*")


class Days:
    """A list of days (t), small by nature, as one array for the whole plan, with the number of them at or before any day.

    That number is a running count over the calendar between the first and the last of them, so making it costs a row for
    each calendar day, however many days are asked about.
    """

    def __init__(self, dates: DataFrame):
        asked = dates.select(F.col("t").cast("date").alias("t")).where("t is not null").distinct()
        ends = asked.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
        each = ends.select(F.explode(F.sequence("a", "b")).alias("day"), F.lit(0).alias("n")).unionByName(asked.select(F.col("t").alias("day"), F.lit(1).alias("n")))
        counted = each.groupBy("day").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("day")))
        rows = F.array_sort(F.collect_list(F.struct("day", F.col("upto").cast("int").alias("upto"), "n")))
        known = counted.agg(rows.alias("rows")).select(F.transform(F.filter("rows", lambda r: r["n"] > 0), lambda r: r["day"]).alias("days"), F.transform("rows", lambda r: r["upto"]).alias("upto"))
        self.known = known.select(F.struct("days", "upto").alias("x")).scalar()

    def before(self, day: Column) -> Column:
        """How many of the days lie at or before a day."""
        since = F.datediff(day, F.get(self.known["days"], F.lit(0)))
        n = F.get(self.known["upto"], F.least(since, F.size(self.known["upto"]) - 1))
        return F.when(since < 0, 0).otherwise(F.coalesce(n, F.lit(0)))

    def at(self, place: Column) -> Column:
        return F.get(self.known["days"], place)

    def some(self, start: Column, n: Column) -> Column:
        return F.slice(self.known["days"], start + 1, F.greatest(n, F.lit(0)))


def on_days(intervals: DataFrame, dates: DataFrame, first: Column, last: Column) -> DataFrame:
    """intervals once for each day t of dates from first to last, both inclusive; open where last is null, none where first is.

    An interval finds its slice of the days by arithmetic, so only rows that are returned are made.
    """
    days = Days(dates)
    low, high = days.before(F.date_sub(first, 1)), days.before(F.coalesce(last, F.lit("9999-12-31").cast("date")))
    return intervals.withColumn("t", F.explode(F.when(first.isNotNull(), days.some(low, high - low))))


def count_active(intervals: DataFrame, dates: DataFrame, first: Column, last: Column) -> DataFrame:
    """(t, n): how many intervals hold on each day of dates, by a sweep; days on which none does are left out.

    An interval is two rows, +1 on its first day and -1 behind its last, which are summed by day before the running sum over
    days. Where intervals of a key don't overlap, as versions of one don't, this is the number of distinct keys.
    """
    held = intervals.where(first.isNotNull() & (last.isNull() | (last >= first)))
    moves = held.select(F.explode(F.array(F.struct(first.alias("day"), F.lit(1).alias("n")), F.struct(F.date_add(last, 1).alias("day"), F.lit(-1).alias("n")))).alias("x")).select("x.*").where("day is not null")
    asked = dates.select(F.col("t").cast("date").alias("day"), F.lit(0).alias("n"), F.lit(True).alias("asked")).where("day is not null")
    by_day = moves.groupBy("day").agg(F.sum("n").alias("n")).withColumn("asked", F.lit(False)).unionByName(asked)
    total = by_day.groupBy("day").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")).withColumn("n", F.sum("n").over(Window.orderBy("day")))
    return total.where("asked and n > 0").select(F.col("day").alias("t"), "n")


def active(versions: DataFrame, dates: DataFrame, day: str = "eff_date", key: str = "ts_code", until: str = "valid_to") -> DataFrame:
    """Every date with the version of each key that holds on it. dates is a list of days, small by nature."""
    return on_days(versions, dates, F.col(day), F.date_sub(F.col(until), 1))


def members(membership: DataFrame, dates: DataFrame) -> DataFrame:
    """Members on each date; out_date is inclusive and open where null."""
    return on_days(membership, dates, F.col("in_date"), F.col("out_date"))
