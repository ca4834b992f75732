"""Keyed merges and partitioned writes on Parquet (S-03 to S-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.codes import liability_ratio
from barloom.operators.windows import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new: twice gives the same as once."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def derived_factors(statements: DataFrame) -> DataFrame:
    """The factors of financial statements, by (ts_code, end_date): saved with the statements, under the same keys.

    statements: ts_code, end_date, roe_avg, asset_to_equity, net_profit; roic and gross_margin are taken over where they are there.
    """
    also = [c for c in ("roic", "gross_margin") if c in statements.columns]
    return statements.select("ts_code", "end_date", F.col("roe_avg").alias("roe"), *also, liability_ratio(F.col("asset_to_equity")).alias("asset_liability_ratio"), "net_profit")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def overwrite_range(old: DataFrame, new: DataFrame, key: str, day: str) -> DataFrame:
    """Rows of old in each key's range of days in new give way to new."""
    span = new.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    hit = (old[key] == span[key]) & old[day].between(F.col("_a"), F.col("_b"))
    return old.join(span, hit, "left_anti").unionByName(new)


def keep_last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the parts in which the last part that has a key wins."""
    out = parts[0].withColumn("_age", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("_age", F.lit(n)))
    return latest(out, keys, F.col("_age").desc()).drop("_age")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first source, in priority order, that has any."""
    from pyspark.sql import Window

    out = sources[0].withColumn("priority", F.lit(0))
    for n, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("priority", F.lit(n)))
    return out.withColumn("_best", F.min("priority").over(Window.partitionBy(key))).where("priority = _best").drop("_best")


def merge_progress(progress: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """Progress of each key: latest day and total rows; a batch that was merged before changes nothing."""
    one = batch.groupBy("ts_code").agg(F.max("trade_date").alias("_day"), F.count("*").alias("_n")).withColumn("_id", F.lit(batch_id))
    both = progress.join(one, "ts_code", "full_outer")
    known = F.coalesce(F.col("last_batch") == F.col("_id"), F.lit(False))
    total = F.coalesce("total_records", F.lit(0)) + F.when(known, 0).otherwise(F.coalesce("_n", F.lit(0)))
    return both.select("ts_code", F.greatest("last_date", "_day").alias("last_date"), total.alias("total_records"), F.coalesce("_id", "last_batch").alias("last_batch"))


def write_by_year(df: DataFrame, path: str, day: str = "trade_date", codec: str = "zstd") -> None:
    """A folder for each year; rows are dealt by year to as many tasks as their bytes need, so files stay few and large."""
    df.withColumn("year", F.year(day)).hint("rebalance", "year").write.mode("overwrite").option("compression", codec).partitionBy("year").parquet(path)


def read_years(spark, path: str, first: str, last: str, day: str = "trade_date") -> DataFrame:
    """Visits only the folders of the years between the two days."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("year").between(int(first[:4]), int(last[:4])) & F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).drop("year")


def tier(day, today: str):
    age = F.year(F.lit(today).cast("date")) - F.year(day)
    return F.when(age <= 2, "hot").when(age <= 5, "warm").otherwise("cold")
