"""Security lifetimes: status on a date, successors, warnings, version logs and their audits (M-05 to M-26, T-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import codes
from barloom.operators import asof
from barloom.operators.windows import by


def nested(history: DataFrame) -> DataFrame:
    """One row a security, with its status events as an array in date order."""
    event = F.struct(F.col("eff_date").alias("day"), "status")
    return history.groupBy("ts_code").agg(F.min("list_date").alias("list_date"), F.max("delist_date").alias("delist_date"), F.array_sort(F.collect_list(event)).alias("events"))


def status_on(lifetimes: DataFrame, dates: DataFrame) -> DataFrame:
    """Every security on every date with its status (not_listed, delisted, or the last event's) and whether it may trade.

    dates gives the days as t; they are gathered in one array, small by nature. Events meet them in one as-of window.
    """
    rows = lifetimes.select("ts_code", "list_date", "delist_date", F.explode(dates.agg(F.collect_set("t")).scalar()).alias("t"))
    events = lifetimes.select("ts_code", F.explode("events").alias("_e")).select("ts_code", F.col("_e.day").alias("_day"), F.col("_e.status").alias("_seen"))
    out = asof.join(rows, events, ["ts_code"], "t", "_day", ["_seen"])
    status = F.when(F.col("t") < F.col("list_date"), "not_listed").when(F.col("delist_date") <= F.col("t"), "delisted").otherwise(F.col("_seen"))
    out = out.withColumn("status", status).drop("_seen")
    return out.withColumn("is_tradable", ~F.col("status").isin("not_listed", "delisted"))


def flag_intervals(log: DataFrame, flag: str, key: str = "ts_code", day: str = "eff_date") -> DataFrame:
    """(key, start_date, end_date) of each run of flagged rows; it ends the day before the next row without the flag, open where there is none."""
    w = by(key, day)
    marked = log.select(key, day, F.coalesce(F.col(flag), F.lit(False)).alias("f"))
    marked = marked.withColumns({"start": F.col("f") & ~F.coalesce(F.lag("f").over(w), F.lit(False)), "end": F.first(F.when(~F.col("f"), F.col(day)), True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    return marked.where("start").select(key, F.col(day).alias("start_date"), F.date_sub("end", 1).alias("end_date"))


def transitions(log: DataFrame, column: str, key: str = "ts_code", day: str = "eff_date") -> DataFrame:
    """Rows on which a column's value changes, with the value before."""
    return log.select(key, day, F.lag(column).over(by(key, day)).alias("before"), F.col(column).alias("after")).where("before is not null and before != after")


def warnings(latest_rows: DataFrame, dates: DataFrame, days: int = 30) -> DataFrame:
    """Securities that leave within some days of a date, and how urgent that is."""
    left = F.datediff("delist_date", "t")
    out = asof.on_days(latest_rows.where("delist_date is not null"), dates, F.date_sub("delist_date", days), F.col("delist_date"))
    return out.select("t", "ts_code", "delist_date", left.alias("days_remaining"), F.when(left <= 10, "high").when(left <= 20, "medium").otherwise("low").alias("urgency"))


def final_state(bars: DataFrame, ends: DataFrame, days: int = 30, rows: int = 5) -> DataFrame:
    """The last rows of each security in the days up to its end: how many there are (some at most) and the last close."""
    near = bars.join(ends, "ts_code").where(F.col("trade_date").between(F.date_sub("delist_date", days), F.col("delist_date")))
    w = Window.partitionBy("ts_code").orderBy(F.col("trade_date").desc())
    return near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows).groupBy("ts_code").agg(F.max("trade_date").alias("last_day"), F.max_by("close", "trade_date").alias("last_close"), F.count("*").alias("n_rows"))


def rare_first(sets: DataFrame) -> DataFrame:
    """Distinct sets of characters (chars, a sorted string each) with their characters as numbers, the rarest first (_set).

    The numbers are broadcast: a row a character, so never more than Unicode has.
    """
    each = sets.where("chars != ''").distinct().select("chars", F.explode(F.filter(F.split("chars", ""), lambda c: c != "")).alias("_c"))
    order = each.groupBy("_c").agg(F.count("*").alias("_n")).select("_c", F.row_number().over(Window.orderBy("_n", "_c")).alias("_k"))
    return each.join(F.broadcast(order), "_c").groupBy("chars").agg(F.array_sort(F.collect_list("_k")).alias("_set"))


def similar_sets(gone: DataFrame, listed: DataFrame, days: int, least: float, verify: bool = True) -> DataFrame:
    """(delist_date, chars, list_date, other, similarity) of sets of characters whose Jaccard similarity exceeds least.

    gone: delist_date, chars; listed: list_date, chars; distinct rows. Pairs have 0 to days days between their dates. Sets
    meet in an index of their prefixes, in buckets of days: of n characters, rarest first, only as many are indexed as there are
    counts above least * n, since two sets that share enough share one of these. A pair is made at the first character
    that its prefixes share. Without verify: the candidates, of any similarity.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    ordered = rare_first(gone.select("chars").unionByName(listed.select("chars")))
    size = F.size("_set")
    length = F.size(F.filter(F.sequence(F.lit(1), size), lambda n: n / size > least))
    index = ordered.select("chars", "_set", size.alias("_size"), F.posexplode(F.slice("_set", 1, length)).alias("_i", "_c"))
    index = index.withColumn("_before", F.slice("_set", 1, F.col("_i"))).drop("_i")
    left = gone.join(index, "chars").withColumn("_b", F.explode(F.array(bucket(F.col("delist_date")), bucket(F.col("delist_date")) + 1)))
    right = listed.join(index, "chars").select("list_date", F.col("chars").alias("other"), F.col("_set").alias("_set2"), F.col("_size").alias("_size2"), F.col("_before").alias("_before2"), "_c", bucket(F.col("list_date")).alias("_b"))
    near = F.datediff("list_date", "delist_date").between(0, days)
    long_enough = F.least("_size", "_size2") / F.greatest("_size", "_size2") > least
    pairs = left.join(right, ["_b", "_c"]).where(near & long_enough & ~F.arrays_overlap("_before", "_before2"))
    both = F.size(F.array_intersect("_set", "_set2"))
    pairs = pairs.withColumn("similarity", both / (F.col("_size") + F.col("_size2") - both))
    return (pairs.where(F.col("similarity") > least) if verify else pairs).select("delist_date", "chars", "list_date", "other", "similarity")


def successors(gone: DataFrame, listed: DataFrame, days: int = 60, least: float = 0.5) -> DataFrame:
    """For each delisted name the first listing within some days whose name is similar; (old, new, similarity).

    gone: ts_code, name, delist_date; listed: ts_code, name, list_date. Ties go to the smallest code. Names of a day with the
    same characters are compared once. Of the listings of a day with the same characters the two of smallest code can be the first, and
    so can the first two of a day's delisted names: the second where the first is the name itself.
    """
    chars = F.array_join(F.array_sort(codes.name_chars(F.col("name"))), "").alias("chars")
    g = gone.select(F.col("ts_code").alias("old"), "delist_date", chars).where("old is not null and delist_date is not null and chars != ''")
    n = listed.select(F.col("ts_code").alias("new"), "list_date", chars).where("new is not null and list_date is not null and chars != ''").distinct()
    n = n.withColumn("_rn", F.row_number().over(Window.partitionBy("list_date", "chars").orderBy("new"))).where("_rn <= 2")
    days_of = n.groupBy("list_date", "chars").agg(F.collect_list("new").alias("_new"))
    pairs = similar_sets(g.select("delist_date", "chars").distinct(), days_of.select("list_date", "chars"), days, least)
    pairs = pairs.join(days_of.withColumnRenamed("chars", "other"), ["list_date", "other"]).withColumn("new", F.explode("_new"))
    # a code that is listed more than once counts where it is first
    best = pairs.groupBy("delist_date", "chars", "new").agg(F.min(F.struct("list_date", (-F.col("similarity")).alias("_s"))).alias("_x"))
    order = Window.partitionBy("delist_date", "chars").orderBy(F.col("_x.list_date"), "new")
    best = best.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    found = g.join(best, ["delist_date", "chars"]).where("old != new").groupBy("old").agg(F.min(F.struct("_x.list_date", "new", (-F.col("_x._s")).alias("similarity"))).alias("x"))
    return found.select("old", "x.new", "x.similarity")


def correct(log: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """The log with corrections appended as next versions; what was active before is corrected, with the note."""
    last = log.groupBy(*key).agg(F.max("version").alias("_last"))
    new = corrections.join(last, key, "left").withColumns({"version": F.coalesce("_last", F.lit(0)) + 1, "status": F.lit("active")}).drop("_last")
    touched = corrections.select(*key, F.col("correction_note").alias("_note"))
    old = log.join(touched, key, "left")
    hit = F.col("_note").isNotNull() & (F.col("status") == "active")
    old = old.withColumns({"status": F.when(hit, "corrected").otherwise(F.col("status")), "correction_note": F.when(hit, F.col("_note"))}).drop("_note")
    return old.unionByName(new.select(*old.columns))


def audit(log: DataFrame, digest: Column, days: int = 120) -> DataFrame:
    """Versions whose stored hash differs from that of their data (critical), or that took effect long after they were recorded (warning)."""
    bad = F.when(~digest.eqNullSafe(F.col("data_hash")), F.struct(F.lit("hash_mismatch").alias("issue"), F.lit("critical").alias("severity")))
    late = F.when(F.datediff("effective_at", "recorded_at") > days, F.struct(F.lit("late_effect").alias("issue"), F.lit("warning").alias("severity")))
    return log.withColumn("_x", F.explode(F.array_compact(F.array(bad, late)))).select("event_id", "_x.*")


def pit_violations(result: DataFrame, day: str = "t", seen: str = "ann_date") -> DataFrame:
    """Rows whose newest visible announcement is not before the date: empty where no look-ahead happened."""
    return result.groupBy(day, "ts_code").agg(F.max(seen).alias("newest")).where(F.col("newest") >= F.col(day))
