"""Comparisons of tables and fuller checks (DQ-06 to DQ-33); findings are rows of alert_type, severity, ts_code and trade_date."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.codes import limit_pct
from barloom.operators import quality
from barloom.operators.windows import by, ffill, latest

KEYS = ["ts_code", "trade_date"]


def findings(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each rule that a row of df breaks, in one pass over df; a rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("alert_type"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return df.select(*KEYS, F.explode(broken).alias("_x")).select("_x.*", *KEYS)


def adjusted_ratio(raw: DataFrame, adjusted: DataFrame, most: float = 0.01, keys: list[str] = KEYS) -> DataFrame:
    """Keys whose adjusted close is not raw close x factor, by a share of the factor; keys: what tells rows apart, ts_code and trade_date among it."""
    both = raw.select(*keys, F.col("close").alias("_raw"), "adj_factor").join(adjusted.select(*keys, F.col("close").alias("_adj")), keys)
    return both.where(F.abs(F.try_divide("_adj", "_raw") - F.col("adj_factor")) > F.col("adj_factor") * most).select(*KEYS)


def adjusted_close(raw: DataFrame, adjusted: DataFrame, most: float = 0.001, keys: list[str] = KEYS) -> DataFrame:
    both = raw.select(*keys, (F.col("close") * F.col("adj_factor")).alias("_want")).join(adjusted.select(*keys, F.col("close").alias("_adj")), keys)
    return both.where(F.abs(F.try_divide(F.col("_adj") - F.col("_want"), F.col("_want"))) > most).select(*KEYS)


def row_counts(a: DataFrame, b: DataFrame, key: str = "ts_code") -> DataFrame:
    """Keys with different numbers of rows in two tables."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), key, "full_outer").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_a", "n_b")})
    return both.where("n_a != n_b")


def universe_size(counts: DataFrame, low: int = 1000, high: int = 6000) -> DataFrame:
    return counts.where(~F.col("n").between(low, high))


def volume_logic(bars: DataFrame) -> DataFrame:
    """Rows of one key and day follow each other by close and volume, so the findings are the same in every run."""
    moved = F.abs(F.col("close") - F.col("_before")) > 0.01
    return findings(bars.withColumn("_before", F.lag("close").over(by().orderBy("trade_date", "close", "volume"))), [("negative_volume", "CRITICAL", F.col("volume") < 0), ("silent_move", "WARNING", (F.col("volume") == 0) & moved)])


def statistical(bars: DataFrame, times: float = 10.0, rows: int = 20) -> DataFrame:
    w = by().orderBy("trade_date", "volume").rowsBetween(1 - rows, 0)
    mean = F.when(F.count("*").over(w) == rows, F.avg("volume").over(w))
    limit = limit_pct(F.col("ts_code"), F.col("trade_date")) * 100 + 1
    return findings(bars.withColumn("_mean", mean), [("over_limit", "ERROR", F.abs("pct_chg") > limit), ("volume_spike", "INFO", F.col("volume") > times * F.col("_mean"))])


def suspension(bars: DataFrame, most: int = 1000) -> DataFrame:
    return findings(bars, [("suspended_with_volume", "WARNING", F.col("is_suspend") & (F.col("volume") > most))])


def missing_days(bars: DataFrame, calendar: DataFrame, many: int = 5) -> DataFrame:
    """A finding for each key that misses days of the calendar between its first and last bar: a warning where it is many."""
    found = quality.completeness(bars, calendar)
    return found.select(F.lit("missing_days").alias("alert_type"), F.when(F.col("missing") > many, "WARNING").otherwise("INFO").alias("severity"), "ts_code", F.col("first_missing").alias("trade_date"))


def full_check(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Prices, volumes, suspensions, statistics and completeness."""
    return reduce(DataFrame.unionByName, [quality.price_logic(bars), volume_logic(bars), suspension(bars), statistical(bars), missing_days(bars, calendar)])


def sides(raw: DataFrame, adjusted: DataFrame, gone: DataFrame) -> DataFrame:
    """Raw and adjusted bars in one table, told apart by is_adjusted, with the day their key was delisted (gone: ts_code, delist_date, one row a key)."""
    columns = [*KEYS, "open", "high", "low", "close", "volume", "amount", "pct_chg", "is_suspend", "adj_factor"]
    both = raw.select(*columns, F.lit(False).alias("is_adjusted")).unionByName(adjusted.select(*KEYS, "close", F.lit(True).alias("is_adjusted")), allowMissingColumns=True)
    return both.join(gone.select("ts_code", "delist_date"), "ts_code", "left")


def _key_days(rows: DataFrame) -> DataFrame:
    """A row for each key and day: numbers of raw and adjusted rows and of broken rules, by rule, with the first and last factor."""
    raw, adj = ~F.col("is_adjusted"), F.col("is_adjusted")
    row_rules = {n: F.count_if(raw & quality.RULES[n]()) for n in quality.RULES}
    at = rows.groupBy(*KEYS).agg(
        F.count_if(raw).alias("_raw"), F.count_if(adj).alias("_adj"), F.count_if(raw & (F.col("trade_date") > F.col("delist_date"))).alias("delisted_with_future_data"),
        F.sort_array(F.collect_list(F.when(raw, F.struct("adj_factor", "close")))).alias("_raws"), F.collect_list(F.when(adj, F.col("close"))).alias("_adjs"), *[c.alias(n) for n, c in row_rules.items()],
    )
    known = F.col("ts_code").isNotNull() & F.col("trade_date").isNotNull()
    pairs = lambda bad: F.when(known, F.aggregate("_raws", F.lit(0).cast("long"), lambda n, r: n + F.size(F.filter("_adjs", lambda a: bad(r, a))))).otherwise(0)
    jumps = F.size(F.filter("_raws", lambda r, i: (i > 0) & _jumps(r["adj_factor"], F.get("_raws", i - 1)["adj_factor"])))
    one = lambda c: c.cast("long")
    return at.select(
        *KEYS, "_raw", "_adj", *row_rules, "delisted_with_future_data", F.get("_raws", F.lit(0)).alias("_head"), F.try_element_at("_raws", F.lit(-1)).alias("_tail"), one(jumps).alias("_jumps"),
        one(F.col("_raw") > 1).alias("duplicate_rows"), (F.when(known & (F.col("_adj") > 0), 0).otherwise(F.col("_raw")) + F.when(known & (F.col("_raw") > 0), 0).otherwise(F.col("_adj"))).alias("raw_adj_pk_missing"),
        pairs(lambda r, a: F.abs(F.try_divide(a, r["close"]) - r["adj_factor"]) > r["adj_factor"] * 0.01).alias("adj_raw_ratio_invalid"),
        pairs(lambda r, a: F.abs(F.try_divide(a - r["close"] * r["adj_factor"], r["close"] * r["adj_factor"])) > 0.001).alias("qfq_close_mismatch"),
    )


def _jumps(factor: Column, before: Column, most: float = 0.05) -> Column:
    return F.coalesce(F.abs(F.try_divide(factor - before, before)) > most, F.lit(False))


def data_quality(rows: DataFrame, membership: DataFrame, listed: DataFrame, first: str | None = None, last: str | None = None, keys: Callable[[Column], Column] | None = None, universe: tuple[int, int] = (1000, 6000)) -> DataFrame:
    """Alerts (alert_type, ts_code, trade_date, n: how many) of all fourteen checks, within a range of days and for the keys of a condition.

    rows: raw and adjusted bars as of sides(); listed: t, n (the size of the universe on a day). Bars are dealt by key once: every check of
    bars is a number of a key and day, pairs of raw and adjusted rows included, which are counted and not made. Rows of a day are taken
    in the order of their factors where the next factor is compared. An alert about a whole key has no day, one
    about a day's universe no key; with a range, alerts without a day are left out.
    """
    if keys is not None:
        rows, membership = (df.where(keys(F.col("ts_code"))) for df in (rows, membership))
    key = Window.partitionBy("ts_code")
    before = F.last("_tail", True).over(key.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1))
    n_raw, n_adj = F.sum("_raw").over(key), F.sum("_adj").over(key)
    unequal = F.when(F.col("ts_code").isNull(), (n_raw > 0).cast("long") + (n_adj > 0).cast("long")).otherwise((n_raw != n_adj).cast("long"))
    days = _key_days(rows).withColumns({"_before": before, "_unequal": unequal, "_rn": F.row_number().over(key.orderBy("trade_date"))})
    days = days.withColumn("adj_factor_jump", F.col("_jumps") + _jumps(F.col("_head.adj_factor"), F.col("_before.adj_factor")).cast("long"))
    counted = [*quality.RULES, "duplicate_rows", "adj_factor_jump", "delisted_with_future_data", "adj_raw_ratio_invalid", "raw_adj_pk_missing", "qfq_close_mismatch"]
    of_day = [F.struct(F.lit(n).alias("alert_type"), "trade_date", F.col(n).alias("n")) for n in counted]
    of_key = F.struct(F.lit("raw_adj_row_count_mismatch").alias("alert_type"), F.lit(None).cast("date").alias("trade_date"), F.when(F.col("_rn") == 1, F.col("_unequal")).otherwise(0).alias("n"))
    bars = days.select("ts_code", F.explode(F.filter(F.array(*of_day, of_key), lambda a: a["n"] > 0)).alias("_x")).select("_x.alert_type", "ts_code", "_x.trade_date", "_x.n")
    once = lambda df: df.select("alert_type", *KEYS, F.lit(1).cast("long").alias("n"))
    sizes = universe_size(listed, *universe).select(F.lit("pit_universe_size_suspicious").alias("alert_type"), F.lit(None).cast("string").alias("ts_code"), F.col("t").alias("trade_date"))
    out = reduce(DataFrame.unionByName, [bars, once(quality.index_dates(membership)), once(sizes)])
    for bound, inside in ((first, lambda d: F.col("trade_date") >= d), (last, lambda d: F.col("trade_date") <= d)):
        out = out if bound is None else out.where(inside(F.lit(bound).cast("date")))
    return out


def verdict(found: DataFrame) -> DataFrame:
    """Tallies by severity, score and verdict of all findings."""
    n = lambda s: F.count_if(F.col("severity") == s)
    tally = found.agg(n("CRITICAL").alias("critical"), n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("INFO").alias("infos"))
    return tally.withColumn("verdict", F.when(F.col("critical") + F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARNING").otherwise("PASS")).withColumn("score", quality.score(F.col("critical") + F.col("errors"), F.col("warnings"), F.col("infos")))


def basic(bars: DataFrame) -> DataFrame:
    price = F.least("open", "high", "low", "close")
    limit = limit_pct(F.col("ts_code"), F.col("trade_date")) * 100
    return findings(bars, [("non_positive", "ERROR", price <= 0), ("over_limit", "WARNING", F.abs("pct_chg") > limit), ("negative_volume", "ERROR", F.col("volume") < 0)])


def enhanced(bars: DataFrame, large: float = 1e9, small: int = 100) -> DataFrame:
    quiet = ((F.col("volume") == 0) | (F.col("close") == 0)) & (F.col("close") == F.col("_before"))
    rows = bars.withColumn("_before", F.lag("close").over(by()))
    nulls = [(f"null_{c}", "error", F.col(c).isNull()) for c in ("open", "high", "low", "close", "volume")]
    limit = limit_pct(F.col("ts_code"), F.col("trade_date")) * 100
    return findings(rows, [*nulls, ("non_positive", "error", F.least("open", "high", "low", "close") <= 0), ("over_limit", "warning", F.abs("pct_chg") > limit), ("suspected_suspension", "info", quiet), ("large_amount", "info", F.col("amount") > large), ("small_volume", "info", F.col("volume") < small)])


def fix(bars: DataFrame, recency: str) -> DataFrame:
    """One row a key (the latest), prices and amount carried forward, non-positive prices null."""
    prices = ["open", "high", "low", "close"]
    filled = ffill(latest(bars, KEYS, F.col(recency).desc()), [*prices, "amount"])
    return filled.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in prices})


def suspected(bars: DataFrame) -> DataFrame:
    """The bars with a flag: no volume or price, and the close as before."""
    rows = bars.withColumn("_before", F.lag("close").over(by()))
    flag = ((F.col("volume") == 0) | (F.col("close") == 0)) & (F.col("close") == F.col("_before"))
    return rows.withColumn("suspected", F.coalesce(flag, F.lit(False))).drop("_before")


def factor_changes(stored: DataFrame, incoming: DataFrame, most: float = 0.05) -> DataFrame:
    """Keys whose first incoming factor is off the last stored one by more than a share."""
    old = stored.groupBy("ts_code").agg(F.max_by("adj_factor", "trade_date").alias("old_factor"))
    new = incoming.groupBy("ts_code").agg(F.min_by("adj_factor", "trade_date").alias("new_factor"), F.min("trade_date").alias("trade_date"))
    ratio = F.abs(F.try_divide("new_factor", "old_factor") - 1)
    return old.join(new, "ts_code").where("old_factor > 0 and new_factor > 0").withColumn("change_ratio", ratio).where(F.col("change_ratio") > most)


def compare_golden(golden: DataFrame, bars: DataFrame, price: float = 0.005, factor: float = 0.01) -> DataFrame:
    """Golden rows that the bars lack, and fields of the others that are off by more than the tolerances."""
    fields = ["open", "high", "low", "close", "adj_factor"]
    both = golden.select(*KEYS, *[F.col(c).alias(f"_g_{c}") for c in fields]).join(bars.select(*KEYS, *fields, F.lit(True).alias("_there")), KEYS, "left")
    off = [(c, "ERROR", F.abs(F.col(c) - F.col(f"_g_{c}")) > (F.lit(factor) if c == "adj_factor" else F.abs(F.col(f"_g_{c}")) * price)) for c in fields]
    return findings(both, [("missing", "ERROR", F.col("_there").isNull()), *off]).drop("severity")


def compare_metrics(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, value, verdict) of expected ranges (metric, low, high): PASS, MISSING or OUT_OF_RANGE."""
    out = bounds.join(metrics, "metric", "left")
    ok = F.col("value").between(F.col("low"), F.col("high"))
    return out.select("metric", "value", F.when(F.col("value").isNull(), "MISSING").when(ok, "PASS").otherwise("OUT_OF_RANGE").alias("verdict"))


def backtest_output(rows: DataFrame) -> DataFrame:
    """Counts of positions below zero, trades without volume and days without equity, in a table (kind, value)."""
    bad = F.when(F.col("kind") == "position", F.col("value") < 0).otherwise(F.col("value") <= 0)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


def acceptance(bars: DataFrame, low: float = 0.01, high: float = 10000.0) -> DataFrame:
    """Factors that fall, closes out of range and pct_chg that isn't close over pre_close."""
    rows = bars.withColumn("_f", F.lag("adj_factor").over(by()))
    drift = F.abs(F.col("pct_chg") - (F.try_divide("close", "pre_close") - 1) * 100) > 0.01
    return findings(rows, [("factor_falls", "WARNING", F.col("adj_factor") < F.col("_f")), ("close_out_of_range", "ERROR", ~F.col("close").between(low, high)), ("pct_chg_identity", "ERROR", drift)])


def latest_factor(bars: DataFrame, most: float = 1e-6) -> DataFrame:
    """Keys whose last adjustment factor isn't 1."""
    last = bars.groupBy("ts_code").agg(F.max("trade_date").alias("trade_date"), F.max_by("adj_factor", "trade_date").alias("adj_factor"))
    return last.where(F.abs(F.col("adj_factor") - 1) > most)


def days_a_year(bars: DataFrame, low: int = 240, high: int = 250) -> DataFrame:
    """Years with too few or too many trading days."""
    return bars.groupBy(F.year("trade_date").alias("year")).agg(F.countDistinct("trade_date").alias("days")).where(~F.col("days").between(low, high))


def value_ranges(rows: DataFrame, bounds: dict[str, tuple[float, float]], key: list[str], profit: str | None = None, roe: str = "roe") -> DataFrame:
    """(alert_type, *key): a row for each measure outside its range, and where the sign of roe isn't that of the profit."""
    rules = [(f"{c}_out_of_range", ~F.col(c).between(*b)) for c, b in bounds.items()]
    if profit is not None:
        rules.append(("roe_sign", F.signum(roe) != F.signum(profit)))
    return rows.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("alert_type"))


def key_count_swing(bars: DataFrame, most: float = 0.2) -> DataFrame:
    """Months whose number of codes swings by more than a share against the month before; a row a month."""
    from pyspark.sql import Window

    month = bars.groupBy(F.to_date(F.trunc("trade_date", "month")).alias("month")).agg(F.countDistinct("ts_code").alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return month.withColumn("swing", F.abs(F.try_divide(F.col("n"), before) - 1)).where(F.col("swing") > most)
