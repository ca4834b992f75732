"""Canonical field names and types, and the normaliser of incoming tables (P-09 to P-17, S-22)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of canonical fields.
ALIASES = {
    "date": "trade_date", "dt": "trade_date", "trade_dt": "trade_date", "trading_date": "trade_date",
    "is_suspended": "is_suspend", "suspended": "is_suspend", "suspend": "is_suspend",
    "prev_close": "pre_close", "previous_close": "pre_close", "last_close": "pre_close",
    "vol": "volume", "turnover_vol": "volume", "turnover_amount": "amount", "turnover_rate": "turnover",
    "code": "symbol", "stock_code": "symbol", "stock_symbol": "symbol",
}
TYPES = {
    **dict.fromkeys(("symbol", "ts_code", "name", "exchange", "board"), "string"),
    **dict.fromkeys(("trade_date", "list_date", "delist_date", "ann_date"), "date"),
    **dict.fromkeys(("open", "high", "low", "close", "pre_close", "vwap", "amount", "turnover", "adj_factor", "adj_close", "pct_chg", "limit_up", "limit_down"), "double"),
    **dict.fromkeys(("pe_ttm", "pb", "ps_ttm", "pcf_ttm", "total_mv", "circ_mv", "revenue", "net_profit", "roe", "roa", "eps", "bps"), "double"),
    "volume": "long",
    **dict.fromkeys(("is_suspend", "is_st", "is_delisted", "is_tradable", "is_limit_up", "is_limit_down"), "boolean"),
}
DEFAULTS = {"boolean": False, "long": 0}
REQUIRED = ("ts_code", "trade_date", "open", "high", "low", "close", "volume")


def normalize(df: DataFrame, strict: bool = False) -> DataFrame:
    """Canonical names; is_trading becomes its negation is_suspend. Strict refuses unknown columns.

    An alias whose canonical column is there already (or that an earlier alias has taken) is dropped.
    """
    if strict and (unknown := [c for c in df.columns if c not in ALIASES and c not in TYPES and c != "is_trading"]):
        raise ValueError(f"unknown columns: {unknown}")
    taken, out = {c for c in df.columns if c not in ALIASES and c != "is_trading"}, []
    for c in df.columns:
        name = "is_suspend" if c == "is_trading" else ALIASES.get(c, c)
        if name != c and name in taken:
            continue
        taken.add(name)
        out.append((~F.col(c).cast("boolean") if c == "is_trading" else F.col(c)).alias(name))
    return df.select(out)


def ensure(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Adds missing columns with the default of their type: false, 0 or null."""
    add = {c: F.lit(DEFAULTS.get(t := TYPES.get(c, "string"))).cast(t) for c in columns if c not in df.columns}
    return df.withColumns(add) if add else df


def coerce(df: DataFrame) -> DataFrame:
    """Canonical types; what can't be read becomes null, or the default of its type."""
    typed = {c: F.col(c).try_cast(TYPES[c]) for c in df.columns if c in TYPES}
    return df.withColumns({c: F.coalesce(x, F.lit(DEFAULTS[TYPES[c]])) if TYPES[c] in DEFAULTS else x for c, x in typed.items()})


def standardize(df: DataFrame, columns: Iterable[str] = REQUIRED) -> DataFrame:
    return coerce(ensure(normalize(df), columns))


def missing(df: DataFrame, required: Iterable[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def lacking(df: DataFrame, required: Iterable[str] = REQUIRED) -> DataFrame:
    """(field, lacking, rows): the required fields that some rows lack, with how many do; all do where there is no such column."""
    n = [F.count_if(F.col(c).isNull()).alias(c) if c in df.columns else F.count("*").alias(c) for c in required]
    return df.agg(*n, F.count("*").alias("rows")).unpivot(["rows"], list(required), "field", "lacking").where("lacking > 0").select("field", "lacking", "rows")


def project(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only the wanted columns; names that the table lacks are an error, not a guess."""
    if lacking := missing(df, wanted := list(wanted)):
        raise ValueError(f"no such columns: {lacking}")
    return df.select(wanted)


def dated(df: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose key is there and whose day can be read, as a date."""
    return df.withColumn(day, F.col(day).try_cast("date")).dropna(subset=[key, day])


def in_scope(requests: DataFrame, allowed: DataFrame, first: str, last: str) -> DataFrame:
    """(ts_code, start, end) requests of allowed keys, clamped to the range of days; empty ranges go."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    clamped = requests.join(allowed.select("ts_code").distinct(), "ts_code", "left_semi").withColumns({"start": F.greatest("start", a), "end": F.least("end", b)})
    return clamped.where("start <= end")


def scope_violations(requests: DataFrame, allowed: DataFrame, first: str, last: str) -> DataFrame:
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    known = requests.join(allowed.select("ts_code").distinct().withColumn("_known", F.lit(True)), "ts_code", "left")
    why = F.when(F.col("_known").isNull(), "key").when((F.col("end") < a) | (F.col("start") > b), "range").when((F.col("start") < a) | (F.col("end") > b), "clamped")
    return known.withColumn("violation", why).where("violation is not null").drop("_known")


def from_vendor(raw: DataFrame, source: str) -> DataFrame:
    """Bars of a vendor's table of strings: types, code, previous close, suspension and source."""
    from barloom.functions.codes import ts_code
    from barloom.operators.windows import by

    out = coerce(normalize(raw)).withColumn("ts_code", ts_code(F.col("symbol")))
    return out.withColumns({"pre_close": F.lag("close").over(by()), "is_suspend": F.col("volume") == 0, "data_source": F.lit(source)})


def finite(c: Column, default: float = 1.0) -> Column:
    """The value, or the default where it is null, NaN or infinite."""
    return F.when(c.isNull() | F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf"))), F.lit(default)).otherwise(c)
