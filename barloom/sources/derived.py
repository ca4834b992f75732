"""Market-shaped tables derived from the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed code prefixes and exchange suffixes by supplier key modulo 6.
PREFIXES = ("600", "688", "000", "300", "430", "920")
SUFFIXES = ("SH", "SH", "SZ", "SZ", "BJ", "BJ")
_TIES = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(key: str) -> Column:
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col(key) % 6).cast("int"))
    return F.concat(pick(PREFIXES), F.lpad(F.col(key).cast("string"), 3, "0"), F.lit("."), pick(SUFFIXES))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with their supplier; line items are shuffled once, by code, for the bars and for the previous close.

    A code keeps three digits of the supplier's key, so suppliers from the thousandth on share codes: the key of a bar is supplier and
    trade_date. Bars of one code and day follow each other by supplier, so the previous close is the same in every run.
    """
    items = read(spark, sf_dir, "lineitem").withColumns({"p": F.col("l_extendedprice") / F.col("l_quantity"), "ts_code": _code("l_suppkey"), "trade_date": F.to_date(F.date_trunc("week", "l_shipdate"))})
    at = F.struct(*_TIES)
    week = items.repartition("ts_code").groupBy("ts_code", "trade_date", "l_suppkey").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )
    w = Window.partitionBy("ts_code").orderBy("trade_date", "l_suppkey")
    out = week.select(F.col("l_suppkey").alias("supplier"), "ts_code", "trade_date", "open", "high", "low", "close", "volume", "amount", F.lag("close").over(w).alias("pre_close"))
    pct = (F.col("close") / F.col("pre_close") - 1) * 100
    return out.withColumns({"pct_chg": pct, "adj_factor": 1.0 + 0.1 * (F.year("trade_date") - 1995), "is_suspend": F.col("volume") % 7 == 0})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each code."""
    return supplier_bars(spark, sf_dir).drop("supplier")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security master versions: a customer's last order of each day."""
    o = read(spark, sf_dir, "orders").withColumn("eff_date", F.to_date("o_orderdate"))
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    day = o.groupBy(key.alias("ts_code"), "eff_date").agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("x"))
    w = Window.partitionBy("ts_code")
    last = F.max_by("x", "eff_date").over(w)["o_orderstatus"]
    return day.select("ts_code", "eff_date", F.col("x.o_orderstatus").alias("status"), F.col("x.o_orderpriority").alias("board"), F.min("eff_date").over(w).alias("list_date"), F.when(last == "F", F.max("eff_date").over(w)).alias("delist_date"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    roe = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 10000)
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ts_code"), F.col("o_orderkey").alias("report"), F.to_date("o_orderdate").alias("ann_date"), F.date_sub(F.to_date(F.date_trunc("quarter", "o_orderdate")), 1).alias("end_date"), roe.alias("roe"), F.col("o_totalprice").alias("revenue"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.select("ts_code", F.col("eff_date").alias("in_date"), F.date_sub(F.lead("eff_date").over(Window.partitionBy("ts_code").orderBy("eff_date")), 1).alias("out_date"), F.col("board").alias("index_code"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter starts over the order dates: the days that point-in-time queries ask about."""
    b = read(spark, sf_dir, "orders").agg(F.to_date(F.date_trunc("quarter", F.min("o_orderdate"))).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return b.select(F.explode(F.sequence("a", "b", F.expr("interval 3 months"))).alias("t"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators.calendar import build

    return build(read(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b")))


_ARRAY = lambda names: "['" + "','".join(names) + "']"
SQL = {
    "bars": f"""bars AS (SELECT *, (close / pre_close - 1) * 100 AS pct_chg, 1.0::DOUBLE + 0.1::DOUBLE * (year(trade_date) - 1995) AS adj_factor, volume % 7 = 0 AS is_suspend FROM (
      SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close FROM (
        SELECT {_ARRAY(PREFIXES)}[l_suppkey % 6 + 1] || lpad(l_suppkey::VARCHAR, 3, '0') || '.' || {_ARRAY(SUFFIXES)}[l_suppkey % 6 + 1] AS ts_code, d AS trade_date, max(CASE WHEN rn = 1 THEN p END) AS open, max(p) AS high, min(p) AS low, max(CASE WHEN rn = n THEN p END) AS close, sum(l_quantity)::BIGINT AS volume, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount FROM (
          SELECT *, date_trunc('week', l_shipdate)::DATE AS d, l_extendedprice / l_quantity AS p, count(*) OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)) AS n, row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY {", ".join(_TIES)}) AS rn FROM lineitem)
        GROUP BY l_suppkey, d)))""",
    "history": """history AS (SELECT ts_code, eff_date, status, board, min(eff_date) OVER (PARTITION BY ts_code) AS list_date, CASE WHEN last_value(status) OVER (PARTITION BY ts_code ORDER BY eff_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'F' THEN max(eff_date) OVER (PARTITION BY ts_code) END AS delist_date FROM (
      SELECT 'c' || o_custkey AS ts_code, o_orderdate::DATE AS eff_date, o_orderstatus AS status, o_orderpriority AS board FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) = 1))""",
    "fundamentals": """fundamentals AS (SELECT 'c' || o_custkey AS ts_code, o_orderkey AS report, o_orderdate::DATE AS ann_date, (date_trunc('quarter', o_orderdate)::DATE - 1) AS end_date, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 10000 END AS roe, o_totalprice AS revenue FROM orders)""",
    "membership": "membership AS (SELECT ts_code, eff_date AS in_date, lead(eff_date) OVER (PARTITION BY ts_code ORDER BY eff_date) - 1 AS out_date, board AS index_code FROM history)",
    "dates": "dates AS (SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate)), max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS t FROM orders)",
    "calendar": "calendar AS (SELECT cal_date, dayofweek(cal_date) BETWEEN 1 AND 5 AND strftime(cal_date, '%m-%d') NOT IN ('01-01', '05-01', '10-01') AS is_trading_day FROM (SELECT unnest(generate_series(min(l_shipdate)::DATE::TIMESTAMP, max(l_shipdate)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS cal_date FROM lineitem))",
}


def sql(names: str, body: str) -> str:
    wanted = names.split()
    if "membership" in wanted and "history" not in wanted:
        wanted.insert(0, "history")
    word = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    return word + ", ".join(SQL[n] for n in wanted) + (", " + body.removeprefix(word) if body.startswith("WITH ") else " " + body)
