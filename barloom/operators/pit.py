"""Point-in-time universes, memberships, fundamentals and version logs (M-01 to M-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators import asof, storage
from barloom.operators.storage import ready
from barloom.operators.windows import latest, validity


def universe(history: DataFrame, dates: DataFrame, min_days: int = 0, include_delisted: bool = False, inclusive: bool = False, exchanges: list[str] | None = None, exchange: str = "exchange") -> DataFrame:
    """Version of each listed key on each date, with is_tradable; the delist day itself is out unless inclusive.

    is_tradable is true until the delist day; with exchanges, only keys whose exchange column holds one of them.
    """
    listed = history if exchanges is None else history.where(F.col(exchange).isin(exchanges))
    out = asof.active(validity(listed), dates).where(F.datediff("t", "list_date") >= min_days)
    out = out.withColumn("is_tradable", F.col("delist_date").isNull() | (F.col("delist_date") > F.col("t")))
    if include_delisted:
        return out
    end = F.col("delist_date") >= F.col("t") if inclusive else F.col("delist_date") > F.col("t")
    return out.where(F.col("delist_date").isNull() | end)


def factors(fundamentals: DataFrame, dates: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Last non-null value of each factor announced before (or on) each date.

    Values are carried forward once for each announcement, so a date meets one row of a key, not all that came before it.
    """
    known = fundamentals.where("ann_date is not null")
    w = Window.partitionBy("ts_code").orderBy("ann_date", "end_date", "report")
    carried = known.select("ts_code", "ann_date", F.lead("ann_date").over(w).alias("_next"), *[F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names])
    a, b = F.col("ann_date"), F.col("_next")
    span = (F.date_add(a, 1), b) if strict else (a, F.date_sub(b, 1))
    return asof.on_days(carried, dates, *span).select("t", "ts_code", *names)


def visible(fundamentals: DataFrame, dates: DataFrame, lookback: int = 90) -> DataFrame:
    """The newest period announced within the lookback, for each key and date."""
    near = asof.on_days(fundamentals, dates, F.date_add("ann_date", 1), F.date_add("ann_date", lookback))
    return latest(near, ["t", "ts_code"], F.col("end_date").desc(), F.col("ann_date").desc(), F.col("report").desc())


def diff_snapshots(members: DataFrame, snapshot: DataFrame, day: str) -> DataFrame:
    """Membership after a snapshot: members that are absent end the day before, new ones begin on the day."""
    at, key = F.lit(day).cast("date"), ["index_code", "ts_code"]
    both = members.select(*key, "in_date", "out_date", F.col("out_date").isNull().alias("_open"), F.lit(True).alias("_member")).join(
        snapshot.select(*key, F.lit(True).alias("_there"), F.lit(True).alias("_open")).distinct(), [*key, "_open"], "full_outer"
    )
    out_date = F.when(F.col("_open") & F.col("_member") & F.col("_there").isNull(), F.date_sub(at, 1)).otherwise(F.col("out_date"))
    return both.select(*key, F.when(F.col("_member"), F.col("in_date")).otherwise(at).alias("in_date"), out_date.alias("out_date"))


def payload_hash(fields: list[str]) -> Column:
    """First 16 hex digits of the SHA-256 of the fields as JSON with sorted keys."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(fields))).cast("binary"), 256), F.lit(16))


def number_versions(log: DataFrame, key: list[str], recorded: str) -> DataFrame:
    """Version numbers in recording order, with status and successor derived when read."""
    w = Window.partitionBy(*key).orderBy(recorded, "event_id")
    after = F.lead("event_id").over(w)
    return log.withColumns({"version": F.row_number().over(w), "status": F.when(after.isNull(), "active").otherwise("superseded"), "superseded_by": F.when(after.isNotNull(), F.row_number().over(w) + 1)})


def as_of(log: DataFrame, key: list[str], at: Column, effective: str = "effective_at", strict: bool = True) -> DataFrame:
    """The last version effective before a time, whatever corrected it later."""
    seen = log.where(F.col(effective) < at if strict else F.col(effective) <= at)
    return latest(seen, key, F.col(effective).desc(), F.col("version").desc())


def resolve_codes(edges: DataFrame, at: Column | None = None, day: str = "day") -> DataFrame:
    """(code, final): the end of each chain of code changes, however long; with at, of the changes whose day is not after it.

    Chains double each round until no row changes. Each round runs at once and is checkpointed in the shared folder; a
    cycle of changes raises a ValueError.
    """
    ready(edges.sparkSession)
    kept = lambda df: df.checkpoint()
    seen = edges if at is None else edges.where(F.col(day) <= at)
    now = kept(seen.select(F.col("old").alias("code"), F.col("new").alias("final")).distinct())
    total, longest = now.count(), 1
    while True:
        step = now.select(F.col("code").alias("_via"), F.col("final").alias("_next"))
        moved = kept(now.join(step, F.col("final") == F.col("_via"), "left").select("code", F.coalesce("_next", "final").alias("final"), F.col("_via").isNotNull().alias("_moved")).distinct())
        now = moved.select("code", "final")
        if moved.where("_moved").isEmpty():
            return now
        if longest > total:
            raise ValueError("the code changes form a cycle")
        longest *= 2


def merged_payload(log: DataFrame, payload: str, added: Column) -> DataFrame:
    """data, a map of the payload's JSON fields in which the added fields take precedence; bad JSON counts as empty."""
    fields = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    old = F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys(added), k))
    return log.withColumn("data", F.map_concat(old, added))


def append_versions(spark: SparkSession, folder: str, new: DataFrame, keys: list[str], order: list[str], batch: int) -> None:
    """Stores new rows as the next versions of their keys, with a row `store` for each in the changelog.

    Log and changelog are written under the batch's id, and what other batches stored is all that counts before it, so a
    batch that comes again replaces itself. Nothing stored is rewritten: a version is superseded by a later one when read.
    """
    stored = stored_versions(spark, folder, new.schema)
    last = stored.where(F.col("batch") != batch).join(new.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.max("version").alias("_last"))
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = new.withColumn("version", F.row_number().over(w).cast("long"))
    rows = numbered.join(last, keys, "left").withColumn("version", F.col("version") + F.coalesce("_last", F.lit(0))).drop("_last")
    rows.write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")
    written = spark.read.schema(rows.schema).parquet(f"{folder}/log/batch={batch}")
    written.select(*keys, "version", F.lit("store").alias("action")).write.mode("overwrite").parquet(f"{folder}/changelog/batch={batch}")


def stored_versions(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The log as stored, empty where nothing is; schema is that of the rows without version and batch."""
    full = StructType([*schema.fields]).add("version", "long").add("batch", "integer")
    if not storage.exists(spark, f"{folder}/log"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{folder}/log")


def read_versions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The log with a status: the last version of a key is active, those before are superseded."""
    last = F.max("version").over(Window.partitionBy(*keys))
    return spark.read.parquet(f"{folder}/log").withColumn("status", F.when(F.col("version") == last, "active").otherwise("superseded"))
