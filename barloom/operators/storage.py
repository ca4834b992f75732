"""Layouts, archives, logs and reports on Parquet and JSON (S-06 to S-28)."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.merge import keep_last

#: Fixed list of tables that may be exported.
EXPORTABLE = ("bars", "security_history", "calendar", "index_membership", "fundamentals", "factors_fin", "valuation", "corporate_actions")


def ready(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, set for checkpoints; a temporary one in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-barloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see; it goes when the driver ends."""
    path = f"{ready(spark)}/{name}-{uuid.uuid4().hex}"

    def remove():
        with contextlib.suppress(Exception):  # the session may be gone already
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(remove)
    return path


def sized(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns for a partitioned write: Spark splits and unites what it deals by bytes, at run time.

    A value with much data is written by many tasks, values with little share one; the size is
    spark.sql.adaptive.advisoryPartitionSizeInBytes.
    """
    return df.hint("rebalance", *columns)


def export(df: DataFrame, table: str, folder: str) -> str:
    if table not in EXPORTABLE:
        raise ValueError(f"{table} may not be exported")
    path = f"{folder}/{table}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_new_partitions(df: DataFrame, path: str, column: str, existing: DataFrame | None = None, codec: str = "zstd") -> None:
    """Writes only those partitions that are not there yet; what existing holds stays as it is."""
    rows = df if existing is None else df.join(existing.select(column).distinct(), column, "left_anti")
    sized(rows, column).write.mode("append").option("compression", codec).partitionBy(column).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def touched_partitions(old: DataFrame, new: DataFrame, partition: str, most: int = 10_000) -> DataFrame:
    """The rows of old in the partitions that new has rows in: a list of values in the plan, so other folders aren't read.

    A table has few partition values (years); a batch that touches over `most` of them is met by a join, which reads all.
    """
    values = [r[0] for r in new.select(partition).distinct().limit(most + 1).collect()]
    if len(values) > most:
        return old.join(new.select(partition).distinct(), partition, "left_semi")
    inside = F.col(partition).isin([v for v in values if v is not None])
    return old.where(inside | F.col(partition).isNull() if None in values else inside)


def write_incremental(spark: SparkSession, new: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """Merges new rows into the partitions they touch; the last row of a key wins, other partitions aren't read or written.

    The merged rows are staged beside the table before they replace the old ones, since a folder can't be read while it is
    overwritten; the staged folder goes when the new files have been committed. A table that isn't there yet is begun.
    """
    if not exists(spark, path):
        sized(keep_last([new], keys), partition).write.partitionBy(partition).parquet(path)
        return
    old = spark.read.parquet(path)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        keep_last([touched_partitions(old, new, partition), new.select(*old.columns)], keys).write.parquet(staged)
        sized(spark.read.parquet(staged), partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    finally:
        delete_path(spark, staged)


def archive(df: DataFrame, path: str, today: str, years: int = 5, day: str = "trade_date") -> None:
    """Full years before today's, each with the codec of its age: zstd where cold, else snappy."""
    from barloom.operators.merge import tier

    past = df.withColumns({"year": F.year(day), "_tier": tier(F.col(day), today)}).where(F.col("year").between(int(today[:4]) - years, int(today[:4]) - 1))
    for codec, cold in (("zstd", True), ("snappy", False)):
        part = past.where((F.col("_tier") == "cold") == F.lit(cold)).drop("_tier")
        sized(part, "year").write.mode("append").option("compression", codec).partitionBy("year").parquet(path)


def file_sizes(files: DataFrame) -> DataFrame:
    """(file, bytes, rows) of a table's files."""
    return files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("bytes"), F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, out: str, column: str, target_rows: int = 5_000_000, level: int = 9) -> None:
    """Rewrites a partitioned table with files of about target_rows rows at a higher zstd level."""
    sized(spark.read.parquet(path), column).write.mode("overwrite").option("maxRecordsPerFile", target_rows).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).partitionBy(column).parquet(out)


def listed(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, bytes, changed, part) of a partitioned table's files, from the listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"), F.regexp_extract("path", rf"/{column}=([^/]*)/", 1).alias("part"))


def compaction_plan(files: DataFrame, cold: Column, least: int = 100 << 20, target: int = 256 << 20) -> DataFrame:
    """(part, file, bin): files of cold partitions of at least `least` bytes, dealt to bins of about `target` bytes in name order.

    A partition that already has as few files as bins is left out, so compacting twice touches nothing the second time.
    """
    by_part = Window.partitionBy("part")
    sized_files = files.where(cold).withColumns({"_all": F.sum("bytes").over(by_part), "_n": F.count("*").over(by_part), "_end": F.sum("bytes").over(by_part.orderBy("file"))})
    binned = sized_files.where(F.col("_all") >= least).withColumn("bin", F.floor((F.col("_end") - 1) / target))
    return binned.where(F.col("_n") > F.ceil(F.col("_all") / target)).select("part", "file", "bin")


def compact_cold(spark: SparkSession, path: str, column: str, cold: Column, least: int = 100 << 20, target: int = 256 << 20, level: int = 9) -> list[str]:
    """Rewrites the files of large cold partitions, those of a bin as one, at a higher zstd level; gives those partitions.

    cold is a condition on `part`, a partition's value as text. The rows are staged, and replace the old files when Spark
    commits those partitions; all other files keep their names and times. Partitions are few (years), so their list fits
    the driver.
    """
    plan = compaction_plan(listed(spark, path, column), cold, least, target)
    parts = sorted(r[0] for r in plan.select("part").distinct().collect())
    if not parts:
        return []
    rows = spark.read.parquet(path).where(F.col(column).cast("string").isin(parts)).withColumn("_file", F.col("_metadata.file_path"))
    name = lambda c: F.regexp_extract(c, "([^/]+/[^/]+)$", 1)
    bins = plan.select(name("file").alias("_name"), "bin")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        rows.withColumn("_name", name("_file")).join(F.broadcast(bins), "_name").drop("_name", "_file").write.parquet(staged)
        packed = spark.read.parquet(staged)
        writer = packed.repartition(F.col(column), F.col("bin")).drop("bin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).partitionBy(column).parquet(path)
    finally:
        delete_path(spark, staged)
    return parts


def write_layer(df: DataFrame, root: str, layer: str, key: str = "ts_code", day: str = "trade_date", keys: int = 100_000, page_rows: int = 20_000) -> None:
    """Replaces one layer of a table of layers: files of ranges of keys, sorted by key and day, with a bloom filter of the key.

    keys is about how many there are: it sizes the filters. A page, the least that a scan reads, has page_rows rows at most.
    """
    writer = df.withColumn("layer", F.lit(layer)).repartitionByRange(key, day).sortWithinPartitions(key, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", keys).option("parquet.page.row.count.limit", page_rows).partitionBy("layer").parquet(root)


def read_layer(spark: SparkSession, root: str, layer: str, keys: list[str] | None = None, first: str | None = None, last: str | None = None, key: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """A layer's rows of the keys (all without a list) and days: other layers' folders aren't listed, other keys' row groups and pages not read."""
    rows = spark.read.parquet(root).where(F.col("layer") == layer)
    if keys is not None:
        rows = rows.where(F.col(key).isin(list(keys)))
    if first is not None:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col(day) <= F.lit(last).cast("date"))
    return rows.drop("layer")


def snapshot_upsert(master: DataFrame, snapshot: DataFrame, day: Column) -> DataFrame:
    """The master with the given day's snapshot in place of that day's rows; other days stay."""
    new = snapshot.withColumn("eff_date", day).select(*master.columns)
    keys = ["ts_code", "eff_date"]
    return master.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def status_snapshot(latest: DataFrame, day: Column) -> DataFrame:
    """A status row of each security for a day: tradable unless delisted."""
    gone = F.col("delist_date").isNotNull() & (F.col("delist_date") <= day)
    return latest.select("ts_code", day.alias("status_date"), gone.alias("delisted"), (~gone).alias("tradable"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sync_log(batch: DataFrame, table: str) -> DataFrame:
    """One row about a sync: table, range, rows and status."""
    n = F.count("*")
    return batch.agg(F.lit(table).alias("table_name"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), n.alias("rows"), F.when(n > 0, "ok").otherwise("empty").alias("status"))


def soft_close(df: DataFrame, today: Column, column: str = "out_date") -> DataFrame:
    return df.withColumn(column, F.coalesce(column, today))


def delete(df: DataFrame, keys: Iterable[str], key: str = "ts_code", first: str | None = None, last: str | None = None, day: str = "trade_date") -> DataFrame:
    """Without the rows of the keys, within a range of days where one is given. Null keys stay."""
    hit = F.col(key).isin(list(keys))
    if first is not None and last is not None:
        hit = hit & F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.where(~F.coalesce(hit, F.lit(False)))
