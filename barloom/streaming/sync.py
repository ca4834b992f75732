"""Incremental bar sync with Structured Streaming and keyed state (ST-01, ST-02)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from barloom.operators import quality, storage
from barloom.operators.windows import latest

KEYS = ["ts_code", "trade_date"]
PROGRESS = "ts_code string, last_date date, total_records long"
#: The state store that keyed state of this kind needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = date(1970, 1, 1)


class KnownBars(StatefulProcessor):
    """Of each key: its last bars by day, the days that it has (a bitmap), and so its newest day, last factor and number of bars.

    A micro-batch's bars come out as `new`, behind the key's last earlier bars as `earlier`, which checks need; a row
    `factor` says that the first bar after the newest day has another factor than the last one (old_factor), by more
    than `most`; a row `progress` has the newest day and the number of days. A day that comes again replaces its bar and isn't
    counted again. Of rows for the same day in one batch the greatest counts.
    """

    def __init__(self, schema: StructType, context: int, most: float):
        self.schema, self.context, self.most = schema, context, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", self.schema)
        self.days = handle.getValueState("days", "first int, bits binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        names = self.schema.names
        order = lambda r: [(r[n] is not None, r[n]) for n in names if n not in KEYS]
        new: dict[date, Row] = {}
        for row in rows:
            there = new.get(row["trade_date"])
            if there is None or order(row) > order(there):
                new[row["trade_date"]] = row
        new.pop(None, None)
        if not new:
            return
        stored = [Row(**dict(zip(names, r))) for r in self.last.get()]
        first, last_day = min(new), max((r["trade_date"] for r in stored), default=None)
        line = lambda kind, row=None, **more: Row(**{n: None if row is None else row[n] for n in names} | {"kind": kind, "old_factor": None, "total_records": None} | more)
        for row in stored:
            if row["trade_date"] < first:
                yield line("earlier", row)
        for row in new.values():
            yield line("new", row)
        later = min((d for d in new if last_day is not None and d > last_day), default=None)
        if later is not None and "adj_factor" in names:
            old = max(stored, key=lambda r: r["trade_date"])["adj_factor"]
            if old and new[later]["adj_factor"] is not None and abs(new[later]["adj_factor"] / old - 1) > self.most:
                yield line("factor", new[later], old_factor=old)
        known = {r["trade_date"]: r for r in stored} | new
        self.last.put([tuple(known[d]) for d in sorted(known)[-self.context :]])
        start, bits = self.days.get() if self.days.exists() else ((first - EPOCH).days, b"")
        numbers = [(d - EPOCH).days for d in new]
        low = min(start, *numbers)
        bitmap = int.from_bytes(bits, "little") << (start - low)
        for n in numbers:
            bitmap |= 1 << (n - low)
        self.days.update((low, bitmap.to_bytes((bitmap.bit_length() + 7) // 8, "little")))
        newest = EPOCH + timedelta(days=low + bitmap.bit_length() - 1)
        yield line("progress", ts_code=key[0], trade_date=newest, total_records=bitmap.bit_count())

    def close(self) -> None:
        pass


def sync(stream: DataFrame, target: str, alerts: str, checkpoint: str, context: int = 20, most: float = 0.05) -> StreamingQuery:
    """Upserts each micro-batch's bars into the years that it touches, and logs alerts and progress.

    What is known of each key lies in the state store, so neither the checks nor progress read the target, and the merge
    reads only the years that the batch touches. The checks see, before each key's rows of the batch, its last earlier ones
    (of its last `context` bars); alerts are those of the batch's rows, and `factor_change` where the factor moved by over
    `most` since the last bar. A batch that comes again finds the state as it was before, and replaces its own rows,
    alerts and progress. Rows without a key or a day are left out.
    """
    spark = stream.sparkSession
    schema = stream.schema
    out = StructType([*schema.fields]).add("kind", "string").add("old_factor", "double").add("total_records", "long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = stream.where("ts_code is not null and trade_date is not null").groupBy("ts_code").transformWithState(KnownBars(schema, context, most), out, "Append", "None")

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            new = rows.where("kind = 'new'").select(*schema.names)
            known = rows.where("kind in ('new', 'earlier')").select(*schema.names)
            ratio = F.round(F.abs(F.col("adj_factor") / F.col("old_factor") - 1), 6).cast("string")
            found = quality.run(known).join(new.select(*KEYS), KEYS, "left_semi").select("alert_type", *KEYS, "detail")
            moved = rows.where("kind = 'factor'").select(F.lit("factor_change").alias("alert_type"), *KEYS, ratio.alias("detail"))
            found.unionByName(moved).write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")
            progress = rows.where("kind = 'progress'").select("ts_code", F.col("trade_date").alias("last_date"), "total_records")
            progress.write.mode("overwrite").parquet(f"{target}-progress/batch={batch_id}")
            storage.write_incremental(rows.sparkSession, new.withColumn("year", F.year("trade_date")), target, "year", KEYS)
        finally:
            rows.unpersist()

    return keyed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_synced(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("year")


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Last day and number of rows of each key, after the last batch."""
    rows = spark.read.schema(f"{PROGRESS}, batch int").parquet(f"{target}-progress")
    return latest(rows, ["ts_code"], F.col("batch").desc()).select("ts_code", "last_date", "total_records")
