"""Sources of bars behind spark.read.format: any function of a range of days, read in parallel with the range pushed to it (X-03)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: fetch(first, last): record batches of the bars of the days from first to last, both inclusive.
Fetch = Callable[[date, date], Iterable[pa.RecordBatch]]


class Days(InputPartition):
    def __init__(self, first: date, last: date):
        super().__init__((first, last))


class BarsReader(DataSourceReader):
    """A task for each `step` days of the range, which filters on the day narrow before any task starts."""

    def __init__(self, fetch: Fetch, day: str, first: date, last: date, step: int):
        self.fetch, self.day, self.first, self.last, self.step = fetch, day, first, last, step

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the bounds of the day; what it can't take goes back to Spark."""
        one = timedelta(days=1)
        for f in filters:
            if getattr(f, "attribute", None) != (self.day,) or not isinstance(getattr(f, "value", None), date):
                yield f
                continue
            if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, f.value)
            if isinstance(f, (LessThanOrEqual, EqualTo)):
                self.last = min(self.last, f.value)
            if isinstance(f, GreaterThan):
                self.first = max(self.first, f.value + one)
            if isinstance(f, LessThan):
                self.last = min(self.last, f.value - one)
            if not isinstance(f, (GreaterThanOrEqual, EqualTo, LessThanOrEqual, GreaterThan, LessThan)):
                yield f

    def partitions(self) -> list[InputPartition]:
        n = (self.last - self.first).days + 1
        starts = [self.first + timedelta(days=k) for k in range(0, n, self.step)]
        return [Days(x, min(x + timedelta(days=self.step - 1), self.last)) for x in starts]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # else the range is empty
            yield from self.fetch(*partition.value)


def register(spark: SparkSession, name: str, fetch: Fetch, schema: str, first: date, last: date, day: str = "trade_date", step: int = 366) -> None:
    """After this, spark.read.format(name).load() reads the bars that fetch gives, from first to last.

    fetch runs in the tasks, so it must reach its source from there, and give each day's bars the same way whenever a task
    is run again. Bounds on the day in a query reach it as its arguments.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return BarsReader(fetch, day, first, last, step)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
