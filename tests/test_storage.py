"""Layouts: what a scan reads, what a merge or a compaction touches, appended versions, registered sources."""

import os
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from barloom.operators import pit, storage
from barloom.sources import adapters

BARS = "ts_code string, trade_date date, close double"


def bars(spark, keys=200, days=60):
    start = date(2024, 1, 1)
    return spark.createDataFrame([(f"k{k:04d}", start + timedelta(days=n), float(k + n)) for k in range(keys) for n in range(days)], BARS)


def scan_of(df):
    """The scan of a plan without exchanges, after it has run."""
    found, todo = None, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found = node
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def measured(node, name):
    return node.metrics().apply(name).value()


def test_layered_scan_reads_little(spark, tmp_path):
    root, b = str(tmp_path / "layers"), bars(spark)
    for layer, times in (("raw", 1.0), ("adjusted", 2.0), ("raw", 1.0)):
        storage.write_layer(b.withColumn("close", F.col("close") * times), root, layer, page_rows=100)
    assert sorted(p.name for p in (tmp_path / "layers").iterdir() if p.name.startswith("layer")) == ["layer=adjusted", "layer=raw"]
    got = storage.read_layer(spark, root, "raw", ["k0003", "k0190", "nobody"], "2024-01-05", "2024-01-09")
    assert sorted((r.ts_code, r.trade_date.day, r.close) for r in got.collect()) == sorted((f"k{k:04d}", n + 1, float(k + n)) for k in (3, 190) for n in range(4, 9))
    scan = scan_of(got)
    plan = scan.toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "In(ts_code" in plan and "GreaterThanOrEqual(trade_date" in plan
    files = len(list((tmp_path / "layers" / "layer=raw").glob("*.parquet")))
    assert measured(scan, "numFiles") == files, "no file of the other layer"
    assert measured(scan, "numOutputRows") <= 400, "row groups and pages of other keys are skipped"
    none = storage.read_layer(spark, root, "raw", ["k0003x"])
    assert none.collect() == [] and measured(scan_of(none), "numOutputRows") == 0, "the bloom filter rules every row group out"
    assert storage.read_layer(spark, root, "adjusted").count() == 200 * 60


def test_compaction_touches_large_cold_partitions_only(spark, tmp_path):
    path = tmp_path / "t"
    rows = bars(spark).withColumn("year", F.when(F.col("ts_code") < "k0100", 2019).when(F.col("ts_code") < "k0102", 2020).otherwise(2024))
    for k in range(4):
        rows.where(F.crc32("ts_code") % 4 == k).repartition(1).write.mode("append").partitionBy("year").parquet(str(path))
    before = {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("*.parquet")}
    large = sum(n for f, (_, n) in before.items() if "year=2019" in f)
    cold = F.col("part").cast("int") < 2021
    assert storage.compact_cold(spark, str(path), "year", cold, least=large, target=large) == ["2019"]
    after = {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("*.parquet")}
    assert {f: x for f, x in after.items() if "year=2019" not in f} == {f: x for f, x in before.items() if "year=2019" not in f}
    assert sum("year=2019" in f for f in after) == 1 and spark.read.parquet(str(path)).exceptAll(rows).isEmpty() and spark.read.parquet(str(path)).count() == rows.count()
    assert storage.compact_cold(spark, str(path), "year", cold, least=large // 2, target=large) == [], "a second time there is nothing to do"
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_bins_of_files(spark):
    files = spark.createDataFrame([("f1", 40, "2019"), ("f2", 40, "2019"), ("f3", 40, "2019"), ("f4", 90, "2020"), ("g1", 10, "2023"), ("g2", 200, "2023")], "file string, bytes long, part string")
    plan = storage.compaction_plan(files, F.col("part") < "2023", least=90, target=80).collect()
    assert sorted((r.file, r.bin) for r in plan) == [("f1", 0), ("f2", 0), ("f3", 1)], "one file of more than a bin stays"


def test_versions_append(spark, tmp_path):
    folder, schema = str(tmp_path / "v"), "k string, at int, x string"
    add = lambda rows, batch: pit.append_versions(spark, folder, spark.createDataFrame(rows, schema), ["k"], ["at"], batch)
    add([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r")], 0)
    for _ in range(2):
        add([("a", 3, "s"), (None, 1, "t")], 1)
    add([("a", 4, "u")], 2)
    add([("a", 3, "s"), (None, 1, "t")], 1)
    got = sorted(((r.k or "", r.version, r.x, r.status) for r in pit.read_versions(spark, folder, ["k"]).collect()))
    assert got[0] == ("", 1, "t", "active") and got[-1] == ("b", 1, "r", "active")
    assert len(got) == 6 and [s for k, _, _, s in got if k == "a"].count("active") == 1
    changes = spark.read.parquet(f"{folder}/changelog")
    assert changes.count() == 6 and {r.action for r in changes.collect()} == {"store"}


def test_source_gets_the_range(spark, tmp_path):
    """Bounds on the day reach fetch; each task asks for its own days."""
    asked = str(tmp_path)

    def fetch(first, last):
        open(f"{asked}/{first}_{last}", "w").close()
        days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
        yield pa.RecordBatch.from_pydict({"ts_code": ["a"] * len(days), "trade_date": days, "close": [float(d.day) for d in days]})

    adapters.register(spark, "asked_bars", fetch, BARS, date(2020, 1, 1), date(2024, 12, 31), step=10)
    rows = spark.read.format("asked_bars").load().where("trade_date > date'2024-02-01' and trade_date <= date'2024-02-25' and close > 5")
    assert sorted(r.trade_date.day for r in rows.collect()) == [*range(6, 26)]
    assert sorted(os.listdir(asked)) == ["2024-02-02_2024-02-11", "2024-02-12_2024-02-21", "2024-02-22_2024-02-25"]
    assert spark.read.format("asked_bars").load().where("trade_date > date'2025-02-01'").count() == 0
