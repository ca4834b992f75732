"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, staged
from barloom.llm.components import node_of, with_component

#: Least bits of a table, classes for each bucket of a table from which there are more bits, share of pairs at the threshold
#: that may meet in no table, and the seed of the hyperplanes.
BITS, FILL, LOSS, SEED = 16, 2048, 4e-5, 7
#: Vectors of a bucket that are compared in one task; a larger bucket is compared block by block.
BLOCK = 1024


def sizes(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and tables for n vectors: as many buckets as vectors need, as many tables as the loss allows."""
    bits = max(BITS, math.ceil(math.log2(max(n, 1) / FILL)))
    meet = (1 - math.acos(min(threshold, 1 - 1e-9)) / math.pi) ** bits
    return bits, math.ceil(math.log(LOSS) / math.log1p(-meet))


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each input row.

    Vectors link if their labels are equal and not null, they have as many components, and their cosine reaches the
    threshold. A vector that is null, empty or zero, or holds null or non-finite components, links with nothing, as
    does one without label; its component is its own vec_id. A row without vec_id links like any other but names no
    component and is not kept. Equal vectors form a class that is compared once; every row of a class counts as a link of
    the others, repeated rows included. Pairs are never emitted: a task adds up links and joins each vector to the root
    of its group.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    bits, tables = sizes(vectors.count(), threshold)
    x = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("digest", F.when(valid, F.md5(x.cast("string").cast("binary"))))
    good = rows.where("digest is not null")
    classes = good.groupBy("label", "digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("e").alias("e"))
    classes = classes.select(node_of(F.col("first_id"), F.xxhash64("digest", "label")).alias("node"), "first_id", F.xxhash64("digest", "label").alias("d2"), "label", "digest", "n", "e", F.size("e").alias("dim"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, sigs = np.asarray(b.column("dim")), [None] * b.num_rows
            lists = b.column("e").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                up = unit(np.stack([lists[i] for i in at])) @ planes(int(dim), tables, bits) > 0
                code = (up.reshape(len(at), tables, bits) << np.arange(bits)).sum(axis=2)
                for i, row in zip(at.tolist(), code.tolist()):
                    sigs[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.list_(pa.int64()))], [*b.schema.names, "sigs"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    signed = staged(classes.mapInArrow(sign, f"{kinds}, sigs array<long>"), "vector-classes")
    bucket, name = ["label", "dim", "t", "s"], ["node", "d2"]
    keys = signed.select(*name, "label", "dim", F.xxhash64("sigs").alias("all"), F.posexplode("sigs").alias("t", "s"))
    # vectors that agree in all tables meet in the first: a bucket of such alone has no new pair
    shared = keys.groupBy(*bucket).agg(F.count("*").alias("m"), F.min("all").alias("low"), F.max("all").alias("high")).where("m > 1 and (t = 0 or low != high)")
    meets = keys.join(shared, bucket).groupBy(*name).agg(F.collect_list(F.struct("t", "s", F.ceil(F.col("m") / block).cast("int").alias("blocks"))).alias("meets"))
    dealt = signed.join(meets, name).select(*name, "label", "dim", "n", "e", "sigs", F.explode("meets").alias("x"))
    dealt = dealt.select(*name, "label", "dim", "n", "e", "sigs", "x.*").withColumn("own", F.pmod(F.xxhash64(*name), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other"), "sigs": F.slice("sigs", 1, F.col("t"))}).drop("blocks", "other")
    group = [*bucket, "p", "q"]
    dealt = dealt.withColumn("group", F.xxhash64(*group)).repartition(*group).sortWithinPartitions("group", *group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["group", "dim", "t", "s", "p", "q"]):
            out = _links(g, threshold)
            if out is not None:
                yield out

    found = staged(dealt.mapInArrow(compare, "node long, d2 long, links long, root long"), "vector-links")
    sums = found.groupBy(*name).agg(F.sum("links").alias("links"))
    links = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    per_class = with_component(signed.select(*name, "first_id", "label", "digest", "n").join(sums, name, "left"), links, "first_id", not signed.where("first_id is null").isEmpty())
    per_class = per_class.select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "label", "digest").join(per_class, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in sorted batches; runs may span batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        marks = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if tuple(marks[i]) != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(marks[i])
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _links(g: pa.Table, threshold: float) -> pa.RecordBatch | None:
    if g.num_rows < 2:
        return None
    col = lambda k: g.column(k).to_numpy()
    t, p, q = int(col("t")[0]), int(col("p")[0]), int(col("q")[0])
    own, n, node, d2, labels = col("own"), col("n").astype(np.int64), col("node"), col("d2"), g.column("label").to_pylist()
    x = unit(np.stack(col("e")))
    left, right = (np.arange(len(node)), np.arange(len(node))) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
    if not len(left) or not len(right):
        return None
    near = x[left] @ x[right].T >= threshold
    if t and near.any():  # a pair counts in the first table where it meets
        sigs = np.stack(col("sigs"))
        for k in range(t):
            near &= sigs[left, k][:, None] != sigs[right, k]
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    if p == q:
        i, j = i[i < j], j[i < j]
    if len(set(labels)) > 1:
        kind = np.unique(np.array([str(v) for v in labels]), return_inverse=True)[1]
        i, j = i[kind[i] == kind[j]], j[kind[i] == kind[j]]
    if not len(i):
        return None
    links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
    root = np.argsort(np.argsort(node, kind="stable"), kind="stable")  # ranks: the smallest node becomes the root
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    seen = np.flatnonzero(links)
    names = np.sort(node, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(node[seen]), pa.array(d2[seen]), pa.array(links[seen].astype(np.int64)), pa.array(names[root[seen]])], ["node", "d2", "links", "root"])
