"""Token ids as directly addressable codes (Brisaboa, Ladra and Navarro, 2013) in Parquet-held segments.

A segment's payload: b"DAC1", then little-endian unsigned 32-bit: number of ids, number of levels; for each level
its number of chunks; then level by level: a rank directory (the ones before every 512th bit, 32 bits each), the
continuation bitmap (a bit for each chunk, lowest first) and the 8-bit chunks, lowest of an id on the first level.
The last level has neither bitmap nor directory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches
from barloom.llm.encode import encoder

MAGIC, RANK_EVERY = b"DAC1", 512
#: Ids in a segment, unless a single document has more.
SEGMENT_IDS = 1 << 20
SEGMENT = "part int, seq int, first_start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<II", len(ids), len(levels)), struct.pack(f"<{len(levels)}I", *[len(c) for c, _ in levels])]
    for k, (chunks, more) in enumerate(levels):
        if k < len(levels) - 1:
            ones = np.concatenate(([0], np.cumsum(more)))[: max(1, len(more)) : RANK_EVERY]
            out += [ones.astype("<u4").tobytes(), np.packbits(more, bitorder="little").tobytes()]
        out.append(chunks.tobytes())
    return b"".join(out)


def _layout(payload) -> list[tuple[int, int, int, int]]:
    """(chunks, directory offset, bitmap offset, chunk offset) of each level."""
    if bytes(payload[:4]) != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    n_levels = struct.unpack_from("<I", payload, 8)[0]
    sizes = struct.unpack_from(f"<{n_levels}I", payload, 12)
    at, out = 12 + 4 * n_levels, []
    for k, n in enumerate(sizes):
        directory, bitmap = at, at
        if k < n_levels - 1:
            bitmap = directory + 4 * -(-max(1, n) // RANK_EVERY)
            at = bitmap + -(-n // 8)
        out.append((n, directory, bitmap, at))
        at += n
    return out


def access(payload: bytes, i: int) -> int:
    """The id at position i, reading a byte, a bit and a rank on each level and decoding nothing else."""
    value, levels = 0, _layout(payload)
    if not 0 <= i < levels[0][0]:
        raise IndexError(i)
    for k, (_, directory, bitmap, chunks) in enumerate(levels):
        value |= payload[chunks + i] << (8 * k)
        if k == len(levels) - 1 or not payload[bitmap + i // 8] >> (i % 8) & 1:
            return value
        block = i // RANK_EVERY
        low = bitmap + block * RANK_EVERY // 8
        ones = sum(x.bit_count() for x in payload[low : bitmap + i // 8]) + (payload[bitmap + i // 8] & ((1 << i % 8) - 1)).bit_count()
        i = struct.unpack_from("<I", payload, directory + 4 * block)[0] + ones
    return value


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    levels, value = _layout(payload), None
    for k in range(len(levels) - 1, -1, -1):
        n, _, bitmap, chunks = levels[k]
        here = np.frombuffer(payload, np.uint8, n, chunks).astype(np.uint32)
        if value is not None:
            more = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").view(bool)
            here[more] |= value << np.uint32(8)
        value = here
    return value


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, each with end_id after it, in ascending doc_id order (nulls first, ties by text hash).

    Spark deals the rows out by ranges of doc_id and its committer writes the segments, so a repeated task leaves no
    second copy. Null texts are empty: their end_id alone.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size, seq, start
            ids = np.frombuffer(b"".join(raw for _, raw in held), "<u4")
            row = {"part": part, "seq": seq, "first_start": start, "n_ids": len(ids), "doc_ids": [d for d, _ in held], "lengths": [len(raw) // 4 for _, raw in held], "payload": pack(ids)}
            held, size, seq, start = [], 0, seq + 1, start + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), coder.encode_all(b.column("text").to_pylist())):
                n = len(raw) // 4 + 1
                if held and size + n > SEGMENT_IDS:
                    yield flush()
                held.append((doc, raw + end))
                size += n
        if held:
            yield flush()

    dealt.mapInArrow(encode, SEGMENT).write.option("compression", "zstd").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with start, the number of ids before them in the whole of the files."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each writing task
    base, starts = 0, []
    for r in parts:
        starts.append((r.part, base))
        base += r.n
    bases = spark.createDataFrame(starts, "part int, base long")
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless they aren't wanted) ids of each document, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, doc_ids, lengths, payload = (c[k] for c in b.columns)
                ids = np.ascontiguousarray(unpack(memoryview(payload.as_buffer())), "<u4")
                at = np.concatenate(([0], np.cumsum(np.asarray(lengths.values)))).astype(np.int64)
                raw = memoryview(ids).cast("B")
                crc = [crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = {"doc_id": doc_ids.values, "start": pa.array(start.as_py() + at[:-1]), "n_tokens": lengths.values, "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return _segments(spark, path).select("start", "doc_ids", "lengths", "payload").mapInArrow(decode, schema)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole of the files: finds its segment by start, then reads that id alone."""
    row = _segments(spark, path).where((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).select("start", "payload").first()
    if row is None:
        raise IndexError(position)
    return access(bytes(row.payload), position - row.start)
