"""Cost-balanced packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BATCH_BYTES, bound_batches, released, trimmed
from barloom.llm.encode import MEMO_ENTRIES, encoder

#: Capacity of a sequence; ids that a shard gathers before it is packed; width of the model that costs are estimated for.
CAPACITY, SHARD_IDS, HIDDEN = 2048, 1 << 22, 1024
#: With release: bytes of a batch, whose words are Python strings of some ten times that, and entries of the memo.
SMALL_BATCH, SMALL_MEMO = 1 << 20, 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n, hidden: int = HIDDEN):
    """Linear and quadratic (attention) work on n tokens, in units of a token's linear work."""
    return n + n * n / (6.0 * hidden)


def plan(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (document, start, length, sequence) and the number of sequences.

    Full windows of longer documents are sequences of their own. The rest go, in descending order, to the sequence of the
    lowest cost among those with room; a document that fits nowhere whole is cut, lowest cost first. Sequences
    are as many as are filled: of the capacity, and the remainder in powers of two, which need no padding.
    """
    pieces, n_seq, rest = [], 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            pieces.append((doc, start, capacity, n_seq))
            n_seq, start = n_seq + 1, start + capacity
        if n > start:
            rest.append((n - start, doc, start))
    total = sum(n for n, _, _ in rest)
    room = [capacity] * (total // capacity)
    left, bit = total % capacity, 1 << max(0, capacity.bit_length() - 1)
    while left:
        if bit <= left:
            room.append(bit)
            left -= bit
        bit >>= 1
    free, spent = np.array(room, np.int64), np.zeros(len(room))
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = free >= n
            among = fits if fits.any() else free > 0
            k = int(np.where(among, spent, np.inf).argmin())
            take = int(min(n, free[k]))
            pieces.append((doc, start, take, n_seq + k))
            free[k] -= take
            spent[k] += cost(take)
            start, n = start + take, n - take
    return pieces, n_seq + len(room)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text", release: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most capacity ids; each id, with end_id after each text, lies in one.

    Every task packs its own rows in shards of shard_ids ids (or one longer document), so nothing is shuffled and memory
    is bounded. Sequences are filled wholly or are of a power of two. Null texts are empty: their end_id alone.
    Repeated rows and null ids are packed like any others. With release, a worker forgets what other operators
    left in it before a task, reads smaller batches, remembers fewer word pieces and forgets them when the task ends, for a
    session in which other work shares the workers. The rows are the same.
    """
    bound_batches(docs.sparkSession, SMALL_BATCH if release else BATCH_BYTES)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if release:
            released()
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        coder.most = SMALL_MEMO if release else MEMO_ENTRIES
        base = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        size = done = 0

        def flush():
            nonlocal held, size, done
            pieces, n = plan([len(raw) // 4 for _, raw in held], capacity)
            used, out = [0] * n, []
            for doc, start, length, seq in pieces:
                name, raw = held[doc]
                out.append((name, start, length, crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, base + done + seq, used[seq]))
                used[seq] += length
            held, size, done = [], 0, done + n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for doc, raw in zip(ids, coder.encode_all(texts)):
                held.append((doc, raw + end))
                size += len(raw) // 4 + 1
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()
        if release:
            coder.forget()
            trimmed()

    return rows.mapInArrow(pack, PIECES)
