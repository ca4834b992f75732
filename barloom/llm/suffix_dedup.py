"""Removal of long repeated substrings by distributed prefix doubling over sampled positions.

Ranking every position would move some twenty times the input, so positions are sampled first: of the gram starts
inside any window of the least length asked for, the one with the smallest hash is an anchor. Equal windows have equal
anchors at equal places, so no repeat is missed. Spark then ranks the anchors in rounds, each over strings that reach
further: round 1 sorts the pairs of ranks at offset 0 and at half a gram, and drops anchors whose gram is unique; round 2
pairs what is left with its whole context (past the threshold on both sides), which settles those that repeat; round 3
takes those still unique among equal grams and ranks, for each offset, the pair of what lies left of the gram and right
of it. Runs of a short period are told by their first and last gram and by the phases of the windows that they fill.
Strings are compared by ranks of 64 bits in each half of a pair; names of strings come from hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, staged

#: Bytes of a string that goes if it repeats; bytes and words of a repeated passage that is counted, though it stays.
THRESHOLD, PASSAGE, PASSAGE_WORDS = 400, 300, 50
#: Contexts of one gram that are compared in one task; those of a more common gram are ranked window by window in a shuffle.
GROUP_LIMIT = 20_000
#: Bytes that are hashed at once, and rows that are compared at once.
_CHUNK, _ROWS = 4 << 20, 8192
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank of a pair of ranks."""
    with np.errstate(over="ignore"):
        h = (x * _A + y) * _B
    return h ^ (h >> np.uint64(29))


def ranks(b: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the rank of the string of that length at each position, by doubling."""
    with np.errstate(over="ignore"):
        now = (b.astype(np.uint64) + np.uint64(1)) * _A
    made: dict[int, tuple[np.ndarray, int]] = {}
    size = 1
    while size <= max(lengths):
        for n in lengths:
            if n & size:
                if n not in made:
                    made[n] = now, size
                else:
                    head, done = made[n]
                    m = max(0, len(now) - done)
                    made[n] = pair(head[:m], now[done : done + m]), done + size
        if len(now) <= size:
            now = now[:0]
        else:
            now = pair(now[:-size], now[size:])
        size *= 2
    return {n: made[n][0][: max(0, len(b) - n + 1)] for n in lengths}


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def gram_of(least: int) -> int:
    """Bytes of a gram; longer ones are rarer, shorter ones leave wider windows and so fewer anchors."""
    return least // 4


def anchors(b: np.ndarray, threshold: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, with names of their gram's two halves (32 bits each) and of their context."""
    gram = gram_of(least)
    half, beyond, n = gram // 2, threshold - gram, len(b)
    width = least - gram + 1
    at, first, second, contexts = [], [], [], []
    for s in range(0, n - least + 1, _CHUNK):
        part = b[max(0, s - beyond) : s + _CHUNK + threshold - 1 + width]
        shift = s - max(0, s - beyond)
        r = ranks(part, sorted({half, gram - half, gram, beyond + threshold}))
        g = r[gram][shift : shift + _CHUNK + width - 1]
        low = _slide(g, width, np.minimum)
        zero = np.zeros(width - 1, np.uint64)
        here = np.flatnonzero(_slide(np.concatenate((zero, low, zero)), width, np.maximum) == g)
        pos = here + s
        whole = r[beyond + threshold]
        inner = here + shift - beyond
        known = (pos >= beyond) & (pos + threshold <= n) & (inner >= 0) & (inner < len(whole))
        c = np.zeros(len(here), np.uint64)
        c[known] = whole[inner[known]]
        for k in np.flatnonzero(~known).tolist():
            i, before, after = int(pos[k]), min(beyond, int(pos[k])), min(beyond, n - gram - int(pos[k]))
            raw = b[i - before : i + gram + after].tobytes() + f"|{before}|{after}".encode()
            c[k] = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)[0]
        at.append(pos)
        first.append(r[half][here + shift])
        second.append(r[gram - half][here + shift + half])
        contexts.append(c)
    pos = np.concatenate(at)
    _, once = np.unique(pos, return_index=True)
    short = lambda x: (np.concatenate(x)[once] >> np.uint64(32)).astype(np.uint32)
    return pos[once], short(first), short(second), np.concatenate(contexts)[once]


def periodic_runs(b: np.ndarray, pos: np.ndarray, first: np.ndarray, second: np.ndarray, gram: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Which anchors stay, and (anchor, period, start, end) of the runs with a period of a quarter gram at most.

    Inside a run the same gram is an anchor at every period. A window that the run doesn't fill has the run's end, and so its
    last gram, or its start and first gram inside: those two stay. Windows that the run fills are told by gram and phase.
    """
    step = np.diff(pos)
    tie = (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & (step <= gram // 4)
    stay, runs = np.ones(len(pos), bool), {}
    for k in np.flatnonzero(tie).tolist():
        if k and tie[k - 1] and step[k - 1] == step[k]:
            stay[k] = False
            continue
        end = k
        while end < len(tie) and tie[end] and step[end] == step[k]:
            end += 1
        period, low, high = int(step[k]), int(pos[k]), int(pos[end]) + gram
        while low:
            m = min(low, 4096)
            off = np.flatnonzero(b[low - m : low] != b[low - m + period : low + period])
            low -= m if not len(off) else m - 1 - int(off[-1])
            if len(off):
                break
        while high < len(b):
            m = min(len(b) - high, 4096)
            off = np.flatnonzero(b[high : high + m] != b[high - period : high + m - period])
            high += m if not len(off) else int(off[0])
            if len(off):
                break
        runs[low, high, period] = k, period, low, high
    return stay, list(runs.values())


def run_windows(runs: list[tuple[int, int, int, int]], pos: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(anchor, phase, first byte, end, size): for each run, size and phase the windows inside the run, as the bytes they cover."""
    out = []
    for k, period, low, high in runs:
        for size in sizes:
            for x in range(low, min(low + period, high - size + 1)):
                out.append((k, (int(pos[k]) - x) % period, x, x + (high - size - x) // period * period + size, size))
    return out


def repeated_windows(gram: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, copies: np.ndarray, beyond: int) -> np.ndarray:
    """For each anchor and offset, whether the window that starts so far before the anchor starts elsewhere too.

    Windows are beyond bytes longer than a gram. The gram is a rank, left runs backwards.
    """
    reach = left.shape[1]
    tail = np.empty((beyond + 1, len(gram)), np.uint64)
    tail[0] = gram
    for j in range(beyond):
        tail[j + 1] = pair(tail[j], right[:, j].astype(np.uint64) + np.uint64(1))
    head, out = gram.copy(), np.zeros((len(gram), reach + 1), bool)
    for o in range(min(reach, beyond) + 1):
        if o:
            head = pair(head, left[:, o - 1].astype(np.uint64) + np.uint64(1))
        ok = np.flatnonzero((n_left >= o) & (n_right >= beyond - o))
        _, which, count = np.unique(pair(head[ok], tail[beyond - o][ok]), return_inverse=True, return_counts=True)
        out[ok, o] = (count[which] > 1) | (copies[ok] > 1)
    return out


def _spans(pos: np.ndarray, dup: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under runs of repeated windows."""
    edge = np.diff(np.pad(dup.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, pos[row] - (high - 1), pos[row] - low + size


def reranked(pairs: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Rank of each pair of ranks that more than one position has, in the order of the pairs."""
    found = pairs.groupBy(first, second).count().where("count > 1").drop("count")
    return found.orderBy(first, second).withColumn(name, F.monotonically_increasing_id())


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, group_limit: int = GROUP_LIMIT, doc_id: str = "doc_id", text: str = "text", passage: int | None = PASSAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and kept (the remaining bytes), one row for each input row.

    A byte goes if it lies in a string of threshold bytes that also starts elsewhere in docs, the same document included;
    matches stay inside documents. n_passages counts the maximal runs under strings of passage bytes (threshold bytes, if
    that is less or passage is None) that also start elsewhere and that hold more than passage_words words; they stay where
    they are shorter than the threshold. Null texts are empty; texts shorter than the threshold keep all. Repeated rows are
    each other's copies, so both lose what is long enough. doc_id may be null or shared by different texts. The threshold
    is 8 bytes or more.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sizes = sorted({threshold, min(threshold, passage or threshold)})
    least = sizes[0]
    if (gram_len := gram_of(least)) < 2:
        raise ValueError("a threshold of 8 bytes or more is needed")
    reach = right = threshold - gram_len  # a window may have the kept gram of a run, and no other, at its end
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"row": F.xxhash64("doc_id", "text"), "size": F.octet_length("text")})
    none = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def placed(b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors (until and of are 0), then windows of periodic runs (the context is the phase)."""
        pos, first, second, contexts = anchors(b, threshold, least)
        stay, runs = periodic_runs(b, pos, first, second, gram_len)
        filled = np.array(run_windows(runs, pos, sizes), np.int64).reshape(-1, 5)
        k, zero = filled[:, 0], np.zeros(int(stay.sum()), np.int64)
        return (np.concatenate((pos[stay], filled[:, 2])), np.concatenate((first[stay], first[k])), np.concatenate((second[stay], second[k])), np.concatenate((contexts[stay], filled[:, 1].astype(np.uint64))), np.concatenate((zero, filled[:, 3])), np.concatenate((zero, filled[:, 4])))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            made = [placed(np.frombuffer(raw, np.uint8)) if len(raw) >= least else none for raw in texts]
            index = pa.array(np.repeat(np.arange(len(texts)), [len(m[0]) for m in made]))
            pos, first, second, contexts, until, of = (np.concatenate(x) for x in zip(*made)) if made else none
            columns = [pa.array(first.view(np.int32)), pa.array(second.view(np.int32)), pa.array(contexts.view(np.int64)), b.column("row").take(index), pa.array(pos.astype(np.int32)), b.column("size").take(index), pa.array(until.astype(np.int32)), pa.array(of.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["first", "second", "ctx", "row", "pos", "size", "until", "of"])

    kind = docs.schema[doc_id].dataType.simpleString()
    every = staged(rows.where(F.col("size") >= least).select("row", "size", "text").mapInArrow(sample, "first int, second int, ctx long, row long, pos int, size int, until int, of int"), "anchors")
    halves, whole = ["first", "second"], ["gram", "ctx"]
    found, phase = every.where("of = 0").drop("until", "of"), ["first", "second", "ctx", "of"]
    filled = every.where("of > 0")
    often = filled.groupBy(*phase).agg(F.sum(F.when(F.col("until") - F.col("pos") > F.col("of"), 2).otherwise(1)).alias("n")).where("n > 1").drop("n")
    in_runs = filled.join(often, phase).select("row", "size", F.col("pos").alias("start"), F.col("until").alias("end"), "of")
    held = staged(found.join(reranked(found, *halves, "gram"), halves).drop(*halves), "anchor-ranks")
    contexts = held.groupBy(*whole).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("row", "pos", "size")])
    shared = staged(contexts.join(contexts.groupBy("gram").agg(F.count("*").alias("n_ctx")), "gram"), "context-ranks")
    start, end = F.greatest(F.col("pos") - reach, F.lit(0)), F.least(F.col("pos") + threshold, "size")
    settled = held.join(shared.where("n > 1").select(*whole), whole).select("row", "size", start.alias("start"), end.alias("end"))
    settled = settled.withColumn("of", F.when(F.col("end") - F.col("start") >= threshold, threshold).otherwise(least)).where("end - start >= of")

    asked = shared.where("n_ctx > 1").groupBy("row", "size").agg(F.collect_list(F.struct("gram", "pos", "n", "n_ctx")).alias("asked"))
    with_text = rows.join(asked, ["row", "size"]).select("row", "size", "text", "asked")
    schema = "gram long, row long, size int, pos int, n_left int, n_right int, n long, n_ctx long, head binary, tail binary"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, asks = b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist()
            out = [[] for _ in range(9)]
            for k, (raw, ask) in enumerate(zip(texts, asks)):
                for x in ask:
                    pos = x["pos"]
                    nl, nr = min(reach, pos), min(right, len(raw) - gram_len - pos)
                    row = (k, x["gram"], pos, nl, nr, x["n"], x["n_ctx"], raw[pos - nl : pos][::-1].ljust(reach, b"\0"), raw[pos + gram_len : pos + gram_len + nr].ljust(right, b"\0"))
                    for c, v in zip(out, row):
                        c.append(v)
            index = pa.array(out[0], pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            g, pos, nl, nr, n, n_ctx, head, tail = [pa.array(c, t) for c, t in zip(out[1:], kinds)]
            yield pa.RecordBatch.from_arrays([g, b.column("row").take(index), b.column("size").take(index), pos, nl, nr, n, n_ctx, head, tail], ["gram", "row", "size", "pos", "n_left", "n_right", "n", "n_ctx", "head", "tail"])

    open_rows = staged(with_text.mapInArrow(extend, schema), "anchor-contexts")
    spans_kind = "row long, size int, start int, end int, of int"

    def matrix(t: pa.Table, name: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(-1, width)

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda k: t.column(k).to_numpy()
        t = t.combine_chunks()
        head, tail = matrix(t, "head", reach), matrix(t, "tail", right)
        for size in sizes:
            dup = repeated_windows(col("gram").view(np.uint64), head, tail, col("n_left"), col("n_right"), col("n"), size - gram_len)
            dup[col("n") > 1] = False  # settled by their whole context
            row, i, j = _spans(col("pos"), dup, size)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([t.column("row").take(at).combine_chunks(), t.column("size").take(at).combine_chunks(), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), size, np.int32))], ["row", "size", "start", "end", "of"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            g = np.asarray(b.column("gram"))
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if size + b.num_rows < _ROWS or not len(cuts):
                if held and size >= _ROWS and held[-1].column("gram")[-1].as_py() != int(g[0]):
                    yield from settle(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(b)
                size += b.num_rows
                continue
            cut = int(cuts[-1])  # the last gram may go on in the next batch
            yield from settle(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held, size = [b.slice(cut)], b.num_rows - cut
        if held:
            yield from settle(pa.Table.from_batches(held))

    few = open_rows.where(F.col("n_ctx") <= group_limit).repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, spans_kind)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                t = pa.Table.from_batches([b.slice(k, 512)]).combine_chunks()
                if not t.num_rows:
                    continue
                g, pos, nl, nr = (t.column(c).to_numpy() for c in ("gram", "pos", "n_left", "n_right"))
                head, tail = matrix(t, "head", reach).astype(np.uint64) + np.uint64(1), matrix(t, "tail", right).astype(np.uint64) + np.uint64(1)
                ends = [g.view(np.uint64)]
                for j in range(right):
                    ends.append(pair(ends[-1], tail[:, j]))
                now, row, at, key, of = g.view(np.uint64), [], [], [], []
                for o in range(reach + 1):
                    now = pair(now, head[:, o - 1]) if o else now
                    for size in sizes:
                        beyond = size - gram_len - o
                        if beyond < 0:
                            continue
                        ok = np.flatnonzero((nl >= o) & (nr >= beyond))
                        row.append(ok)
                        at.append(pos[ok] - o)
                        key.append(pair(now[ok], ends[beyond][ok]))
                        of.append(np.full(len(ok), size, np.int32))
                index = pa.array(np.concatenate(row))
                take = lambda c: t.column(c).take(index).combine_chunks()  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([take("gram"), pa.array(np.concatenate(key).view(np.int64)), take("row"), take("size"), pa.array(np.concatenate(at).astype(np.int32)), take("n"), pa.array(np.concatenate(of))], ["gram", "win", "row", "size", "start", "n", "of"])

    many = open_rows.where(F.col("n_ctx") > group_limit).select("gram", "row", "size", "pos", "n_left", "n_right", "n", "head", "tail").mapInArrow(windows, "gram long, win long, row long, size int, start int, n long, of int")
    again = many.groupBy("gram", "win", "of").agg(F.sum("n").alias("total")).where("total > 1").select("gram", "win", "of")
    common = many.where("n = 1").join(again, ["gram", "win", "of"]).select("row", "size", "start", (F.col("start") + F.col("of")).alias("end"), "of")

    spans = settled.unionByName(in_runs).unionByName(few).unionByName(common).groupBy("row", "size").agg(F.collect_set(F.struct("start", "end", "of")).alias("spans"))
    joined = rows.join(spans, ["row", "size"], "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept(raw, spans, threshold, passage_words) for raw, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist())]
            n_bytes, removed, runs, digest, passages, left = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(passages, pa.int64()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary")


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of the bytes under some spans; adjoining ones are one."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = out[-1][0], max(j, out[-1][1])
        else:
            out.append((i, j))
    return out


def kept(raw: bytes, spans: list[dict] | None, threshold: int, passage_words: int) -> tuple[int, int, int, str, int, bytes]:
    """Bytes, removed bytes and runs of them, digest of what is left, repeated passages, and what is left."""
    gone = _runs([(x["start"], x["end"]) for x in spans or () if x["of"] == threshold])
    passages = sum(len(raw[i:j].split()) > passage_words for i, j in _runs([(x["start"], x["end"]) for x in spans or ()]))
    parts, done = [], 0
    for i, j in gone:
        parts.append(raw[done:i])
        done = j
    left = b"".join([*parts, raw[done:]])
    return len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), passages, left
