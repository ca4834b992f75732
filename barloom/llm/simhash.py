"""SimHash near-duplicates and verified near copies: fingerprints, BK-trees in shards, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, staged
from barloom.llm.components import node_of, with_component

#: Words of a shingle, seed of XXH64, differing bits of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a shard from which it is dealt out anew by bands of the bits that its members may differ in.
SHARD_LIMIT = 4096
#: Texts of a shard of near copies that are compared in one task; a larger shard is compared block by block.
COPY_BLOCK = 2048
_CHUNK = 1 << 16
#: Near copies: words of a shingle, least Jaccard similarity, differing bits up to which sets are compared.
COPY_SHINGLE, COPY_LEAST, COPY_RADIUS = 5, 0.8, 24
#: Min-hash bands that deal texts into shards, and rows of a band; a pair at 0.8 meets in none with probability 4e-4.
COPY_BANDS, COPY_ROWS = 20, 5
#: Bytes of an Arrow batch of texts or of sets of shingles: sets are larger than their texts, and a worker holds both.
COPY_BATCH = 4 << 20


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and splits at 20 and 09-0D only
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    stop = (start[shingle - 1 :] + size[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[i:j], seed) for i, j in zip(start.tolist(), stop)]


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def majority(hashes: list[int]) -> int:
    """Signed integer of the bits that are set in more than half of the hashes; zero if there are none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = np.array(hashes[k : k + _CHUNK], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Signed 64-bit SimHash of a text's word shingles; zero if it has no words."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return simhash(text)


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows edges within the radius only."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, x: int) -> None:
        if not self.nodes:
            self.nodes.append((x, {}))
            return
        at = 0
        while True:
            value, children = self.nodes[at]
            d = (value ^ x).bit_count()
            if d == 0:
                return
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((x, {}))
                return
            at = children[d]

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [0] if self.nodes else []
        while todo:
            value, children = self.nodes[todo.pop()]
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            todo += [k for e, k in children.items() if d - radius <= e <= d + radius]


def shard_links(values: list[int], radius: int, others: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among (unsigned) values, or between them and others: at most one from each to the root of its group, not all pairs."""
    if others is None and len(values) == 2:
        a, b = values
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    tree, root = BKTree(), {x: x for x in [*values, *(others or ())]}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x in others or ():
        tree.add(x)
    for x in values:
        for y in tree.near(x, radius):
            root[find(y)] = find(x)
        if others is None:
            tree.add(x)
    return [(x, r) for x in root if (r := find(x)) != x]


def bands(n: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of count bands over n bits."""
    edges = [n * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def deal(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """Each row once for every one of count bands of its shard's free bits: its shard there, whose free bits are the others."""
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    for b in batches:
        fp, node, shard, free = (np.asarray(b.column(c)).view(np.uint64) for c in ("fp", "node", "shard", "free"))
        for mask in np.unique(free):
            at = np.flatnonzero(free == mask)
            bits = [k for k in range(64) if int(mask) >> k & 1]
            for j, (low, width) in enumerate(bands(len(bits), count)):
                band = np.uint64(sum(1 << k for k in bits[low : low + width]))
                with np.errstate(over="ignore"):
                    h = (((shard[at] + np.uint64(j + 1)) * mix) ^ (fp[at] & band)) * turn
                    h ^= h >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp[at], node[at], h * mix, np.full(len(at), mask & ~band))], names=["fp", "node", "shard", "free"])


def links(prints: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) between nodes that join all pairs of distinct fingerprints fp within the radius into the same groups.

    Two such fingerprints agree in a whole band of any radius + 1 bands. A shard holds the fingerprints that agree in a
    band. One of more than limit is dealt out again by radius + 1 bands of its other bits, without loss; what is still
    larger is searched in pairs of blocks of limit fingerprints, so no task holds more than two blocks.
    """
    schema = "fp long, node long, shard long, free long"
    rows = prints.select("fp", "node", F.lit(0).cast("long").alias("shard"), F.lit(-1).cast("long").alias("free"))
    ready = []
    for last in (False, True):
        dealt = staged(rows.mapInArrow(lambda batches: deal(batches, radius + 1), schema), "shards")
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        small = dealt.join(sizes if last else sizes.where(F.col("n") <= limit), "shard")
        blocks = F.ceil(F.col("n") / limit).cast("int")
        small = small.select("shard", "fp", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
        small = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        ready.append(small.select("shard", "fp", "node", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))
        large = sizes.where(F.col("n") > limit).select("shard")
        if last or large.isEmpty():
            break
        rows = dealt.join(large, "shard")
    every = (ready[0] if len(ready) == 1 else ready[0].unionByName(ready[1])).withColumn("group", F.xxhash64("shard", "p", "q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, node, own, p, q in _runs(batches, "group", ["fp", "node", "own", "p", "q"]):
            values, left = fp.view(np.uint64), own == p[0]
            found = shard_links(values[left].tolist(), radius, None if p[0] == q[0] else values[~left].tolist())
            if found:
                name = dict(zip(values.tolist(), node.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([name[x] for x in c], pa.int64()) for c in zip(*found)], names=["a", "b"])

    return every.repartition("group").sortWithinPartitions("group", "fp").mapInArrow(search, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal keys in sorted batches; runs may span batches."""
    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        marks, data = np.asarray(b.column(key)), [np.asarray(b.column(c)) for c in columns]
        cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
        for i, j in zip(cuts, cuts[1:]):
            if marks[i] != last and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            last = marks[i]
            held.append([x[i:j] for x in data])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint) and component_id, the smallest doc_id reachable by links.

    One row for each input row. Null and empty texts have fingerprint zero and link like any other. A row whose
    doc_id is null never names a component; a component of such rows alone has component_id null. Repeated rows
    share their fingerprint and so their component.
    """
    bound_batches(docs.sparkSession)
    each = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    prints = each.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", node_of(F.col("first_id"), F.xxhash64("fp")))
    nameless = not each.where("doc_id is null").isEmpty()
    named = with_component(prints, links(prints, radius, limit), "first_id", nameless).select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def sketch_of(text: str | None, shingle: int = COPY_SHINGLE) -> tuple[int, list[int]]:
    """(sig, keys): a hash of the text's set of shingles, and its min-hash bands."""
    grams = _grams(shingle_hashes(text, shingle))
    low = np.full(len(_MIXERS), np.iinfo(np.uint64).max)
    for k in range(0, len(grams), 1024):
        low = np.minimum(low, ((grams[k : k + 1024, None] ^ _MASKS) * _MIXERS).min(axis=0))
    return _signed(grams, 0), [_signed(r, k) for k, r in enumerate(low.reshape(COPY_BANDS, COPY_ROWS))]


def set_of(text: str | None, shingle: int = COPY_SHINGLE) -> tuple[int, int, bytes]:
    """(sig, fp, grams): the same hash of the set, SimHash, and the sorted set itself (packed)."""
    hashes = shingle_hashes(text, shingle)
    grams = _grams(hashes)
    return _signed(grams, 0), majority(hashes), packed(grams)


def _grams(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def _signed(values: np.ndarray, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(values.tobytes(), seed) - (1 << 63)


def packed(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, six bytes each: sets are most of what the stage shuffles, and two different shingles of a pair of texts share these bits with a chance of 4e-15."""
    return np.unique(grams >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


_MASKS, _MIXERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, COPY_BANDS * COPY_ROWS), np.uint64, endpoint=False) | np.array([[0], [1]], np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def copy_links(members: list[tuple[int, int, bytes]], others: list[tuple[int, int, bytes]] | None, radius: int, least: float) -> list[tuple[int, int]]:
    """Links between (node, unsigned fp, grams) of a block, or of one block and others: a BK-tree proposes, the sets decide.

    None is looked for inside a group that earlier links have made.
    """
    tree, at, root, out = BKTree(), {}, {m[0]: m[0] for m in [*members, *(others or ())]}, []
    groups = len(root)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def hold(node, fp, grams):
        tree.add(fp)
        at.setdefault(fp, []).append((node, grams))

    for node, fp, raw in others or ():
        hold(node, fp, unpacked(raw))
    for node, fp, raw in members:
        if groups == 1:
            break
        grams = unpacked(raw)
        for other, theirs in (m for near in tree.near(fp, radius) for m in at[near]):
            if find(other) != find(node) and alike(grams, theirs, least):
                root[find(node)], groups = find(other), groups - 1
                out.append((node, other))
        if others is None:
            hold(node, fp, grams)
    return out


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = COPY_LEAST, radius: int = COPY_RADIUS, doc_id: str = "doc_id", text: str = "text", block: int = COPY_BLOCK) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links lead to; texts link if their sets of shingles are alike.

    Bands of the bits would be some four bits wide at this radius, so min-hash bands of the shingles deal the shards;
    equal shards are searched once, and one of more than block texts in pairs of blocks. Sets of shingles are made anew
    for texts that share a shard only, since the sets of all texts would be larger than the texts. One row for each
    input row; null and empty texts are one group; a component of rows without doc_id alone has component_id null.
    """
    bound_batches(docs.sparkSession, COPY_BATCH)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    @F.pandas_udf("sig long, keys array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([sketch_of(t, shingle) for t in some], columns=["sig", "keys"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([set_of(t, shingle) for t in some["text"]], columns=["sig", "fp", "grams"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, across, members in _shards(batches):
            if found := copy_links(own, members if across else None, radius, least):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    each = staged(texts.select("doc_id", sketch("text").alias("x")).select("doc_id", "x.*"), "sketches")
    nameless = not each.where("doc_id is null").isEmpty()
    classes = each.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))
    classes = staged(classes.withColumn("node", node_of(F.col("first_id"), F.col("sig"))), "classes")
    rows = classes.select("sig", F.explode(F.array_distinct("keys")).alias("key"))
    shards = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y")).where("n > 1")
    shards = shards.groupBy(F.xxhash64("n", "x", "y").alias("shard")).agg(F.min("key").alias("key"), F.first("n").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = rows.join(shards, "key").select("shard", "sig", blocks.alias("blocks"), F.pmod(F.xxhash64("sig"), blocks).cast("int").alias("own"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = staged(members.select("shard", "sig", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")), "shards")
    wanted = classes.join(members.select("sig").distinct(), "sig", "left_semi").select("sig", "first_id", "node")
    held = texts.join(wanted.select(F.col("first_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    if nameless:
        held = held.unionByName(texts.where("doc_id is null"))
    sets = held.select("text").mapInPandas(gather, "sig long, fp long, grams binary").join(wanted.select("sig", "node"), "sig").dropDuplicates(["sig"])
    group = F.xxhash64("shard", "p", "q")
    dealt = members.join(sets, "sig").select(group.alias("group"), "node", "fp", "grams", "own", "p", "q")
    links = dealt.repartition("group").sortWithinPartitions("group", "node").mapInArrow(search, "a long, b long").distinct()
    named = with_component(classes.drop("keys"), links, "first_id", nameless).select("sig", "component_id")
    return each.select("doc_id", "sig").join(named, "sig").select("doc_id", "component_id")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bool, list]]:
    """Of each run of equal groups in sorted batches: (node, unsigned fp, grams) of one block, whether there is another, and of that."""
    last, kept = None, ([], [])

    def block():
        across = bool(last[1] != last[2])
        return kept[0], across, kept[1]

    for batch in batches:
        for group, node, fp, grams, own, p, q in zip(*[batch.column(k).to_pylist() for k in ("group", "node", "fp", "grams", "own", "p", "q")]):
            if last and group != last[0]:
                yield block()
                kept = [], []
            last = group, p, q
            kept[own != p].append((node, fp & (1 << 64) - 1, grams))
    if last:
        yield block()
