"""Alignment of two tokenizers' ids on the same bytes: shared cuts by divide and conquer, linked ids and their corpus counts."""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, staged
from barloom.llm.encode import PieceEncoder

#: Documents are aligned in blocks of about so many characters (one document at least); links are summed in a block first.
BLOCK_CHARS = 4 << 20
#: Words that one worker remembers with their ids (about 300 bytes each); it starts afresh beyond them.
MEMO_WORDS = 300_000
#: Distinct pairs in one row of a block's sums.
ROW_PAIRS = 1 << 16

_HEX = re.compile(r"<0x([0-9A-F]{2})>")
_sides: dict[tuple[str, str], "Sides"] = {}


def byte_letters() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PlainEncoder(PieceEncoder):
    """Ids in which the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


class Sides:
    """Both tokenizers in one worker: ids of a text, bytes of each id, and words (with the space before them) encoded once.

    Neither has an entry in which a space follows another character, so both cut before a single space between two
    visible characters, and ids of a text are those of its words. Where an entry is otherwise, whole texts are encoded.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = PlainEncoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocab = self.a.tokenizer.get_vocab()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := _HEX.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes = a_bytes, b_bytes
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in self.bytes]
        self.by_word = self.a.by_piece and not any("▁" in p.lstrip("▁") for p in pieces)
        self.memo: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.text = [[np.array([f"{i}{mark}".encode() for i in range(len(side))]) for mark in marks] for side, marks in zip(self.bytes, (",|", ",;"))]

    def _learn(self, words: list[str]) -> None:
        if self.by_word:
            self.a._learn(words)
        else:
            self.a.memo.update(zip(words, self.a._raw([" " + w for w in words])))
        spell_a, spell_b = (side.__getitem__ for side in self.bytes)
        for word, ids in zip(words, self.b.encode(words, num_threads=1)):
            self.memo[word] = array("I", ids).tobytes()
            wanted = f" {word}".encode()
            # A byte-level vocabulary spells what it is given, unless its tokenizer changes the text first.
            if b"".join(map(spell_b, ids)) != wanted or not self.by_word and b"".join(map(spell_a, np.frombuffer(self.a.memo[word], "<u4").tolist())) != wanted:
                self.unlike.add(word)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of each text on both sides; none where it is null, empty, or where one side's bytes are not those of space and text."""
        cuts = [[] if not t else PieceEncoder.pieces(t) if self.by_word else [t] for t in texts]
        if len(self.memo) > MEMO_WORDS or not self.by_word:
            self.memo.clear()
            self.a.memo.clear()
            self.unlike.clear()
        new: set[str] = set()
        for cut in cuts:
            new.update(set(cut).difference(self.memo))
        self._learn(list(new))
        ids_a, ids_b = self.a.memo.__getitem__, self.memo.__getitem__
        return [(b"", b"") if self.unlike and not self.unlike.isdisjoint(cut) else (b"".join(map(ids_a, cut)), b"".join(map(ids_b, cut))) for cut in cuts]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the tokens that end together, in order, for intervals [from, to) of tokens whose last ones do.

    All intervals of a level go together. From the token of A in the middle outward, each end is sought among B's by
    bisection; the first that both have cuts the interval in two, which go to the next level in their order. Where there is none, or a
    side has a single token, the interval is a group and isn't cut further. Ends must rise from token to token.
    """
    at_a, at_b = [to_a - 1], [to_b - 1]
    while len(from_a):
        wide = (to_a - from_a > 1) & (to_b - from_b > 1)
        from_a, to_a, from_b, to_b = from_a[wide], to_a[wide], from_b[wide], to_b[wide]
        middle = (from_a + to_a - 2) // 2
        cut_a, cut_b = np.full(len(middle), -1), np.full(len(middle), -1)
        rest, step = np.arange(len(middle)), 0
        while len(rest):
            for k in (middle[rest] - step, middle[rest] + step)[: 1 + (step > 0)]:
                inside = (k >= from_a[rest]) & (k < to_a[rest] - 1)
                end = ends_a[np.where(inside, k, 0)]
                j = np.searchsorted(ends_b, end)
                hit = inside & (ends_b[j] == end) & (cut_a[rest] < 0)
                cut_a[rest[hit]], cut_b[rest[hit]] = k[hit], j[hit]
            step += 1
            rest = rest[(cut_a[rest] < 0) & ((middle[rest] - step >= from_a[rest]) | (middle[rest] + step < to_a[rest] - 1))]
        cut = cut_a >= 0
        at_a.append(cut_a[cut])
        at_b.append(cut_b[cut])
        a, b = cut_a[cut] + 1, cut_b[cut] + 1
        from_a, to_a, from_b, to_b = (np.stack(x, 1).ravel() for x in ((from_a[cut], a), (a, to_a[cut]), (from_b[cut], b), (b, to_b[cut])))
    return np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))


def rendered(sides: Sides, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;` for all groups, one after the other, and the place behind each group."""
    width = max(side[0].itemsize for side in sides.text)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    parts = np.empty(len(ids_a) + len(ids_b), f"S{width}")
    behind_a, behind_b = cut_a + 1, np.concatenate([[0], cut_b + 1])
    (more_a, end_a), (more_b, end_b) = sides.text
    place_b = np.arange(len(ids_b)) + behind_a[group_b]
    parts[np.arange(len(ids_a)) + behind_b[group_a]] = np.where(last_a, end_a[ids_a], more_a[ids_a])
    parts[place_b] = np.where(last_b, end_b[ids_b], more_b[ids_b])
    flat = parts.view(np.uint8).reshape(len(parts), width)
    used = flat != 0
    return flat[used].tobytes(), np.cumsum(used.sum(1))[place_b[cut_b]]


def aligned_block(sides: Sides, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Of each text n_a, n_b, n_groups, the groups' digest, its distinct pairs (a id, b id) and their numbers; the block's sums."""
    raw = sides.encode(texts)
    ids_a, ids_b = (np.frombuffer(b"".join([r[side] for r in raw]), "<u4").astype(np.int64) for side in (0, 1))
    n_a, n_b = (np.array([len(r[side]) // 4 for r in raw], np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(sides.lengths[0][ids_a]), np.cumsum(sides.lengths[1][ids_b])
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    some = n_a > 0
    cut_a, cut_b = shared_cuts(ends_a, ends_b, (to_a - n_a)[some], to_a[some], (to_b - n_b)[some], to_b[some])
    pairs = ids_a[cut_a] << 32 | ids_b[cut_b]
    stops = np.searchsorted(cut_a, to_a)
    text, behind = rendered(sides, ids_a, ids_b, cut_a, cut_b) if len(pairs) else (b"", np.zeros(0, np.int64))
    out, first = [], 0
    for k, stop in enumerate(stops.tolist()):
        distinct, times = np.unique(pairs[first:stop], return_counts=True)
        begin = int(behind[first - 1]) if first else 0
        digest = hashlib.sha256(text[begin : int(behind[stop - 1]) - 1]).hexdigest() if stop > first else ""
        out.append((int(n_a[k]), int(n_b[k]), stop - first, digest, distinct, times))
        first = stop
    return out, *np.unique(pairs, return_counts=True)


def _sides_of(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


ALIGNED = "doc_id {id}, n_a long, n_b long, n_groups long, groups_sha256 string, block long, is_sum boolean, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with its pairs, and for each block of documents rows (is_sum) with the block's pairs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides_of(a_path, b_path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // BLOCK_CHARS
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for i, j in zip(starts, starts[1:]):
                if i < j:
                    part = batch.slice(i, j - i)
                    block = uuid.uuid4().int >> 65
                    rows, distinct, times = aligned_block(sides, part.column(1).to_pylist())
                    yield _rows(part.column(0), rows, block)
                    for k in range(0, len(distinct), ROW_PAIRS):
                        yield _rows(pa.nulls(1, part.column(0).type), [(0, 0, 0, "", distinct[k : k + ROW_PAIRS], times[k : k + ROW_PAIRS])], block, True)

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, ALIGNED.format(id=kind))


def _rows(ids: pa.Array, rows: list[tuple], block: int, is_sum: bool = False) -> pa.RecordBatch:
    n_a, n_b, n_groups, digests, pairs, times = zip(*rows)
    at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
    nested = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int64))) for x in (pairs, times)]
    columns = [ids, *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(digests), pa.array([block] * len(rows), pa.int64()), pa.array([is_sum] * len(rows)), *nested]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "block", "is_sum", "pairs", "times"])


def pair_counts(sums: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold the pair, and whether no pair with its B id has more.

    The largest counts go to all executors: a row for each id of B, so never more than its vocabulary.
    """
    counts = sums.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each input row.

    A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model, both without special tokens. Documents
    are aligned a block at a time. Links are summed in the block before Spark sums them over the corpus, and counts come
    back to a block for its distinct pairs only, so a pair that all documents hold is one row for each block, and neither
    the vocabularies' product nor the corpus's pairs must fit in one place.

    Null and empty texts, and texts whose tokens on either side do not spell space and text, have zeros and ''. Repeated
    rows are documents of their own and count again; null ids stay; an empty table gives no rows; other columns of docs
    aren't read. A text is aligned whole, however long.
    """
    bound_batches(docs.sparkSession)
    found = staged(aligned(docs, a_path, b_path, doc_id, text), "aligned")
    sums = found.where("is_sum").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    scored = sums.select("block", "pair").join(pair_counts(sums), "pair").select("block", "pair", "n", "best")
    each = found.where("not is_sum").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.col("block").alias("of_block"), "pairs", "times")
    kind = docs.schema[doc_id].dataType.simpleString()

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, n, best = pair[order], right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        rows = left.column("pairs").combine_chunks()
        lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        times = left.column("times").combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, rows.flatten().to_numpy())
        edges = np.concatenate([[0], np.cumsum(lengths)])
        whole = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        best, total = (whole(times * best[at]), whole(times * n[at])) if len(pair) else (np.zeros(len(left), np.int64),) * 2
        kept = left.drop_columns(["of_block", "pairs", "times"])
        for name, x in (("n_links", whole(times)), ("n_best", best), ("count_sum", total)):
            kept = kept.append_column(name, pa.array(x.astype(np.int64)))
        return kept

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return each.groupBy("of_block").cogroup(scored.groupBy("block")).applyInArrow(totals, schema)
