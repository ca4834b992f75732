"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, texts scanned once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, kept_in_worker, removed, staged

#: Words of an item that make a window.
WINDOW = 10
#: Windows that one broadcast automaton holds at most (some 100 MB); a larger benchmark goes in passes, one after the other.
WINDOWS_A_PASS = 500_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_built: dict[int, object] = kept_in_worker()

RUNS = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of ASCII digits, lower-cased letters and every character beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


def windows(items: list[tuple], size: int) -> dict[bytes, list]:
    out: dict[bytes, list] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            ids = out.setdefault(b" ".join(w[k : k + size]), [])
            if item not in ids[-1:]:
                ids.append(item)
    return out


def _automaton(shared):
    if shared.id not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton()
        for window, ids in shared.value.items():
            made.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
        if len(made):
            made.make_automaton()
        _built[shared.id] = made
    return _built[shared.id]


class _Shared:
    """A broadcast with a name by which a worker keeps what it has built from it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else id(broadcast)

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state


def scan(text: str | None, automaton) -> tuple[int, list[dict], list]:
    """Number of words; maximal runs of hit words with their offsets in the original's characters; items."""
    w = words(text)
    if not w or not len(automaton):
        return len(w), [], []
    spans, items, joined = [], set(), None
    joined = f" {b' '.join(w).decode('latin-1')} "
    for end, (n, ids) in automaton.iter(joined):
        spans.append((end, n))
        items.update(i for i in ids if i is not None)
    if not spans:
        return len(w), [], []
    spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in spans])  # a window that ends at space k has k as its last word, from 1
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, ends - [n for _, n in spans], 1)
    np.add.at(edge, ends, -1)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    place = lambda byte: int(chars[byte - 1]) if byte else 0
    runs = [{"first": int(a), "last": int(b) - 1, "start": place(at[a][0]), "end": place(at[b - 1][1])} for a, b in zip(turn[::2], turn[1::2])]
    return len(w), runs, sorted(items)


def passes_of(items: DataFrame) -> int:
    """Passes in which no more than WINDOWS_A_PASS words of items stand, as far as their length tells."""
    n = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0))).first()[0]  # words, at most
    return max(1, -(-int(n) // WINDOWS_A_PASS))


def find(text: Column, shared: _Shared, item_kind: str) -> Column:
    """struct<n_words, hits, items> of a text."""

    @F.pandas_udf(f"n_words long, hits {RUNS}, items array<{item_kind}>")
    def contamination(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared)
        for texts in batches:
            yield pd.DataFrame([scan(t, automaton) for t in texts], columns=["n_words", "hits", "items"])

    return contamination(text)


def united(one: Column, other: Column) -> Column:
    """The runs of two passes, as maximal runs."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(F.concat(one, other)), F.expr(f"cast(array() as {RUNS})"), join)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hits (runs of hit words, with offsets in the original text), n_hit, items and contaminated.

    A null or empty text has no words and no hits; an item without words (or null) has no windows; items of equal
    text are all reported, in the type of their ids; a null id is left out of items but its words are hit; repeated rows
    each get their own result. Columns of docs with one of these names are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = benchmark.schema[item].dataType.simpleString()
    asked = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    out, before = docs.drop("n_words", "hits", "items", "n_hit", "contaminated"), None
    passes = passes_of(asked)
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        shared = _Shared(spark.sparkContext.broadcast(windows([(r.item, r.text) for r in rows], size)))
        out = out.withColumn("_scan", find(F.col(text), shared, kind))
        hits, items = F.col("_scan.hits"), F.col("_scan.items")
        if k:
            hits, items = united(F.col("hits"), hits), F.array_distinct(F.concat("items", items))
        out = out.withColumns({"n_words": F.col("_scan.n_words"), "hits": hits, "items": items}).drop("_scan")
        if passes > 1:  # one automaton at a time: what it found is written before the next is made
            done, out = before, staged(out, "leaks")
            before = out
            shared.broadcast.destroy()
            if done is not None:
                removed(done)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return out.withColumns({"n_hit": n_hit, "contaminated": n_hit > 0})
