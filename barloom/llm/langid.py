"""Language identification by compression with a raw-content zstandard dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import bound_batches, fold_of, kept_in_worker

#: Bounded sample that a language's dictionary is made of: bytes of a dictionary, bytes of one text in it.
DICTIONARY_BYTES, TEXT_BYTES = 32 << 10, 1 << 10
#: Distinct texts of a language that are looked at for its dictionary.
SAMPLE_ROWS = 192
#: A text is rejected if its best two languages differ by less than this share of the best size.
MARGIN = 0.005
#: Texts are encoded in blocks of so many bytes, each with the dictionary, so that a long text's own repeats do not hide it.
BLOCK, LEVEL = 4096, 12
#: Each block is encoded behind this filler, the same for every language, since a frame of a few bytes would be stored
#: unshortened; a block's size is what it adds to the filler's.
_FILLER = bytes(256)

_NO_LETTER = re.compile(r"[\W\d_]+")

_ready: dict[str, list] = kept_in_worker()


def normalise(text: str) -> str:
    """Lower-case letters, with one space for whatever stands between."""
    return _NO_LETTER.sub(" ", text.lower())


def dictionaries(docs: DataFrame, fold: int | None = 2, folds: int = 4, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """Raw content of one dictionary for each language, from a bounded sample of labelled rows outside the fold.

    The sample: for each language the SAMPLE_ROWS distinct texts of the smallest hash, TEXT_BYTES of each. Distinct hashes
    are ranked first, so copies take one place and only the sampled texts move.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if fold is not None:
        rows = rows.where(F.coalesce(fold_of(doc_id, folds) != fold, F.lit(False)))
    rows = rows.select(F.col(lang).alias("lang"), F.substring(text, 1, TEXT_BYTES).alias("text")).withColumn("h", F.xxhash64("text"))
    ranked = lambda r: r.selectExpr("*", "row_number() over (partition by lang order by {}) as n".format(", ".join(r.columns[1:]))).where(F.col("n") <= SAMPLE_ROWS)
    low = ranked(rows.select("lang", "h").distinct()).drop("n")
    texts = ranked(rows.join(F.broadcast(low), ["lang", "h"], "left_semi").select("lang", "h", "text").distinct())
    found: dict[str, dict[str, None]] = {}
    for r in texts.orderBy("lang", "n").collect():  # SAMPLE_ROWS a language at most
        found.setdefault(r.lang, {})[r.text] = None
    out = {}
    for name, texts in sorted(found.items()):
        raw = " ".join(map(normalise, texts)).encode()[:DICTIONARY_BYTES]
        out[name] = raw if len(raw) >= 8 else raw.ljust(8)
    return out


class Coder:
    """Sizes of texts under the dictionary of one language."""

    def __init__(self, raw: bytes):
        self.coder = _compressor(raw, LEVEL)
        self.base = len(self.coder.compress(_FILLER))

    def size(self, raw: bytes) -> int:
        return sum(len(self.coder.compress(_FILLER + b" " + raw[i : i + BLOCK] + b" ")) - self.base for i in range(0, len(raw), BLOCK))


def _compressor(raw: bytes, level: int):
    import zstandard as z

    d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _coders(name: str, contents: dict[str, bytes]) -> list[tuple[str, Coder]]:
    if name not in _ready:
        _ready.clear()
        _ready[name] = [(lang, Coder(raw)) for lang, raw in sorted(contents.items())]
    return _ready[name]


def identify(text: Column, shared, name: str) -> Column:
    """struct<lang_pred, score, margin> of a text; und if it is null or has no letter or nothing was learned."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    @F.pandas_udf(kind)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = _coders(name, shared.value)
        for texts in batches:
            yield pd.DataFrame([verdict(t, coders) for t in texts], columns=["lang_pred", "score", "margin"])

    return language(text)


def verdict(text: str | None, coders: list) -> tuple[str, float, float]:
    if not text or not coders or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0
    raw = normalise(text).encode()
    sizes = sorted((c.size(raw), lang) for lang, c in coders)
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0
    margin = (sizes[1][0] - best) / max(best, 1)
    return lang, 0.5 + 0.5 * min(1.0, margin / 0.25), margin


def classify(docs: DataFrame, train: DataFrame | None = None, margin: float = MARGIN, fold: int | None = 2, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin and rejected (no letter, or a margin below the given one).

    Learns from train (docs if None) outside the fold. Null texts and texts without a letter are und, score 0 and
    rejected; with one learned language every other text is that language; with none, all are und. Ties go to the
    language first in the alphabet, with margin 0. Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    contents = dictionaries(docs if train is None else train, fold)
    shared = spark.sparkContext.broadcast(contents)
    import hashlib

    name = hashlib.sha256(repr(sorted(contents.items())).encode()).hexdigest()
    out = docs.drop("lang_pred", "score", "margin", "rejected").withColumn("_lang", identify(F.col(text), shared, name))
    out = out.withColumns({"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score"), "margin": F.col("_lang.margin")}).drop("_lang")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < margin))
