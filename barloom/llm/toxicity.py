"""Toxic passages: maximal scoring segments over token log-odds, aggregated by extreme-value calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, fold_of
from barloom.llm.decontam import words

#: Tokens are counted in so many buckets, which bounds the model for any corpus.
BUCKETS = 1 << 18
#: Labelled rows of each class that the model is fitted on (those of the smallest id hash), and the prior's weight against them.
TRAIN_ROWS, PRIOR_SHARE = 20_000, 0.05
#: Log-odds of a smaller z-score count as none; what each token costs a segment; the E-value of a significant segment.
Z_LEAST, DRIFT, E_MOST = 3.0, 0.05, 0.3
#: Steps of the log of the evidence in which calibration counts.
STEPS = 16
_EULER = 0.5772156649015329


#: Bytes of the word starts that count as tokens of their own, so that inflected and compound words are known.
STARTS = (4, 5, 6)


def buckets(text: str | None) -> np.ndarray:
    """A row for each word: the bucket of the word and those of its starts; a start not shorter than the word is the word's."""
    w = words(text)
    out = np.empty((len(w), 1 + len(STARTS)), np.int64)
    out[:, 0] = np.fromiter(map(crc32, w), np.int64, len(w))
    for k, n in enumerate(STARTS):
        out[:, k + 1] = np.fromiter([crc32(x[:n], n) if len(x) > n else crc32(x) for x in w], np.int64, len(w))
    return out & (BUCKETS - 1)


def word_scores(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The strongest log-odds among a word's tokens."""
    each = scores[ids]
    return np.take_along_axis(each, np.abs(each).argmax(axis=1)[:, None], axis=1)[:, 0] - DRIFT


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float = PRIOR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of each token with an informative Dirichlet prior, and its z-score (Monroe et al., 2008)."""
    both = toxic + clean
    prior = share * both.sum()
    a = prior * (both + 0.01) / (both + 0.01).sum()
    y1, y0, n1, n0 = toxic + a, clean + a, toxic.sum() + prior, clean.sum() + prior
    delta = np.log(y1 / np.maximum(n1 - y1, 1e-9)) - np.log(y0 / np.maximum(n0 - y0, 1e-9))
    return delta, delta / np.sqrt(1 / y1 + 1 / y0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time (Ruzzo and Tompa, 1999)."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    before = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[list] = []  # first, end, cumulative score before and after
    for i in up.tolist():
        one = [i, i + 1, float(before[i]), float(before[i + 1])]
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= one[2]:
                k = out[k][4]
            if k < 0 or out[k][3] >= one[3]:
                out.append([*one, k])
                break
            one[0], one[2] = out[k][0], out[k][2]
            del out[k:]
    return [(a, b, r - left) for a, b, left, r, _ in out]


def decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) over the background is 1."""
    if not (scores > 0).any() or weights.sum() <= 0:
        return 1.0
    p = weights / weights.sum()
    mean = lambda x: float((p * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    low, high = 1e-4, 1e-4
    while mean(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def evidence(text: str | None, model: dict) -> tuple[float, float, list[dict]]:
    """Summed excess of the significant segments' bit scores; best score; the segments as word offsets."""
    ids = buckets(text)
    found = maximal_segments(word_scores(ids, model["scores"])) if len(ids) else []
    if not found:
        return 0.0, 0.0, []
    base = math.log(model["k"] * len(ids)) - math.log(E_MOST)
    kept = [(a, b, s) for a, b, s in found if model["decay"] * s - base > 0]
    return sum(model["decay"] * s - base for _, _, s in kept), max(s for _, _, s in found), [{"first": a, "last": b - 1, "score": s} for a, b, s in kept]


def _train_rows(docs: DataFrame, labels: DataFrame, fold: int | None, folds: int) -> DataFrame:
    each = labels.where("doc_id is not null and toxic is not null")
    if fold is not None:
        each = each.where(fold_of("doc_id", folds) != fold)
    each = each.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    part = lambda y: each.where(F.col("toxic") == y).orderBy("_h", "doc_id").limit(TRAIN_ROWS)
    chosen = part(0).unionByName(part(1)).select(F.col("doc_id").alias("_id"), "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fold: int | None = 0, folds: int = 5) -> dict:
    """The model, from counts that Spark gathers over the labelled rows outside the fold."""
    train = _train_rows(docs, labels, fold, folds)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for rows in batches:
            for text, y in zip(rows.text, rows.toxic):
                total[1 if y else 0][np.unique(buckets(text))] += 1  # documents with the token: repeats in one say nothing new
        y, b = np.nonzero(total)
        yield pd.DataFrame({"toxic": y, "bucket": b, "n": total[y, b]})

    sums = train.mapInPandas(count, "toxic long, bucket long, n long").groupBy("bucket").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")).toPandas()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[sums.bucket.to_numpy(int)], clean[sums.bucket.to_numpy(int)] = sums.t.to_numpy(float), sums.c.to_numpy(float)
    model = {"scores": np.zeros(BUCKETS), "decay": 1.0, "k": 1.0, "a": 0.0, "b": -30.0}
    if not toxic.sum() or not clean.sum():  # one class at most was seen: every text gets its share
        model |= {"a": 0.0, "b": 30.0 if toxic.sum() else -30.0}
        return model
    delta, z = log_odds(toxic, clean)
    model["scores"] = np.where(np.abs(z) >= Z_LEAST, delta, 0.0)
    model["decay"] = decay(model["scores"] - DRIFT, clean)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, y in zip(rows.text, rows.toxic):
                _, s, _ = evidence(text, shared.value)
                out.append((y, s, math.log(max(1, len(words(text))))))
            yield pd.DataFrame(out, columns=["toxic", "s", "n"])

    m = train.mapInPandas(best, "toxic int, s double, n double").where("toxic = 0 and s > 0").agg(F.avg("s"), F.avg("n")).first()
    if m[0] is not None:  # the mean of the largest of n scores is (ln(K n) + Euler's constant) / lambda
        model["k"] = min(1.0, max(1e-6, math.exp(model["decay"] * m[0] - _EULER - m[1])))
    calibrated = docs.sparkSession.sparkContext.broadcast(dict(model))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = [round(math.log1p(evidence(t, calibrated.value)[0]) * STEPS) for t in rows.text]
            yield pd.DataFrame({"x": x, "toxic": rows.toxic})

    seen = train.mapInPandas(bins, "x int, toxic int").groupBy("x", "toxic").count().toPandas()
    model["a"], model["b"] = logistic(seen.x.to_numpy(float) / STEPS, seen.toxic.to_numpy(float), seen["count"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of y on x by Newton's method, with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (y - p) * x).sum() - 0.1 * a, (n * (y - p)).sum() - 0.1 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def score(text: Column, shared) -> Column:
    """struct<score, segments> of a text."""

    @F.pandas_udf("score double, segments array<struct<first:int,last:int,score:double>>")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            out = []
            for t in texts:
                x, _, kept = evidence(t, model)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, model["a"] * math.log1p(x) + model["b"])))), kept))
            yield pd.DataFrame(out, columns=["score", "segments"])

    return toxicity(text)


def detect(docs: DataFrame, labels: DataFrame, fold: int | None = 0, folds: int = 5) -> DataFrame:
    """docs with tox_score (0 to 1) and segments (significant passages as word offsets).

    The score depends on the text alone: null, empty and wordless texts get that of a text without passages.
    Labels that are null are not learned; a document with several labels counts as toxic if one says so. Repeated
    rows get equal scores. Columns of docs of these names are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold, folds))
    out = docs.drop("tox_score", "segments").withColumn("_tox", score(F.col("text"), shared))
    return out.withColumns({"tox_score": F.col("_tox.score"), "segments": F.col("_tox.segments")}).drop("_tox")
