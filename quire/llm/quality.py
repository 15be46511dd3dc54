"""Quality classifier: kernel ridge by random Fourier features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, trim, unused

FOLDS, BINS, LOW, HIGH = 4, 2000, -0.75, 1.75
_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "space": (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)),
    "high": _BYTE >= 128,
}
_PUNCT = ~np.any(list(_CLASSES.values()), axis=0) & (_BYTE >= 32) & (_BYTE < 127)
_SINGLES = [ord(c) for c in ".,!?;:|#%&$*@/\\<>=_-\"'()[]{}"]
_SPACE = _CLASSES["space"]


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text: shares of kinds of characters, lengths, repetition, layout. Null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint8)
    n = max(1, len(codes))
    histogram = np.bincount(codes, minlength=256)
    tokens = raw.split()
    n_words = max(1, len(tokens))
    hashes = np.array([hash(t) for t in tokens], dtype=np.int64).view(np.uint64)
    distinct = len(np.unique(hashes)) / n_words
    if len(hashes) >= 3:
        with np.errstate(over="ignore"):
            runs = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes[2:]
        distinct_runs = len(np.unique(runs)) / len(runs)
    else:
        distinct_runs = 1.0
    lines = raw.split(b"\n")
    shares = histogram[histogram > 0] / n
    punct = _PUNCT[codes]
    ends = punct[:-1] & _SPACE[codes[1:]] if len(codes) > 1 else punct
    doubled = punct[:-1] & punct[1:] if len(codes) > 1 else punct
    return np.array([
        *(histogram[mask].sum() / n for mask in _CLASSES.values()),
        punct.sum() / n_words,
        ends.sum() / n_words,
        doubled.sum() / n_words,
        *np.sqrt(histogram[_SINGLES] / n_words),
        np.log1p(len(tokens)) / 10,
        (n - histogram[32]) / n_words / 10,
        distinct,
        distinct_runs,
        len(set(lines)) / len(lines),
        np.log1p(n_words / len(lines)) / 4,
        float(-(shares * np.log(shares)).sum()) if len(codes) else 0.0,
        float(not tokens),
    ])


N_STATS = len(statistics(""))


@dataclass
class QualityModel:
    """Fourier weights, standardisation, ridge weights and the calibration's steps: a few hundred kB at any input size."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.hstack([waves, z / 10, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.xs, self.ys) if len(stats) else np.zeros(0)


def with_statistics(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """`docs` with the column `into` of its texts' statistics (float64 values as bytes)."""

    @F.pandas_udf("binary")
    def stats(texts: pd.Series) -> pd.Series:
        found = pd.Series([statistics(t).tobytes() for t in texts], dtype=object)
        trim()
        return found

    return docs.withColumn(into, stats(text))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def fit(stats: DataFrame, scratch: Scratch, seed: int = 5, n_waves: int = 256, ridge: float = 1e-3) -> QualityModel:
    """Fits rows (doc_id, stats, label): all of them, none sampled. They are read three times, so `stats` had better be a written table.

    One pass sums moments for the standardisation. One pass sums the normal equations of each of four
    folds (by a hash of doc_id) within its partition; the partial sums, all of one size (1.5 MB), are added in a
    tree with a fan-in of 16, so the driver gets 4 at most. The whole sum gives the weights; each fold is also scored by the
    weights of the other three, and those scores, counted in 2,000 bins, are calibrated by pooling
    adjacent violators. Rows without label or statistics are left out. Without any rows every text scores 0.5.
    """
    rows = stats.where("label IS NOT NULL AND stats IS NOT NULL").select("doc_id", "stats", F.col("label").cast("double").alias("label"))
    rng = np.random.default_rng(seed)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["stats"])
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pd.DataFrame({"j": np.arange(N_STATS), "n": n, "s": s, "q": q})

    sums = rows.mapInPandas(moments, "j int, n long, s double, q double").groupBy("j").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("j").collect()
    if not sums:
        one = np.ones(N_STATS)
        empty = np.zeros((N_STATS, n_waves))
        return QualityModel(one, one, empty, np.zeros(n_waves), np.zeros(n_waves + N_STATS + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    n = sums[0][1]
    mean = np.array([r[2] for r in sums]) / n
    scale = np.sqrt(np.maximum(np.array([r[3] for r in sums]) / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    model = QualityModel(
        mean, scale, rng.normal(size=(N_STATS, n_waves)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, n_waves), np.zeros(n_waves + N_STATS + 1), np.zeros(0), np.zeros(0)
    )
    width = len(model.weights) + 1
    upper = np.triu_indices(width)  # the rest is the same mirrored

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, width, width))
        seen = False
        for pdf in batches:
            if not len(pdf):
                continue
            seen = True
            z = np.hstack([model.features(_matrix(pdf["stats"])), pdf["label"].to_numpy()[:, None]])
            fold = pdf["fold"].to_numpy()
            for f in range(FOLDS):
                part = z[fold == f]
                total[f] += part.T @ part
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total[:, upper[0], upper[1]].tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in pdf["sums"])
        return pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    folded = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(FOLDS)).cast("int"))
    partial = scratch.save(folded.mapInPandas(normal, "part long, sums binary"), "sums")
    left = partial.count()
    while left > 4:
        left = max(4, -(-left // 16))
        partial = partial.groupBy(F.pmod("part", F.lit(left)).alias("part")).applyInPandas(add, "part long, sums binary")
    sums = partial.collect()
    scratch.drop("sums")
    flat = sum(np.frombuffer(r["sums"], dtype=np.float64).reshape(FOLDS, -1) for r in sums)
    total = np.zeros((FOLDS, width, width))
    total[:, upper[0], upper[1]] = flat
    total[:, upper[1], upper[0]] = flat

    def solve(a: np.ndarray) -> np.ndarray:
        count = max(a[-2, -2], 1.0)
        return np.linalg.solve(a[:-1, :-1] + ridge * count / width * np.eye(width - 1), a[:-1, -1])

    model.weights = solve(total.sum(0))
    others = np.stack([solve(total.sum(0) - total[f]) for f in range(FOLDS)])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, good = np.zeros(BINS), np.zeros(BINS)
        for pdf in batches:
            if len(pdf):
                raw = (model.features(_matrix(pdf["stats"])) * others[pdf["fold"].to_numpy()]).sum(1)
                at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
                count += np.bincount(at, minlength=BINS)
                good += np.bincount(at, weights=pdf["label"].to_numpy(), minlength=BINS)
        hit = np.flatnonzero(count)
        yield pd.DataFrame({"bin": hit, "n": count[hit], "good": good[hit]})

    bins = folded.mapInPandas(binned, "bin long, n double, good double").groupBy("bin").agg(F.sum("n"), F.sum("good")).orderBy("bin").collect()
    model.xs, model.ys = isotonic(np.array([LOW + (r[0] + 0.5) * (HIGH - LOW) / BINS for r in bins]), np.array([r[1] for r in bins]), np.array([r[2] for r in bins]))
    return model


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration: the pooled rates, each at the mean score of its pool."""
    pools: list[list[float]] = []
    for xi, ni, gi in zip(x, n, good, strict=True):
        pools.append([xi * ni, ni, gi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.clip([p[2] / p[1] for p in pools], 0.0, 1.0)


def scored(rows: DataFrame, model: QualityModel, stats: str) -> Column:
    """The score of the statistics in the column `stats`."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(values)) if len(values) else np.zeros(0))

    return score(rows[stats])


def labelled(stats: DataFrame, labels: DataFrame, key: str, column: str) -> DataFrame:
    """(doc_id, stats, label) of the documents that `labels` (doc_id, label) marks; repeated labels are averaged first."""
    once = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    return stats.select(F.col(key).alias("doc_id"), F.col(column).alias("stats")).join(once, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, QualityModel]:
    """(`docs` without text and with `score`, the model), learnt from the documents that `labels` (doc_id, label) marks.

    Each text is read once: its statistics are kept in the shared folder. Null and empty texts are scored as texts
    without words. Repeated rows and null keys each have their row; a row takes part in the fit as often as it occurs, and not
    with a null key or label. An input column named `score` is replaced, others pass through. An empty table gives
    no rows; without labelled documents every score is 0.5.
    """
    (stats,) = unused(docs, "_stats")
    rows = scratch.save(with_statistics(docs.drop("score"), stats, text).drop(text), "statistics")
    model = fit(scratch.save(labelled(rows, labels, key, stats), "labelled"), scratch)
    scratch.drop("labelled")
    return rows.withColumn("score", scored(rows, model, stats)).drop(stats), model


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts score `least` or more, by a model learnt as `classify` does.

    The rows are written with their statistics, so that each text is read once. Odd rows are as in `classify`; without labelled
    documents all rows stay.
    """
    (stats,) = unused(docs, "_stats")
    rows = scratch.save(with_statistics(docs, stats, text), "statistics")
    model = fit(scratch.save(labelled(rows, labels, key, stats), "labelled"), scratch)
    scratch.drop("labelled")
    return rows.where(scored(rows, model, stats) >= least).drop(stats)
