"""Quality classifier: kernel ridge by random Fourier features, with isotonic calibration.

Statistics of a text are standardized and mapped to cosines of random
projections, whose products approximate a Gaussian kernel. Each task sums the
normal equations over its labelled rows; FIT_TASKS tasks add up those sums, and
the driver solves them for ridge weights. Raw scores of labelled rows that had no part in
the fit are counted in bins, and pooled adjacent violators make them a
nondecreasing probability. The model is learned from FIT_ROWS labelled rows at
most, those of the least hash of their id, so that only their texts are measured
twice; the scores are of all rows.

Edge cases: a null or empty text has the statistics of an empty text and gets a
score. Rows with a null id have no label. An id with several labels counts once,
with the largest. Null labels are left out. Without labelled rows every score is
0.5. Only the columns named are read; ``keep_good`` keeps all columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, materialize

FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
THRESHOLD = 0.3
FEATURES, RIDGE, SEED = 256, 1e-3, 7
#: Labelled rows that a model is learned from, at most.
FIT_ROWS = 100_000
#: Tasks that add up the sums of all others (what reaches the driver is this many matrices), and bins of raw scores.
FIT_TASKS, BINS = 4, 1000
EQUATIONS = "n long, gram binary, moment binary"

LETTERS = re.compile(r"[^\W\d_]")
SYMBOLS = "#*$%&|<>"


def statistics(text: str) -> list[float]:
    """What a text looks like, whatever its language; shares lie in 0 to 1, sizes are logarithms."""
    n = len(text)
    words, lines = text.split(), text.split("\n")
    counts, n_words, n_lines = Counter(words), len(words), len(lines)
    chars = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n_words) if words else np.zeros(1)
    share = lambda k: k / max(n, 1)
    of_bytes = chars[chars > 0] / max(chars.sum(), 1)
    full = [line for line in lines if line.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        math.log1p(n), math.log1p(n_words), math.log1p(n_lines), sizes.mean(), sizes.std(), math.log1p(sizes.max()),
        share(chars[65:91].sum()), share(chars[48:58].sum()), share(sum(chars[ord(c)] for c in SYMBOLS)), share(chars[ord("!")]), share(chars[ord("|")]),
        share(chars[ord(".")] + chars[ord(",")]), share(chars[128:].sum()), share(chars[32] + chars[10]),
        len(counts) / max(n_words, 1), max(counts.values(), default=0) / max(n_words, 1), max(pairs.values(), default=0) / max(n_words - 1, 1),
        1 - len(set(full)) / max(len(full), 1), sum(1 for w in counts if w.isupper()) / max(len(counts), 1), sum(1 for w in counts if not LETTERS.search(w)) / max(len(counts), 1),
        sum(1 for w in counts if not w[-1].isalnum()) / max(len(counts), 1), float(-(of_bytes * np.log(of_bytes)).sum()), n / max(n_lines, 1) / 1000,
    ]


N_STATISTICS = len(statistics(""))


def with_statistics(df: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep`` and ``stats``, the statistics of its text; one pass, nothing is shuffled."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t or "") for t in batch], dtype=object)
        give_back()

    return df.select(*keep, stats(F.col(text_col)).alias("stats"))


@dataclass(frozen=True)
class Model:
    """All that a score needs; a few hundred kilobytes, whatever the size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    probability: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -5, 5) @ self.projection + self.phase
        return np.hstack((np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(stats), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.at, self.probability), 0, 1)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["stats"].to_numpy()) if len(batch) else np.empty((0, N_STATISTICS))


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """Ids with a label outside the held-out fold, ``rows`` at most: (_id, y, fold). Small enough to be broadcast."""
    target = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("y"))
    target = target.withColumn("fold", fold_of("_id")).filter(F.col("fold") != HELD_OUT)
    return F.broadcast(materialize(target.orderBy(F.xxhash64("_id"), "_id").limit(rows), "training-rows"))


def fit(known: DataFrame) -> Model:
    """A model from the rows (stats, y, fold) of ``known``."""
    known = materialize(known, "labelled")
    moments = known.agg(*(f(F.get("stats", F.lit(i))) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop))).first()
    moments = np.array([0.0 if x is None else x for x in moments]).reshape(-1, 2)
    rng = np.random.default_rng(SEED)
    projection = rng.normal(0, 1 / np.sqrt(N_STATISTICS), (N_STATISTICS, FEATURES))  # the kernel's width: a mean distance of standardized rows
    model = Model(moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1), projection, rng.uniform(0, 2 * np.pi, FEATURES))

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram, moment = 0, np.zeros((FEATURES + 1,) * 2), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch["y"].to_numpy()
            n, gram, moment = n + len(y), gram + z.T @ z, moment + z.T @ y
        yield pd.DataFrame({"n": [n], "gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram, moment = 0, np.zeros((FEATURES + 1) ** 2), np.zeros(FEATURES + 1)
        for batch in batches:
            for row in batch.itertuples():
                n, gram, moment = n + row.n, gram + np.frombuffer(row.gram), moment + np.frombuffer(row.moment)
        yield pd.DataFrame({"n": [n], "gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    # every task sums its own rows; FIT_TASKS tasks add those sums, one after another, and send one row each
    sums = known.filter(F.col("fold") != CALIBRATE).select("stats", "y").mapInPandas(equations, EQUATIONS)
    sums = sums.repartition(FIT_TASKS).mapInPandas(added, EQUATIONS).collect()
    n = sum(row.n for row in sums)
    if not n:
        return model
    gram = sum(np.frombuffer(row.gram).reshape(FEATURES + 1, -1) for row in sums)
    moment = sum(np.frombuffer(row.moment) for row in sums)
    weights = np.linalg.solve(gram + RIDGE * n * np.diag(np.append(np.full(FEATURES, 1 / FEATURES), 1e-9)), moment)
    model = Model(model.mean, model.scale, model.projection, model.phase, weights)
    low, high = -0.5, 1.5

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (model.raw(_matrix(batch)) - low) / (high - low)
            yield pd.DataFrame({"bin": np.clip(part * BINS, 0, BINS - 1).astype(np.int64), "y": batch["y"].to_numpy()})

    counts = known.filter(F.col("fold") == CALIBRATE).select("stats", "y").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    centres = [low + (row.bin + 0.5) * (high - low) / BINS for row in counts] or [0.0, 1.0]
    fitted = isotonic([row.y for row in counts], [row.n for row in counts]) if counts else [0.0, 1.0]
    return Model(model.mean, model.scale, model.projection, model.phase, weights, np.array(centres), np.array(fitted))


def isotonic(sums: list[float], sizes: list[float]) -> list[float]:
    """Means of bins made nondecreasing by pooling neighbours that violate the order."""
    pools: list[list[float]] = []
    for y, n in zip(sums, sizes, strict=True):
        pools.append([y, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2] + k]
    return [y / n for y, n, k in pools for _ in range(k)]


def score(stats: DataFrame, model: Model, keep: list) -> DataFrame:
    """Per row the columns ``keep`` and ``score``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score(_matrix(batch.to_frame("stats"))))

    return stats.select(*keep, scores("stats").alias("score"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row its id, whether its label was held out, its score and the prediction at THRESHOLD."""
    stats = materialize(with_statistics(df, [F.col(id_col).alias("_id")], text_col), "statistics")
    model = fit(stats.join(training_rows(labels, id_col, label_col), "_id").select("stats", "y", "fold"))
    scored = score(stats, model, ["_id"])
    held_out = F.coalesce(fold_of("_id") == HELD_OUT, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``df`` without the rows that are predicted to be of bad quality; all columns stay. Only labelled texts are measured for the fit."""
    labelled = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(training_rows(labels, id_col, label_col), "_id")
    model = fit(with_statistics(labelled, ["y", "fold"], "_text").select("stats", "y", "fold"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            stats = np.array([statistics(t or "") for t in batch]).reshape(-1, N_STATISTICS)
            yield pd.Series(shared.value.score(stats) >= THRESHOLD)
        give_back()

    return df.filter(good(F.col(text_col)))
