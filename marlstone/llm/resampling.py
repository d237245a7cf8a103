"""Target-distribution importance resampling: documents drawn by how much likelier their words are in a target's texts.

Words and runs of words are hashed to buckets; a bucket's gain is the log ratio
of its share in the target to its share in the corpus. A document's weight is
the mean gain of its features, its score the weight plus Gumbel noise that
depends on its id alone, so that the highest scores are a sample without
replacement. The lowest drawn key is found exactly by radix selection: counts of
one digit at a time, from the top, of the rows that still share the prefix. Only
rows at or below it are sorted.

Rows: a null text has no features and weighs 0. A null id is the text "null" in
the noise and comes after all others. Repeated rows are rows of their own: what
score and id leave equal goes by the place of the row in the written table.
Empty tables draw nothing; an empty target gives the gains of no counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, slices

BUCKETS, RUNS, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Bits of a digit of the selection: at most so many counts, 2 ** DIGIT, reach the driver in a pass.
DIGIT = 12
#: Words whose bucket a task remembers.
MOST_KNOWN = 1_000_000

#: ASCII letters in lower case, digits and all bytes of other scripts stay; what else there is parts words.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Known(dict):
    """Buckets of features, hashed when first seen."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(texts: Iterable[str], runs: int, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts one after another; per text how many these are, and how many words."""
    found, sizes, words = [], [], []
    for text in texts:
        own = text.encode().translate(_TO_WORDS).split()
        grams = own + [b" ".join(g) for n in range(2, runs + 1) for g in zip(*(own[i:] for i in range(n)))]
        found += map(known.__getitem__, grams)
        sizes.append(len(grams))
        words.append(len(own))
    return np.array(found, np.int64), np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Features of all texts by bucket. A task sends one row for each bucket it has seen; ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = _Known(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in slices(batch["text"]):
                total += np.bincount(features(part, runs, known)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    counted = df.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in counted:
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    buckets = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + buckets) / ((corpus + 1.0) * (float(target.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(text: Column, gain: np.ndarray, runs: int = RUNS) -> Column:
    """Per text a struct of its features, its words and its weight, the mean gain rounded down; ``gain`` has a number for each bucket and goes to the tasks."""

    @F.pandas_udf("n_features long, n_words long, weight long")
    def weights(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(len(gain))
        for batch in batches:
            parts = []
            for _, part in slices(batch):
                found, sizes, words = features(part, runs, known)
                ends = np.cumsum(sizes)
                upto = np.concatenate(([0], np.cumsum(gain[found])))
                parts.append(pd.DataFrame({"n_features": sizes, "n_words": words, "weight": (upto[ends] - upto[ends - sizes]) // np.maximum(sizes, 1)}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_features": [], "n_words": [], "weight": []}, dtype="int64")

    return weights(text)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, by a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _within(bound: Sequence[tuple[str, int]]) -> Column:
    """Whether a row's key is at or below a bound, given by columns and values in order."""
    out = F.lit(True)
    for name, value in reversed(bound):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def smallest(rows: DataFrame, key: Sequence[str], k: int) -> Column:
    """A condition that holds for exactly the ``k`` rows of the least keys; ``key`` names columns of longs that make rows unique.

    One pass gives each column's range, so that digits which all rows share cost
    nothing; then each pass counts the values of one digit among the rows of the
    prefix found so far. It ends as soon as all rows of a prefix are wanted.
    """
    if k <= 0:
        return F.lit(False)
    ranges = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in key for f in (F.min, F.max)), F.count("*").alias("n")).first()
    if k >= ranges["n"]:
        return F.lit(True)
    bound: list[tuple[str, int]] = []
    for name in key:
        least, most = (ranges[f"{f}_{name}"] + 2**63 for f in ("min", "max"))
        left = (least ^ most).bit_length()
        value, same = most >> left << left, [F.col(c) == v for c, v in bound]
        unsigned = F.col(name).bitwiseXOR(F.lit(-(2**63)))
        while left:
            shift = max(0, left - DIGIT)
            prefix = F.shiftrightunsigned(unsigned, left) == F.lit(_signed(value >> left)) if left < 64 else F.lit(True)
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(2 ** (left - shift) - 1))
            counts = rows.filter(F.lit(True) if not same else _all(same)).filter(prefix).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()
            for digit_value, n in sorted((r["digit"], r["n"]) for r in counts):
                if n >= k:
                    break
                k -= n
            value |= digit_value << shift
            left = shift
            if n == k:
                return _within([*bound, (name, value + 2**left - 1 - 2**63)])
        bound.append((name, value - 2**63))
    return _within(bound)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in an order, from 1: range partitions are sorted and written, and each one's rows come after those of all before it."""
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0))]))).astype(int).tolist()
    place = F.get(F.lit(before), part.cast("int")) + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.withColumn(name, place.cast("long")).drop("_at")


def resample(docs: DataFrame, target: DataFrame, keep: Sequence[str] = ("doc_id",), percent: int = PERCENT, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """All documents with the columns ``keep``, n_features, weight, score and rank; rank is null for those that are not drawn.

    Of the documents with ``least_words`` words, ``percent`` of a hundred are
    drawn. ``keep`` may have any names; texts that are to be read on must be in
    it or joined by their id. Texts are read twice, to count and to weigh; what
    is written has a few numbers for each document.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, runs), bucket_counts(target, target_col, buckets, runs))
    inside = [f"_keep{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(c).alias(i) for c, i in zip(keep, inside, strict=True)), F.col(id_col).cast("long").alias("_id"), gumbel(F.col(id_col), seed).alias("_noise"), weigh(F.col(text_col), gain, runs).alias("_f"))
    key = {"_down": F.bitwise_not(F.col("_f.weight") + F.col("_noise")), "_last": F.col("_id").isNull().cast("long"), "_by_id": F.coalesce("_id", F.lit(0)), "_row": F.monotonically_increasing_id()}
    scored = materialize(own.select(*inside, *(c.alias(name) for name, c in key.items()), "_f.n_features", "_f.n_words", "_f.weight"), "scored")
    eligible = F.col("n_words") >= least_words
    candidates = scored.filter(eligible)
    drawn = smallest(candidates, list(key), percent * candidates.count() // 100) & eligible
    out = ranked(scored.filter(drawn), [F.col(c) for c in key]).unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*(F.col(i).alias(c) for c, i in zip(keep, inside, strict=True)), "n_features", "weight", F.bitwise_not("_down").alias("score"), "rank")
