"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed text features.

P(grade <= k) = sigmoid(t_k - f(text)) with ordered thresholds t_1 < t_2 < ... and one weight per hashed feature, shared by all
grades. A document's features are present or not, so one telling word counts as much in a long text as in a short one; an L1
penalty leaves weight only on telling features. Features: words, prefixes of 4 to 7 letters, at least 3 or 8 different words with a
prefix, runs of symbols, and the shares of symbols, capitals, repeats and short lines in steps. The fit is online (FTRL-proximal)
on a bounded sample of labelled rows; scoring is a narrow pass over all documents and gives expected grade and tail probability.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, SAMPLE, EPOCHS, BATCH = 20, 12_000, 10, 32
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.6, 0.5
THRESHOLD = 0.7
_MEMO = 200_000
_PARTS = re.compile(r"[^\W\d_]+|[^\w\s]{2,}|[|<>{}=*#$%&~^\\]")


def _at(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class _Words(dict):
    """Places of a word and its prefixes, as bytes of 32-bit numbers; emptied when it holds _MEMO words."""

    def __missing__(self, word: str) -> bytes:
        if word[:1].isalpha():
            whole, mask = word.encode("utf-8", "surrogatepass"), (1 << BITS) - 1
            made = [zlib.crc32(whole, 1) & mask]
            if len(word) > 4:
                sofar = zlib.crc32(word[:4].encode("utf-8", "surrogatepass"), 2)
                made.append(sofar & mask)
                for letter in word[4 : min(7, len(word) - 1)]:
                    sofar = zlib.crc32(letter.encode("utf-8", "surrogatepass"), sofar)
                    made.append(sofar & mask)
        else:
            made = [_at(f"s {word[:4]}"), _at(f"s {word[:1]}")]
        found = array("i", made).tobytes()
        if len(word) <= 40:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def _step(share: float) -> int:
    return min(10, int(share * 20 + 0.999))


def features(text: str | None) -> np.ndarray:
    """Sorted places (int32) of the features that a text has; none for null, empty and blank texts."""
    if not text or text.isspace():
        return np.zeros(0, np.int32)
    tokens = _PARTS.findall(text)
    lower = [*map(str.lower, tokens)]
    seen = set(lower)
    own, counts = np.unique(np.frombuffer(b"".join(map(_words.__getitem__, seen)), np.int32), return_counts=True)
    own = own.astype(np.int64)
    often = [(own[counts >= k] * 0x9E3779B1 + k) % (1 << BITS) for k in (3, 8)]
    n = len(tokens) or 1
    lines = text.split("\n")
    shares = {
        "repeats": sum(map(eq, lower, lower[1:])) / n,
        "symbols": 1 - sum(map(str.isalpha, tokens)) / n,
        "capitals": sum(map(str.isupper, tokens)) / n,
        "distinct": len(seen) / n,
        "short lines": sum(len(x) < 20 for x in lines) / len(lines),
    }
    return np.unique(np.concatenate([own, *often, [_at(f"{k} {_step(x)}") for k, x in shares.items()]])).astype(np.int32)


@dataclass
class Model:
    grades: list[int]
    thresholds: list[float]
    weights: np.ndarray  # float32, 2^BITS

    def tails(self, places: np.ndarray) -> list[float]:
        """P(grade >= g) of each grade but the lowest."""
        f = float(self.weights[places].sum()) if len(places) else 0.0
        return [1 / (1 + math.exp(max(-60.0, min(60.0, t - f)))) for t in self.thresholds]

    def expected(self, tails: list[float]) -> float:
        return self.grades[0] + sum((b - a) * p for a, b, p in zip(self.grades, self.grades[1:], tails)) if self.grades else 0.0


def fit(rows: Iterable[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits rows of (places, grade). Fewer than two grades give a model without thresholds, whose tails are empty."""
    rows = list(rows)
    grades = sorted({g for _, g in rows})
    size, k = 1 << BITS, len(grades) - 1
    if k < 1:
        return Model(grades, [], np.zeros(size, np.float32))
    rank = {g: i for i, g in enumerate(grades)}
    y = np.array([rank[g] for _, g in rows])
    share = [min(0.999, max(0.001, float((y <= i).mean()))) for i in range(k)]
    first = [math.log(p / (1 - p)) for p in share]
    params = np.array([first[0], *[math.log(max(0.05, b - a)) for a, b in zip(first, first[1:])]])
    spent = np.full(k, 1.0)
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    def thresholds() -> np.ndarray:
        return np.concatenate(([params[0]], params[0] + np.cumsum(np.exp(params[1:]))))

    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(turn), BATCH):
            some = turn[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in some])
            every = np.concatenate([rows[i][0] for i in some]) if sizes.sum() else np.zeros(0, np.int32)
            own, back = np.unique(every, return_inverse=True)
            w = weights(own)
            row = np.repeat(np.arange(len(some)), sizes)
            f = np.bincount(row, w[back], len(some))
            edges = np.concatenate(([-np.inf], thresholds(), [np.inf]))
            low, high = edges[y[some]] - f, edges[y[some] + 1] - f
            a, b = 1 / (1 + np.exp(-np.clip(low, -40, 40))), 1 / (1 + np.exp(-np.clip(high, -40, 40)))
            a[np.isneginf(low)], b[np.isposinf(high)] = 0, 1
            p = np.maximum(b - a, 1e-9)
            da, db = a * (1 - a) / p, b * (1 - b) / p  # slopes of -log p by the lower and by the upper threshold, up to sign
            slope = db - da  # of -log p by f
            g = np.bincount(back, slope[row], len(own)) / math.sqrt(len(some))
            old = n[own]
            n[own] = old + g * g
            z[own] += g - (np.sqrt(n[own]) - np.sqrt(old)) / ALPHA * w
            by = np.zeros(k)
            np.add.at(by, np.clip(y[some] - 1, 0, k - 1), np.where(y[some] > 0, da, 0))
            np.add.at(by, np.clip(y[some], 0, k - 1), np.where(y[some] < k, -db, 0))
            step = np.concatenate(([by.sum()], [math.exp(params[i]) * by[i:].sum() for i in range(1, k)])) / len(some)
            spent += step * step
            params -= 0.3 * step / np.sqrt(spent)
    return Model(grades, thresholds().tolist(), weights(np.arange(size)).astype(np.float32))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> list[tuple[np.ndarray, int]]:
    """(places, grade) of at most `sample` labelled documents: the first by a hash of their ids. Null ids and grades don't count.

    An id is one row of the sample, however often it occurs: repeated labels count by their lowest grade, and of repeated documents the
    text with the smallest digest is taken. Warns if the labels have several grades and the sample only one, which fits nothing.
    """
    graded = labels.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null")
    graded = graded.groupBy("id").agg(F.min("grade").alias("grade"))
    held = docs.sparkSession.createDataFrame(graded.orderBy(F.xxhash64("id"), "id").limit(sample).collect(), "id long, grade int")  # at most `sample` pairs of numbers
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(held), "id")
    # a partial minimum first, so a hot id moves one text from each task
    rows = rows.groupBy("id").agg(F.min("grade").alias("grade"), F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("least"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [features(x.as_py()).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.binary())], names=["id", "grade", "places"])

    found = rows.select("id", "grade", F.col("least.text").alias("text")).mapInArrow(make, "id long, grade int, places binary").collect()  # at most `sample` rows
    found = sorted((r["id"], bytes(r["places"]), r["grade"]) for r in found)  # a fixed order, so that the fit is the same each time
    if len({g for _, _, g in found}) < 2 and (known := graded.select("grade").distinct().count()) > 1:
        warnings.warn(f"{len(found)} labelled documents have one grade of {known}: all documents will be kept", stacklevel=2)
    return [(np.frombuffer(p, np.int32), g) for _, p, g in found]


def quality_grade(labels: DataFrame) -> DataFrame:
    """Ratings of labels (doc_id, quality, toxic): 2 for good and clean, one less for each that isn't so."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", names: Sequence[str] = ("_grade", "_tail", "_keep")) -> DataFrame:
    """docs with the columns `names`: expected grade, probability of the highest grade, and whether that is at least threshold.

    A narrow pass. Null, empty and blank texts have no features and get the thresholds' own odds. A model without thresholds keeps
    all: the probability is 1. The input's columns stay, whatever their names are; a caller whose columns may clash with `names` gives others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB of weights at any input size
    at, plain = docs.columns.index(text_col), docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)])
    fields = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            tails = [own.tails(features(x.as_py())) for x in batch.column(at)]
            top = [x[-1] if x else 1.0 for x in tails]
            made = [pa.array([round(own.expected(x), 6) for x in tails], pa.float64()), pa.array([round(x, 6) for x in top], pa.float64()), pa.array([x >= threshold for x in top], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "grade", "tail", "keep"])

    out = plain.mapInArrow(make, f"{fields}, grade double, tail double, keep boolean")
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)], *[F.col(x).alias(name) for x, name in zip(("grade", "tail", "keep"), names, strict=True)])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", names: Sequence[str] = ("_grade", "_tail", "_keep")) -> DataFrame:
    """score() of docs by a model fitted on labels (id_col, grade)."""
    return score(docs, fit(rated(docs, labels, sample, id_col, text_col)), threshold, text_col, names)
