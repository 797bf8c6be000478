"""Operator 7: a quality classifier, a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, packed, ship, utf8

FEATURES = (
    "log_words",
    "bytes_per_word",
    "symbols",
    "capitals",
    "exclamations",
    "digits",
    "punctuation",
    "bars",
    "non_ascii",
    "distinct_words",
    "top_word",
    "repeated_neighbours",
    "repeated_lines",
    "lines_per_word",
)
SAMPLE = 40_000  # labelled rows the model is fitted on, about; the bound of what the driver holds
BINS = 32
ROUNDS = 120
PAIRS = 6
THRESHOLD = 0.3
FOLDS = 5  # labels of fold 0 are held out


def features(text: bytes) -> list[float]:
    """What the model sees of one whole text; empty texts give zeros."""
    found = text.split()
    if not found:
        return [0.0] * len(FEATURES)
    n = len(found)
    size = len(text)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = size - byte[9:14].sum() - byte[32]
    capitals = byte[65:91].sum()
    letters = capitals + byte[97:123].sum()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    counts = Counter(found)
    return [
        float(np.log1p(n)),
        solid / n,
        byte[[35, 36, 37, 38, 42, 60, 62]].sum() / solid,
        capitals / max(letters, 1),
        byte[33] / solid,
        byte[48:58].sum() / solid,
        byte[[44, 46, 58, 59]].sum() / n,
        byte[124] / n,
        byte[128:].sum() / size,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, found, found[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        len(lines) / n,
    ]


@dataclass
class Model:
    """Bin edges, a table per feature and a table per chosen pair; a score adds one entry each."""

    edges: list[np.ndarray]
    start: float = 0.0
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(self.edges)], 1
        )

    def scores(self, rows: np.ndarray) -> np.ndarray:
        at = self.bins(rows)
        total = np.full(len(rows), self.start)
        for j, values in enumerate(self.mains):
            total += values[at[:, j]]
        for i, j, values in self.pairs:
            total += values[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(gradient: float, weight: float) -> float:
    return gradient / (weight + 1.0)


def _gain(gradient, weight):
    return gradient**2 / (weight + 1.0)


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow regression tree over ordered bins, as its value in each bin."""
    out = np.full(len(gradient), _leaf(gradient.sum(), weight.sum()))
    if depth and len(gradient) > 1:
        g, w = np.cumsum(gradient), np.cumsum(weight)
        left = _gain(g[:-1], w[:-1])
        cut = int(np.argmax(left + _gain(g[-1] - g[:-1], w[-1] - w[:-1]))) + 1
        out[:cut] = _tree(gradient[:cut], weight[:cut], depth - 1)
        out[cut:] = _tree(gradient[cut:], weight[cut:], depth - 1)
    return out


def _cross(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis over a grid of bins: its values and its gain."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    w = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    corner_g, corner_w = g[1:-1, 1:-1], w[1:-1, 1:-1]
    parts = [
        (corner_g, corner_w),
        (g[1:-1, -1:] - corner_g, w[1:-1, -1:] - corner_w),
        (g[-1:, 1:-1] - corner_g, w[-1:, 1:-1] - corner_w),
    ]
    rest = [(g[-1, -1] - sum(p[0] for p in parts), w[-1, -1] - sum(p[1] for p in parts))]
    total = sum(_gain(*p) for p in parts + rest)
    a, b = np.unravel_index(int(np.argmax(total)), total.shape)
    values = np.empty_like(gradient)
    for (pg, pw), rows, cols in zip(
        parts + rest,
        (slice(0, a + 1), slice(0, a + 1), slice(a + 1, None), slice(a + 1, None)),
        (slice(0, b + 1), slice(b + 1, None), slice(0, b + 1), slice(b + 1, None)),
        strict=True,
    ):
        values[rows, cols] = _leaf(pg[a, b], pw[a, b])
    return values, float(total[a, b] - _gain(g[-1, -1], w[-1, -1]))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    bins: int = BINS,
    rounds: int = ROUNDS,
    pairs: int = PAIRS,
    rate: float = 0.2,
) -> Model:
    """Cyclic boosting on the logistic loss.

    In each round every feature in turn gets a shallow tree fitted to the current gradient, which
    is added to its table. Then the pairs with the largest gain over what is left are boosted the
    same way on their grids. Without rows, or with one label only, all scores are the share of
    label 1, smoothed; without rows it is a half.
    """
    model = Model(
        [
            np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
            if len(rows)
            else np.zeros(0)
            for j in range(rows.shape[1])
        ]
    )
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model.start = float(np.log(share / (1 - share)))
    model.mains = [np.zeros(len(e) + 1) for e in model.edges]
    if len(rows) == 0 or labels.min() == labels.max():
        return model
    at = model.bins(rows)
    total = np.full(len(rows), model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j, values in enumerate(model.mains):
            g, w = slope()
            step = rate * _tree(
                np.bincount(at[:, j], g, len(values)), np.bincount(at[:, j], w, len(values))
            )
            values += step
            total += step[at[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.mains[i]), len(model.mains[j]))
        cell = at[:, i] * shape[1] + at[:, j]
        g, w = slope()
        size = shape[0] * shape[1]
        return np.bincount(cell, g, size).reshape(shape), np.bincount(cell, w, size).reshape(shape)

    usable = [j for j, values in enumerate(model.mains) if len(values) > 1]
    gains = {(i, j): _cross(*grid(i, j))[1] for i in usable for j in usable if i < j}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pairs = [
        (i, j, np.zeros((len(model.mains[i]), len(model.mains[j])))) for i, j in chosen
    ]
    for _ in range(rounds // 4):
        for i, j, values in model.pairs:
            step = rate * _cross(*grid(i, j))[0]
            values += step
            total += step[at[:, i], at[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows whose fold is not 0, chosen by a hash of the id.

    Null ids and null labels are left out; an id with several labels counts with its largest.
    The sampled labels are at most a few more than ``sample`` rows, so they are broadcast. Where
    ids have several rows, about ``sample`` of the rows are drawn by a hash of id and text, and
    repeated rows count once, so the driver never holds more than that.
    """
    usable = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(fold_of(FOLDS) != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    share = min(1.0, sample / max(usable.count(), 1))
    part = usable.filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    )

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    many = docs.select("doc_id").join(F.broadcast(part), "doc_id").count()
    row_share = min(1.0, sample / max(many, 1))
    rows = (
        docs.select("doc_id", utf8().alias("body"))
        .join(F.broadcast(part), "doc_id")
        .withColumn("draw", F.xxhash64(F.lit("row"), "doc_id", "body"))
        .filter(F.pmod("draw", F.lit(1_000_000)) < int(row_share * 1_000_000))
        .select("quality", "draw", F.arrow_udf(run, "array<double>")("body").alias("x"))
        .dropDuplicates(["quality", "draw"])
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows["quality"]])  # the same model whatever the order of rows
    return fit(x[order], (rows["quality"].to_numpy() > 0)[order].astype(float))


def score(model: Model, text: Column) -> Column:
    """Scores of texts given as bytes, a batch at a time."""

    def run(texts: pa.Array) -> pa.Array:
        found = [features(t) for t in texts.to_pylist()]
        return pa.array(model.scores(np.array(found, float).reshape(-1, len(FEATURES))))

    return F.arrow_udf(run, "double")(text)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row`` (the columns of ``docs``) and ``score``, from 0 to 1, higher for better texts.

    Null texts count as empty; empty texts get the score of all features at zero.
    """
    model = train(docs, labels, sample)
    return packed(docs).select("row", score(model, utf8("row.text")).alias("score"))


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    return scored(docs, labels, sample).filter(F.col("score") >= threshold).select("row.*")


ship(__name__)
