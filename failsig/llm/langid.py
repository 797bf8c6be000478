"""Operator 9: language identification by averaged hashed subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import frozen
from .common import fold_of, packed, ship, text_of

BUCKETS = 1 << 13
WIDTH = 16  # of an embedding
PER_LANG = 500  # training documents of each language, about; bounds what the driver holds
STEPS = 1000  # of gradient descent
BATCH = 16
FOLDS = 3  # documents of fold 1 are held out
UNKNOWN = "und"

_STEP = 1 << 18  # bytes of a text that are looked at together

# bytes that are no part of a word become spaces; bytes from 128 are letters of other scripts
_BLANK = bytes(
    c if c >= 128 or 97 <= c <= 122 else 97 + c - 65 if 65 <= c <= 90 else 32 for c in range(256)
)


def subwords(text: str) -> np.ndarray:
    """How often each bucket is hit by the byte 2-, 3- and 4-grams of one whole text.

    A gram may begin or end at a word's edge, shown as a space, and never spans two words.
    """
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(_BLANK)
    byte = np.frombuffer(raw, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(byte), _STEP):  # bounds what a very long text takes
        part = byte[at : at + _STEP + 3].astype(np.uint32)
        inner = part != 32
        key = part[: max(len(part) - 1, 0)] * np.uint32(257) + part[1:]
        whole = inner[:-1] | inner[1:]
        for n in (2, 3, 4):
            if n > 2:
                # all but the first and last byte of a gram lie within a word
                key = key[:-1] * np.uint32(2654435761) + part[n - 1 :]
                whole = inner[1 : len(part) - n + 2].copy()
                for k in range(2, n - 1):
                    whole &= inner[k : len(part) - n + 1 + k]
            end = min(_STEP, len(key)) if at + _STEP < len(byte) else len(key)
            mixed = (key[:end] ^ (key[:end] >> np.uint32(15))) * np.uint32(2246822519)
            mixed = (mixed >> np.uint32(19))[whole[:end]]  # 13 bits
            total += np.bincount(mixed, minlength=BUCKETS)
    return total


def has_letter(text: str) -> bool:
    return not text.isspace() and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, the embeddings already multiplied by the linear layer, and the calibration."""

    langs: list[str]
    table: np.ndarray  # buckets x langs
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / max(counts.sum(), 1)
        z = (mean @ self.table + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str]) -> Model:
    """Stochastic gradient descent on the cross-entropy; every fifth row calibrates.

    ``counts`` are (buckets, hits) of each row. The temperature minimises the calibration rows'
    cross-entropy; the rejection level is the lowest at which those accepted are 99 % right.
    """
    rng = np.random.default_rng(9)
    n = len(langs)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    head = rng.normal(0, 0.1, (WIDTH, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)

    def dense(rows) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            out[k, counts[r][0]] = counts[r][1] / max(counts[r][1].sum(), 1)
        return out

    rows = rng.permutation(len(labels))
    check, learn = rows[::5], np.delete(rows, slice(None, None, 5))
    if n > 1 and len(learn):
        at = 0
        for turn in range(STEPS):
            if at == 0:
                rng.shuffle(learn)
            batch = learn[at : at + BATCH]
            at = at + BATCH if at + BATCH < len(learn) else 0
            rate = 1 - turn / STEPS
            x = dense(batch)
            mean = x @ table
            slope = _softmax(mean @ head + bias)
            slope[np.arange(len(batch)), labels[batch]] -= 1
            slope /= len(batch)
            back = slope @ head.T
            head -= rate * (mean.T @ slope)
            bias -= 0.2 * rate * slope.sum(0)
            table -= 20 * rate * (x.T @ back)
    model = Model(langs, (table @ head).astype(np.float64), bias.astype(np.float64))
    if n > 1 and len(check):
        z = np.concatenate([dense(check[a : a + 64]) for a in range(0, len(check), 64)])
        z = z @ model.table + model.bias
        truth = labels[check]
        heats = np.geomspace(0.05, 5, 40)
        loss = [
            -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heats
        ]
        model.temperature = float(heats[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        top, right = p.max(1), p.argmax(1) == truth
        for level in np.linspace(0, 0.99, 100):
            kept = top >= level
            if not kept.any() or right[kept].mean() >= 0.99:
                model.reject_below = float(level)
                break
    return model


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fit on about ``per_lang`` documents of each language, chosen by a hash of id and text.

    Only text and non-null lang of documents outside fold 1 are read. Rows that share an id, or
    have none, are drawn one by one, and repeated rows count once, so the driver never holds more
    than the sample.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (fold_of(FOLDS) != 1)).select(
        F.col("lang").cast("string").alias("lang"),
        "text",
        F.xxhash64("doc_id", text_of()).alias("draw"),
    )
    shares = frozen(  # its size is known from then on, so the texts need no shuffle
        usable.groupBy("lang")
        .count()
        .select(F.col("lang").alias("of"), (per_lang / F.col("count") * 1_000_000).alias("share"))
    )

    def run(texts: pa.Array) -> pa.Array:
        keys, hits = [], []
        for t in texts.to_pylist():
            c = subwords(t)
            k = np.flatnonzero(c)
            keys.append(k.astype("<u2").tobytes())
            hits.append(c[k].astype("<u4").tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(hits, pa.binary())], ["keys", "hits"]
        )

    rows = (
        usable.join(shares, F.col("lang") == F.col("of"))
        .filter(F.pmod("draw", F.lit(1_000_000)) < F.col("share"))
        .select("lang", "draw", F.arrow_udf(run, "keys binary, hits binary")(text_of()).alias("c"))
        .select("lang", "draw", "c.keys", "c.hits")
        .dropDuplicates(["lang", "draw"])
        .drop("draw")
        .toPandas()
        .sort_values(["lang", "keys", "hits"])
    )
    langs = sorted(set(rows["lang"]))
    counts = [
        (np.frombuffer(k, "<u2").astype(np.int64), np.frombuffer(h, "<u4").astype(np.float32))
        for k, h in zip(rows["keys"], rows["hits"], strict=True)
    ]
    labels = np.array([langs.index(x) for x in rows["lang"]], np.int64)
    return fit(counts, labels, langs)


def predict(model: Model, text: Column) -> Column:
    """A struct of ``lang``, ``score`` (its calibrated probability) and ``rejected``."""

    def run(texts: pa.Array) -> pa.Array:
        langs, scores, out = [], [], []
        for t in texts.to_pylist():
            if not model.langs or not has_letter(t):
                langs.append(UNKNOWN)
                scores.append(0.0)
                out.append(True)
                continue
            p = model.probabilities(subwords(t))
            best = int(p.argmax())
            langs.append(model.langs[best])
            scores.append(float(p[best]))
            out.append(bool(p[best] < model.reject_below))
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores), pa.array(out)],
            ["lang", "score", "rejected"],
        )

    return F.arrow_udf(run, "lang string, score double, rejected boolean")(text)


def identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``row`` and ``found`` (lang, score, rejected) of each row of ``docs``.

    A null text, one without a letter, and any text if nothing could be learned is "und" with
    score 0. ``rejected`` marks predictions below the calibrated level; they keep their language.
    """
    model = train(docs, per_lang)
    return packed(docs).select("row", predict(model, text_of("row.text")).alias("found"))


ship(__name__)
