"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on text statistics by the
non-negative unbiased risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``:
where the second part turns negative, the step goes the other way, as the estimator asks. The class
prior is estimated as the share of positives among the labelled training rows.

At most ``sample`` positives and ``sample`` unlabelled rows are fitted (a documented bound); every
row is scored on its whole text. Null and empty texts get the score of the empty text; without
positives or unlabelled rows each score is the prior (0 without labels); repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, sampled, slices, texts_of

SAMPLE = 8000

_KINDS = np.full(256, 10, np.int64)  # every other sign
for _kind, _bytes in enumerate(
    [range(97, 123), range(65, 91), range(48, 58), b" \t", b"\r\n", b".", b",", b"!", b"|", b";:?'\"()-"]
):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:192], _KINDS[192:], _KINDS[:9] = 11, 12, 13
_N = 14


def _statistics(text: bytes) -> np.ndarray:
    """Shares of pairs of byte kinds, and how often words and lines repeat."""
    out = np.zeros(_N * _N + 8, np.float32)
    words = text.lower().split()
    if not words:
        return out
    kinds = _KINDS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 1:
        out[: _N * _N] = np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N) / (len(kinds) - 1)
    lines = text.split(b"\n")
    runs = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[_N * _N :] = [
        1,
        np.log(len(words)) / 5,
        len(set(words)) / len(words),
        runs / len(words),
        pairs / max(1, len(words) - 1),
        len(set(lines)) / len(lines),
        min(30, len(text) / len(words)) / 10,
        sum(w.isalpha() for w in words) / len(words),
    ]
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    return np.stack([_statistics(t) for t in texts])


def _forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
    return hidden, hidden @ model["w2"] + model["b2"]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 1500, seed: int = 7) -> dict:
    """Minimise the non-negative risk with the logistic loss by Adam."""
    draw = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    size = both.shape[1]
    model = {
        "mean": both.mean(0), "scale": np.maximum(both.std(0), 1e-3),
        "w1": draw.normal(0, size**-0.5, (size, hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32),
        "w2": draw.normal(0, hidden**-0.5, hidden).astype(np.float32), "b2": np.float32(0),
    }
    names = ["w1", "b1", "w2", "b2"]
    first, second = ({n: np.zeros_like(model[n]) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        p = positive[draw.integers(0, len(positive), 256)]
        u = unlabelled[draw.integers(0, len(unlabelled), 256)]
        x = np.concatenate([p, u])
        h, z = _forward(model, x)
        zp, zu = z[:256], z[256:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope_plus, slope_minus = prior * (_sigmoid(zp) - 1) / 256, prior * _sigmoid(zp) / 256
        slope_u = _sigmoid(zu) / 256
        if negative >= 0:
            slope = np.concatenate([slope_plus - slope_minus, slope_u])
        else:  # the estimate went below zero: step back out of it
            slope = np.concatenate([slope_minus, -slope_u])
        slope = slope.astype(np.float32)
        scaled = (x - model["mean"]) / model["scale"]
        back = np.outer(slope, model["w2"]) * (h > 0)
        gradient = {"w2": h.T @ slope, "b2": slope.sum(), "w1": scaled.T @ back + 1e-4 * model["w1"], "b1": back.sum(0)}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * gradient[n]
            second[n] = 0.999 * second[n] + 0.001 * gradient[n] ** 2
            ahead = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            model[n] = (model[n] - 0.005 * ahead).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, sample: int = SAMPLE, label: str = "quality") -> dict:
    """Train on rows of ``docs`` (id, text) where ``trainable``; only the label 1 is ever trusted.

    ``labels`` has doc_id and ``label``; a document with several labels counts as 1 only if all are 1.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("y")).where(trainable)
    )
    prior = known.agg(F.avg("y")).first()[0]
    if prior is None:
        return {"prior": 0.0}

    def gathered(rows: DataFrame) -> np.ndarray:
        def work(batch):
            found = statistics(texts_of(batch))
            yield {"x": pa.array(list(found), pa.list_(pa.float32()))}

        got = arrow_map(rows.select("text"), work, "x array<float>").toArrow().column("x")
        return np.array(got.to_pylist(), np.float32)

    usable = docs.where(trainable & F.col("id").isNotNull())
    trusted = sampled(known.where("y = 1").select("id"), sample)
    positive = gathered(usable.join(F.broadcast(trusted), "id", "left_semi"))
    unlabelled = gathered(sampled(usable, sample))
    if not len(positive) or not len(unlabelled):
        return {"prior": float(prior)}
    return {"prior": float(prior)} | train(positive, unlabelled, float(prior))


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """Add ``score`` to rows with ``text``; columns named in ``keep`` go along."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        texts, known = texts_of(batch), held.value
        scores = np.full(len(texts), known["prior"], np.float64)
        if "w1" in known:
            for a, b in slices(texts):
                scores[a:b] = _sigmoid(_forward(known, statistics(texts[a:b]))[1])
        yield {k: batch.column(k) for k in keep} | {"score": pa.array(scores, pa.float64())}

    kinds = dict(docs.dtypes)
    return arrow_map(docs.select(*dict.fromkeys(["text", *keep])), work, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["score double"]))


def scored(docs: DataFrame, labels: DataFrame, trainable: Column, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, score) for every row, the model fitted on the trainable rows of ``docs`` (by ``id``)."""
    own = keyed(docs, key)
    return score(own, fit(own, labels, trainable, sample), "id").withColumnRenamed("id", key)


def keep_good(docs: DataFrame, labels: DataFrame, trainable: Column, least: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows whose score is at least ``least``, with their own columns."""
    model = fit(keyed(docs), labels, trainable, sample)
    packed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    return score(packed, model, "row").where(F.col("score") >= least).select("row.*")
