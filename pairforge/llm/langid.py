"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes. Filters of several widths run over each window, the
maximum over its positions is kept per filter, and a softmax layer gives a distribution; a text's
distribution is the mean of its windows', weighted by their bytes. A filter over one-hot bytes is a
table look-up per position, which is how both training and prediction compute it.

At most ``sample`` labelled documents, WINDOWS_EACH windows of each, are fitted (a documented bound);
all windows of every text are predicted. Null texts and texts without a letter give ``und`` and 0,
and so does everything if nothing is labelled; ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, sampled, slices, texts_of

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE = 3000
WINDOWS_EACH = 3
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as rows, the text of each, and its bytes. A-Z is lower-cased."""
    parts = [-(-len(t) // WINDOW) for t in texts]
    joined = b"".join(t.lower().ljust(n * WINDOW, b"\0") for t, n in zip(texts, parts, strict=True))
    owner = np.repeat(np.arange(len(texts)), parts)
    last = np.cumsum(parts)
    sizes = np.full(len(owner), WINDOW)
    full = np.array(parts) > 0
    sizes[last[full] - 1] = [(len(t) - 1) % WINDOW + 1 for t in texts if t]
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), owner, sizes


def _pooled(tables: list[np.ndarray], x: np.ndarray, places: bool = False):
    """Max over positions of each filter, and where it was."""
    tops, at = [], []
    for table in tables:
        width = len(table)
        span = WINDOW - width + 1
        total = np.take(table[0], x[:, :span], axis=0)
        for k in range(1, width):
            total += np.take(table[k], x[:, k : k + span], axis=0)
        if places:
            at.append(total.argmax(1))
        tops.append(total.max(1))
    return np.concatenate(tops, 1), at


def _soft(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 6, seed: int = 3) -> dict:
    """Cross-entropy by Adam, back through the maxima. ``x``: windows, ``y``: class numbers."""
    draw = np.random.default_rng(seed)
    tables = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights = [*tables, np.zeros((FILTERS * len(WIDTHS), classes), np.float32), np.zeros(classes, np.float32)]
    weights[-2] += draw.normal(0, 0.2, weights[-2].shape).astype(np.float32)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for begin in range(0, len(order), 64):
            rows = order[begin : begin + 64]
            xb, yb, step = x[rows], y[rows], step + 1
            raw, at = _pooled(weights[: len(WIDTHS)], xb, True)
            pooled = np.maximum(raw, 0)
            off = _soft(pooled @ weights[-2] + weights[-1])
            off[np.arange(len(rows)), yb] -= 1
            off /= len(rows)
            gradient = [np.zeros_like(w) for w in weights[: len(WIDTHS)]] + [pooled.T @ off, off.sum(0)]
            back = (off @ weights[-2].T) * (raw > 0)
            for i, width in enumerate(WIDTHS):
                slope = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    bytes_there = np.take_along_axis(xb, at[i] + k, 1)
                    np.add.at(gradient[i][k], (bytes_there, np.arange(FILTERS)), slope)
            for i, g in enumerate(gradient):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                weights[i] = (weights[i] - 0.02 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return {"tables": weights[: len(WIDTHS)], "w": weights[-2], "b": weights[-1]}


def distributions(model: dict, texts: list[bytes]) -> np.ndarray:
    """A distribution over the model's languages per text; zeros for empty texts."""
    out = np.zeros((len(texts), len(model["b"])))
    for a, b in slices(texts, 4_000_000):
        x, owner, sizes = windows(texts[a:b])
        for at in range(0, len(x), 512):
            pooled, _ = _pooled(model["tables"], x[at : at + 512])
            soft = _soft(np.maximum(pooled, 0) @ model["w"] + model["b"])
            np.add.at(out, a + owner[at : at + 512], soft * sizes[at : at + 512, None])
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Train on rows (id, text, lang); rows without text, language or key are passed over."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def work(batch):
        texts, langs = texts_of(batch), batch.column("lang").to_pylist()
        for text, lang in zip(texts, langs, strict=True):
            every = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]
            picked = every[:: max(1, len(every) // WINDOWS_EACH)][:WINDOWS_EACH]
            yield {"x": pa.array(picked, pa.binary()), "lang": pa.array([lang] * len(picked), pa.string())}

    got = arrow_map(sampled(usable, sample).select("text", "lang"), work, "x binary, lang string").toArrow()
    if not got.num_rows:
        return {"langs": []}
    langs = sorted(set(got.column("lang").to_pylist()))
    texts = got.column("x").to_pylist()
    order = sorted(range(len(texts)), key=texts.__getitem__)  # the same model whatever order the tasks end in
    x, owner, _ = windows([texts[i] for i in order])
    y = np.array([langs.index(got.column("lang")[i].as_py()) for i in order])[owner]
    return {"langs": langs} | train(x, y, len(langs))


def predicted(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """Add lang_pred and score to rows with ``text``; columns named in ``keep`` go along."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        texts, known = texts_of(batch), held.value
        lettered = np.array(batch.column("lettered").to_pylist(), bool)
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known["langs"]:
            found = distributions(known, texts)
            best = found.argmax(1)
            scores = np.where(lettered, found[np.arange(len(texts)), best], 0.0)
            langs = [known["langs"][k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
        yield {k: batch.column(k) for k in keep} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["lang_pred string", "score double"])
    lettered = F.col("text").rlike(r"\p{L}").alias("lettered")
    return arrow_map(docs.select(lettered, *dict.fromkeys(["text", *keep])), work, schema)


def languages(docs: DataFrame, trainable: Column, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, lang_pred, score) of every row, learned from the rows where ``trainable`` (by ``id``)."""
    own = docs.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    return predicted(own, fit(own.where(trainable), sample), "id").withColumnRenamed("id", key)
