"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of 8 bytes run over the whole text at a hop of 4; their responses are max-pooled over chunks
of 256 bytes that overlap by half; a dense layer reads each chunk's pooled responses, and its units, as their maximum and
mean over all chunks of the document, combine into one probability. Every byte of a text is read; a document is scored in
memory proportional to its own length.

The network is fitted on the driver on at most SAMPLE labelled documents of each class, whole texts of any length and
SAMPLE_BYTES together at most, none from the held-out fold; its output is set to the class shares of all labelled rows. Its weights, some 20 KB,
travel in the task's closure.

Cases: null and empty texts are scored as a text without bytes; without labelled rows of both classes every score is the
share of class 1 (or 0.5 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm.common import byte_texts, documents, small_batches, steps, trimmed
from timbrel.llm.labelled import held_out, sample

SAMPLE = 2000
#: Bytes of the sample's texts of one class together; the sample ends where they are used up.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3

HOP, HALF = 4, 128
EMBED, FILTERS, HIDDEN = 4, 32, 16
_SPOTS = HALF // HOP


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(256, EMBED, scale=1.0),
        "near": draw(HOP * EMBED, FILTERS, scale=0.25),
        "far": draw(HOP * EMBED, FILTERS, scale=0.25),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": draw(FILTERS, HIDDEN, scale=0.25),
        "offset": np.zeros(HIDDEN, np.float32),
        "out": draw(2 * HIDDEN, scale=0.2),
        "level": np.zeros(1, np.float32),
    }


def _lay(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole halves of a chunk, two at least, zeros behind; and the offsets of the texts' halves."""
    halves = np.maximum(2, -(-np.diff(ends) // HALF))
    at = np.zeros(len(ends), np.int64)
    np.cumsum(halves, out=at[1:])
    out = np.zeros(int(at[-1]) * HALF, np.uint8)
    for a, b, to in zip(ends[:-1].tolist(), ends[1:].tolist(), (at[:-1] * HALF).tolist(), strict=True):
        out[to : to + b - a] = data[a:b]
    return out, at


def _forward(w: dict[str, np.ndarray], data: np.ndarray, ends: np.ndarray, keep: bool = False):
    laid, at = _lay(data, ends)
    x = w["embed"][laid].reshape(-1, HOP * EMBED)
    response = x @ w["near"]
    after = x @ w["far"]
    last = at[1:] * _SPOTS - 1
    response[:-1] += after[1:]
    response[last] -= after[np.minimum(last + 1, len(after) - 1)] * (last < len(after) - 1)[:, None]
    grid = response.reshape(-1, _SPOTS, FILTERS)
    half = grid.max(axis=1)
    joint = np.ones(len(half), bool)  # a chunk is a half and the next one of the same text
    joint[at[1:] - 1] = False
    left = np.flatnonzero(joint)
    pooled = np.maximum(half[left], half[left + 1])
    active = np.maximum(pooled + w["bias"], 0)
    unit = np.maximum(active @ w["dense"] + w["offset"], 0)
    first = at[:-1] - np.arange(len(at) - 1)
    count = np.diff(at) - 1
    top = np.maximum.reduceat(unit, first, axis=0)
    mean = np.add.reduceat(unit, first, axis=0) / count[:, None].astype(np.float32)
    both = np.concatenate([top, mean], axis=1)
    logit = both @ w["out"] + w["level"]
    return (logit, (x, grid, half, left, pooled, active, unit, first, count, top, both, last, laid)) if keep else logit


def _backward(w: dict[str, np.ndarray], state, slope: np.ndarray) -> dict[str, np.ndarray]:
    x, grid, half, left, pooled, active, unit, first, count, top, both, last, laid = state
    g = {"level": slope.sum(keepdims=True), "out": both.T @ slope}
    into = slope[:, None] * w["out"]
    doc = np.repeat(np.arange(len(count)), count)
    peak = unit == top[doc]
    ties = np.add.reduceat(peak.astype(np.float32), first, axis=0)
    d_unit = peak * (into[:, :HIDDEN] / ties)[doc] + (into[:, HIDDEN:] / count[:, None])[doc]
    d_unit *= unit > 0
    g["dense"], g["offset"] = active.T @ d_unit, d_unit.sum(axis=0)
    d_pool = (d_unit @ w["dense"].T) * (active > 0)
    g["bias"] = d_pool.sum(axis=0)
    d_half = np.zeros_like(half)
    from_left = half[left] >= half[left + 1]
    d_half[left] += d_pool * from_left
    d_half[left + 1] += d_pool * ~from_left
    d_grid = np.zeros_like(grid)
    np.put_along_axis(d_grid, grid.argmax(axis=1)[:, None, :], d_half[:, None, :], axis=1)
    d = d_grid.reshape(-1, FILTERS)
    after = np.zeros_like(d)
    after[1:] = d[:-1]
    after[np.minimum(last + 1, len(d) - 1)] *= (last >= len(d) - 1)[:, None]
    g["near"], g["far"] = x.T @ d, x.T @ after
    d_x = (d @ w["near"].T + after @ w["far"].T).reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(laid, d_x[:, i], 256) for i in range(EMBED)], axis=1)
    return g


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def _crop(text: bytes, label: int, rng: np.random.Generator) -> bytes:
    """One in ten clean texts is cut to a short piece: shortness alone is no fault."""
    if label == 0 or len(text) < 200 or rng.random() > 0.1:
        return text
    at = int(rng.integers(len(text) - 120))
    return text[at : at + int(rng.integers(12, 120))]


def fit(rows: list[tuple[bytes, int]], share: float, epochs: int = 8, seed: int = 11) -> dict[str, np.ndarray] | float:
    """Weights from labelled texts; a constant if one class is missing."""
    y = np.array([label for _, label in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return share if len(y) else 0.5
    w = _start(seed)
    first, second = ({k: np.zeros(v.shape, np.float32) for k, v in w.items()} for _ in range(2))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    even = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng, t, size = np.random.default_rng(seed), 0, 32
    epochs = max(epochs, -(-1200 * size // len(rows)))
    total = epochs * -(-len(rows) // size)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        cost = weight if epoch >= epochs * 3 // 4 else even
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            logit, state = _forward(w, *_join([_crop(*rows[i], rng) for i in pick]), keep=True)
            slope = (1 / (1 + np.exp(-logit)) - y[pick]) * cost[pick] / len(pick)
            t += 1
            rate = 0.004 * (1 - t / (total + 1))
            for k, d in _backward(w, state, slope.astype(np.float32)).items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                w[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return w


def _values(w: dict[str, np.ndarray] | float, part: pa.RecordBatch) -> np.ndarray:
    if isinstance(w, float) or not part.num_rows:
        return np.full(part.num_rows, w if isinstance(w, float) else 0.0)
    return 1 / (1 + np.exp(-_forward(w, *byte_texts(part.column("text"))).astype(np.float64)))


def _score(w: dict[str, np.ndarray] | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1 << 19):
                yield pa.record_batch([part.column("doc_id"), pa.array(_values(w, part))], names=["doc_id", "score"])

    return trimmed(run)


def scored(docs: DataFrame, weights: dict[str, np.ndarray] | float) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(weights), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, fitted on ``labels`` (doc_id, quality)."""
    rows, share = sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)
    out = scored(docs, fit(rows, share))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(w: dict[str, np.ndarray] | float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1 << 19):
                yield part.filter(pa.array(_values(w, part) >= threshold))

    return trimmed(run)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(fit(*sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)), threshold), docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
