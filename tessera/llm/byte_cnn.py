"""Document quality from bytes, by a small convolutional network in numpy.

Every byte is a class of its own, beside padding.  ``FILTERS`` learned filters
of ``WIDTH`` bytes slide over every byte of a document, in chunks of ``CHUNK`` positions whose
receptive fields overlap; each chunk is max-pooled, the chunk maxima are
combined by mean and by maximum over the whole document, and a logistic layer
gives one probability.  Nothing but the bytes of the text enters a score.

Learning: at most ``SAMPLE`` labelled rows of at most ``SAMPLE_BYTES`` bytes
each, chosen by a hash of their id among those whose crc32(id) modulo
``FOLDS`` is not 0, are fitted on the driver by Adam from a fixed seed.

Defined cases: null and empty texts score as a document of padding alone; rows
without a label, or with a null one, teach nothing; several labels of an id
count as their mean, rounded; with no labelled rows, or one class alone, the
score is the smoothed base rate; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import text_buffers
from tessera.llm.keyed import ID, TEXT, keyed

FILTERS, WIDTH, CHUNK = 24, 6, 256
SAMPLE, SAMPLE_BYTES = 3072, 32 << 10
FOLDS, EPOCHS, BATCH, RATE, SEED = 5, 4, 24, 0.01, 7
THRESHOLD = 0.3
#: The bytes, after 0 for padding.
CLASSES = 257


@dataclass
class Model:
    table: np.ndarray  # WIDTH x CLASSES x FILTERS
    bias: np.ndarray  # of the filters
    weight: np.ndarray  # of the mean and the maximum of chunk maxima
    intercept: np.ndarray


def _chunks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of each chunk's bytes with its overlap, first chunk of each document)."""
    count = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(count)]
    flat = np.zeros(int(first[-1]) * CHUNK + WIDTH - 1, np.uint16)
    ends = np.zeros((int(first[-1]), WIDTH - 1), np.uint16)
    for t, a in zip(texts, first, strict=False):
        flat[a * CHUNK : a * CHUNK + len(t)] = t
        flat[a * CHUNK : a * CHUNK + len(t)] += 1
    body = flat[: int(first[-1]) * CHUNK].reshape(-1, CHUNK)
    ends[:-1] = body[1:, : WIDTH - 1]
    ends[first[1:] - 1] = 0  # the last chunk of a document overlaps padding, not the next document
    return np.concatenate([body, ends], 1), first


def _pairs(model: Model) -> list[np.ndarray]:
    """Tables over two neighbouring bytes at once, for fewer look-ups."""
    return [(model.table[k][:, None] + model.table[k + 1][None, :]).reshape(CLASSES * CLASSES, -1) for k in range(0, WIDTH, 2)]


def _activate(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Filter responses, chunk x position x filter."""
    pair = codes[:, :-1].astype(np.int32) * CLASSES + codes[:, 1:]
    out = tables[0][pair[:, :CHUNK]]
    for k, table in enumerate(tables[1:], 1):
        out += table[pair[:, 2 * k : 2 * k + CHUNK]]
    return out


def _pool(maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(maxima, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(maxima, first[:-1], axis=0)], 1)


def predict(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Probability of each document, in steps of bounded memory."""
    tables = _pairs(model)
    out = []
    done = 0
    while done < len(texts):
        size, stop = 0, done
        while stop < len(texts) and (stop == done or size + len(texts[stop]) < 1 << 18):
            size += len(texts[stop]) + CHUNK
            stop += 1
        codes, first = _chunks(texts[done:stop])
        maxima = np.concatenate([_activate(codes[i : i + 64], tables).max(1) for i in range(0, len(codes), 64)])
        feature = _pool(np.maximum(maxima + model.bias, 0), first)
        out.append(1 / (1 + np.exp(-(feature @ model.weight + model.intercept))))
        done = stop
    return np.concatenate(out) if out else np.zeros(0)


def gradient(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, in the order of the model's fields; that of a maximum flows to its place."""
    codes, first = _chunks(texts)
    tables = _pairs(model)
    at = np.empty((len(codes), FILTERS), np.int64)
    raw = np.empty((len(codes), FILTERS), model.table.dtype)
    for j in range(0, len(codes), 64):
        act = _activate(codes[j : j + 64], tables)
        at[j : j + 64] = act.argmax(1)
        raw[j : j + 64] = np.take_along_axis(act, at[j : j + 64, None], 1)[:, 0]
    raw += model.bias
    maxima = np.maximum(raw, 0)
    feature = _pool(maxima, first)
    p = 1 / (1 + np.exp(-(feature @ model.weight + model.intercept)))
    slope = (p - labels) / len(labels)
    size = np.diff(first)
    back = slope[:, None] * model.weight
    owner = np.repeat(np.arange(len(labels)), size)
    d_max = back[owner, :FILTERS] / size[owner, None]
    d_max += back[owner, FILTERS:] * (maxima == feature[owner, FILTERS:])
    d_max *= raw > 0
    d_table = np.zeros(model.table.shape)
    rows = np.arange(len(codes))[:, None]
    for k in range(WIDTH):
        np.add.at(d_table[k], (codes[rows, at + k], np.arange(FILTERS)[None, :]), d_max)
    return [d_table, d_max.sum(0), feature.T @ slope, np.array(slope.sum())]


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the log loss with a little decay of the last layer."""
    rng = np.random.default_rng(seed)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(rng.normal(0, 0.3, (WIDTH, CLASSES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), np.array(np.log(rate / (1 - rate))))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    model.weight = rng.normal(0, 0.05, 2 * FILTERS)
    values = [model.table, model.bias, model.weight, model.intercept]
    first_moment, second_moment = ([np.zeros(v.shape) for v in values] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            grads = gradient(model, [texts[k] for k in some], labels[some])
            grads[2] = grads[2] + 1e-4 * model.weight
            step += 1
            speed = RATE * (1 - epoch / epochs)
            for v, g, m, s in zip(values, grads, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(v.dtype)
    return model


def remainder(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the bounded sample described above."""
    known = labels.select(F.col(doc_id).cast("long").alias(ID), F.col(label).cast("double").alias("y")).dropna()
    chosen = known.filter(remainder(ID) != 0).groupBy(ID).agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64(F.lit(SEED), ID), ID).limit(sample)
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), f"{ID} long, y double"))  # SAMPLE rows at most
    rows = keyed(docs, doc_id, text).join(ids, ID).filter(F.octet_length(TEXT) <= SAMPLE_BYTES).select(ID, TEXT, "y").orderBy(F.xxhash64(F.lit(SEED), ID), ID, TEXT).limit(sample).collect()
    return fit([np.frombuffer(r[1].encode(), np.uint8) for r in rows], np.array([r[2] for r in rows], float))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            score = predict(model, [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], [ID, "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = keyed(docs, doc_id, text).select(ID, TEXT).mapInArrow(_score(shared), f"{ID} long, score double")
    return rows.select(F.col(ID).alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).select("doc_id", (F.coalesce(remainder("doc_id"), F.lit(-1)) == 0).alias("held_out"), "score", "predicted")
