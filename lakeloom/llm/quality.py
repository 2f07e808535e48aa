"""Quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of a document are covered by overlapping chunks. Learned filters over a few bytes
run along each chunk, their responses are rectified and max-pooled to one number per filter and
chunk, and the document's maximum, mean and minimum of these over its chunks are combined into one
probability. Fitted in numpy on a bounded sample of labelled rows, the gradient passing through the
pooled positions; every document is then scored over its whole text in one pass without a shuffle.

Null text counts as empty; an empty text is one chunk of padding and has a score as well. Rows that
repeat give repeated rows, a null doc_id is kept and counts as held out, other columns are not read.
Without labelled rows of both kinds every document gets the score of the prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, slim
from .labels import MAX_EXAMPLES, examples, held_out

#: Bytes a filter sees (an even number), filters, bytes of a chunk, and from one chunk to the next.
WIDTH, FILTERS, CHUNK, STEP = 6, 16, 160, 128
#: Chunks whose responses are held at once.
GROUP = 192


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS: what a byte adds at each place of a filter
    offset: np.ndarray  # FILTERS
    combine: np.ndarray  # 3 x FILTERS
    bias: float

    def pairs(self) -> list[np.ndarray]:
        """What two bytes in a row add, which halves the look-ups."""
        return [
            (self.filters[j][None, :, :] + self.filters[j + 1][:, None, :]).reshape(65536, FILTERS)
            for j in range(0, WIDTH, 2)
        ]


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, one per row and padded with zeros, and the first chunk of each text."""
    counts = [max(1, math.ceil((len(t) - (CHUNK - STEP)) / STEP)) for t in texts]
    firsts = np.cumsum([0, *counts])
    out = np.zeros((int(firsts[-1]), CHUNK), np.uint8)
    for t, first, n in zip(texts, firsts.tolist(), counts, strict=False):
        raw = np.frombuffer(t, np.uint8)
        for k in range(n):
            part = raw[k * STEP : k * STEP + CHUNK]
            out[first + k, : len(part)] = part
    return out, firsts[:-1]


def responses(bytes_: np.ndarray, pairs: list[np.ndarray], offset: np.ndarray, where: bool = False):
    """The pooled response of each chunk and filter, and with `where` the position it comes from."""
    n = CHUNK - WIDTH + 1
    pooled = np.empty((len(bytes_), FILTERS), np.float32)
    at = np.empty((len(bytes_), FILTERS), np.int64) if where else None
    for low in range(0, len(bytes_), GROUP):
        part = bytes_[low : low + GROUP].astype(np.intp)
        pair = part[:, :-1] + 256 * part[:, 1:]
        total = np.take(pairs[0], pair[:, :n], axis=0)
        for k in range(1, len(pairs)):
            total += np.take(pairs[k], pair[:, 2 * k : 2 * k + n], axis=0)
        if where:
            at[low : low + GROUP] = total.argmax(axis=1)
        pooled[low : low + GROUP] = total.max(axis=1)
    pooled += offset
    np.maximum(pooled, 0, out=pooled)
    return (pooled, at) if where else pooled


def summary(pooled: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Maximum, mean and minimum over the chunks of each document: documents x 3 x FILTERS."""
    counts = np.diff([*firsts, len(pooled)])[:, None]
    parts = (
        np.maximum.reduceat(pooled, firsts),
        np.add.reduceat(pooled, firsts, dtype=np.float64) / counts,
        np.minimum.reduceat(pooled, firsts),
    )
    return np.stack(parts, axis=1)


def probabilities(texts: list[bytes], net: Network, pairs: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    bytes_, firsts = chunked(texts)
    z = (summary(responses(bytes_, pairs, net.offset), firsts) * net.combine).sum(axis=(1, 2)) + net.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the log-likelihood, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (3, FILTERS)),
        0.0,
    )
    label = np.array([y for _, y in rows], float)
    good = label.sum()
    if not 0 < good < len(rows):
        prior = (good + 0.5) / (len(rows) + 1.0)
        net.combine[:] = 0
        net.bias = math.log(prior / (1 - prior))
        return net
    weight = np.where(label > 0, 0.5 / good, 0.5 / (len(rows) - good)) * len(rows)
    texts = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    state = [np.zeros(x.shape) for x in (net.filters, net.offset, net.combine, np.zeros(1)) for _ in (0, 1)]
    epochs = math.ceil(steps / math.ceil(len(rows) / batch))
    steps = epochs * math.ceil(len(rows) / batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), batch):
            step += 1
            chosen = order[low : low + batch]
            bytes_, firsts = chunked([texts[i] for i in chosen])
            pooled, at = responses(bytes_, net.pairs(), net.offset, where=True)
            parts = summary(pooled, firsts)
            z = np.clip((parts * net.combine).sum(axis=(1, 2)) + net.bias, -30, 30)
            slope = (1 / (1 + np.exp(-z)) - label[chosen]) * weight[chosen] / len(chosen)
            counts = np.diff([*firsts, len(pooled)])
            to_part = slope[:, None, None] * net.combine
            d = np.repeat(np.arange(len(chosen)), counts)
            top = pooled == parts[d, 0]
            least = pooled == parts[d, 2]
            tops, leasts = np.add.reduceat(top, firsts, dtype=float)[d], np.add.reduceat(least, firsts, dtype=float)[d]
            to_pooled = to_part[d, 0] * top / tops + to_part[d, 1] / counts[d][:, None] + to_part[d, 2] * least / leasts
            to_pooled *= pooled > 0
            to_filters = np.zeros(WIDTH * 256 * FILTERS)
            chunk, f = np.nonzero(to_pooled)
            for j in range(WIDTH):
                byte = bytes_[chunk, at[chunk, f] + j].astype(np.int64)
                to_filters += np.bincount((j * 256 + byte) * FILTERS + f, to_pooled[chunk, f], len(to_filters))
            gradients = (
                to_filters.reshape(net.filters.shape),
                to_pooled.sum(axis=0),
                (slope[:, None, None] * parts).sum(axis=0) + 1e-4 * net.combine,
                np.array([slope.sum()]),
            )
            moves = []
            for k, g in enumerate(gradients):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
                first, second = state[2 * k] / (1 - 0.9**step), state[2 * k + 1] / (1 - 0.99**step)
                moves.append(rate * (1 - step / (steps + 1)) * first / (np.sqrt(second) + 1e-8))
            net.filters -= moves[0].astype(np.float32)
            net.offset -= moves[1].astype(np.float32)
            net.combine -= moves[2]
            net.bias -= float(moves[3][0])
    # The labels weighed the same; the prior of the sample goes back into the score.
    net.bias += math.log(good / (len(rows) - good))
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for part in slices(batches, 64):
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column(0), "score": pa.array(probabilities(texts, net, pairs), pa.float64())}
            )

    return slim(docs, id_col, text_col).mapInArrow(rate, "doc_id long, score double")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 4,
    value: int = 2,
    threshold: float = 0.7,
    limit: int = MAX_EXAMPLES // 2,
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    net = fit(examples(docs, labels, "quality", modulus, value, limit))
    return score(docs, net).select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, value).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
