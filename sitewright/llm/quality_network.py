"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, keyed_rank, text_column_udf

CHUNK, OVERLAP, WIDTH, EMBEDDED, FILTERS = 1024, 64, 6, 6, 16
#: A byte position is marked as repetitive if its four bytes were seen at one of these distances before it.
LAGS = range(3, 17)
PLANES = EMBEDDED + 1
#: Training texts longer than this are cut to evenly spaced windows of it (learning only; scores use whole texts).
LEARN_BYTES = 16_384


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # WIDTH * PLANES x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the mean and of the largest pooled value over chunks
    offset: np.ndarray  # 1

    @staticmethod
    def start(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.5, (256, EMBEDDED)).astype("f4"),
            rng.normal(0, (WIDTH * PLANES) ** -0.5, (WIDTH * PLANES, FILTERS)).astype("f4"),
            np.zeros(FILTERS, "f4"),
            rng.normal(0, 0.1, 2 * FILTERS).astype("f4"),
            np.zeros(1, "f4"),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every byte, zero-padded, and each text's first chunk. An empty text has one."""
    counts = [1 if len(t) <= CHUNK else -(-(len(t) - OVERLAP) // (CHUNK - OVERLAP)) for t in texts]
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.zeros((int(firsts[-1]), CHUNK), np.uint8)
    for text, first, count in zip(texts, firsts, counts):
        data = np.frombuffer(text, np.uint8)
        for k in range(count):
            piece = data[k * (CHUNK - OVERLAP) : k * (CHUNK - OVERLAP) + CHUNK]
            out[first + k, : len(piece)] = piece
    return out, firsts[:-1]


def windows(chunks: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """Per chunk and position the inputs under the filters: embedded bytes and the repetition plane."""
    n, length = chunks.shape
    planes = np.zeros((n, length, PLANES), np.float32)
    planes[:, :, :EMBEDDED] = embedding[chunks]
    wide = chunks.astype(np.uint32)
    codes = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    repeated = np.zeros(codes.shape, bool)
    for lag in LAGS:
        repeated[:, lag:] |= codes[:, lag:] == codes[:, :-lag]
    planes[:, : length - 3, EMBEDDED] = repeated & (codes != 0)
    view = np.lib.stride_tricks.sliding_window_view(planes.reshape(n, -1), WIDTH * PLANES, axis=1)[:, ::PLANES]
    return np.ascontiguousarray(view)


def pooled(net: Network, chunks: np.ndarray, step: int = 32) -> np.ndarray:
    """Largest rectified response of every filter in every chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for a in range(0, len(chunks), step):
        inputs = windows(chunks[a : a + step], net.embedding)
        best = (inputs.reshape(-1, WIDTH * PLANES) @ net.filters).reshape(*inputs.shape[:2], FILTERS).max(axis=1)
        out[a : a + step] = np.maximum(best + net.bias, 0)
    return out


def combined(net: Network, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(firsts, len(values)))[:, None]
    features = np.hstack([np.add.reduceat(values, firsts) / counts, np.maximum.reduceat(values, firsts)])
    return features


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    chunks, firsts = chunked([text.encode() for text in texts])
    logits = combined(net, pooled(net, chunks), firsts) @ net.weights + net.offset
    return 1 / (1 + np.exp(-logits.astype(np.float64)))


def train(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 16, rate: float = 0.01, enough: float = 0.02, seed: int = 7) -> Network:
    """Adam on the mean log loss; gradients pass through the positions that won the pooling. Ends early when the mean
    loss of an epoch is below ``enough``."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    data, y = [text.encode() for text in texts], np.array(labels, np.float32)
    first, second, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs if len(y) else 0):
        order, loss = rng.permutation(len(y)), 0.0
        for a in range(0, len(y), batch):
            pick = order[a : a + batch]
            chunks, firsts = chunked([data[i] for i in pick])
            best, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
            for b in range(0, len(chunks), 32):
                inputs = windows(chunks[b : b + 32], net.embedding)
                response = (inputs.reshape(-1, WIDTH * PLANES) @ net.filters).reshape(*inputs.shape[:2], FILTERS)
                where[b : b + 32] = response.argmax(axis=1)
                best[b : b + 32] = np.take_along_axis(response, where[b : b + 32, None], 1)[:, 0]
            values = np.maximum(best + net.bias, 0)
            features = combined(net, values, firsts)
            counts = np.diff(np.append(firsts, len(values)))
            owner = np.repeat(np.arange(len(pick)), counts)
            guess = 1 / (1 + np.exp(-(features @ net.weights + net.offset)))
            loss -= np.log(np.maximum(1 - np.abs(guess - y[pick]), 1e-6)).sum()
            wrong = guess - y[pick]
            wrong /= len(pick)
            grad_value = wrong[owner, None] * net.weights[:FILTERS] / counts[owner, None]
            top = values == np.maximum.reduceat(values, firsts)[owner]
            grad_value = grad_value + top * wrong[owner, None] * net.weights[FILTERS:]
            grad_value *= values > 0
            under = winning_inputs(chunks, where, net.embedding)  # chunk, filter, input
            grad_filters = np.einsum("cfi,cf->if", under, grad_value)
            grad_input = (grad_value[:, :, None] * net.filters.T[None]).reshape(len(chunks), FILTERS, WIDTH, PLANES)
            grad_embedding = np.zeros_like(net.embedding)
            places = where[:, :, None] + np.arange(WIDTH)
            seen = np.take_along_axis(chunks[:, None, :], places.reshape(len(chunks), 1, -1), 2).reshape(places.shape)
            np.add.at(grad_embedding, seen, grad_input[..., :EMBEDDED])
            grads = [grad_embedding, grad_filters, grad_value.sum(0), features.T @ wrong + 1e-4 * net.weights, wrong.sum(keepdims=True)]
            t += 1
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if loss < enough * len(y):
            break
    return net


def winning_inputs(chunks: np.ndarray, where: np.ndarray, embedding: np.ndarray, step: int = 32) -> np.ndarray:
    out = np.empty((*where.shape, WIDTH * PLANES), np.float32)
    for a in range(0, len(chunks), step):
        inputs = windows(chunks[a : a + step], embedding)
        out[a : a + step] = np.take_along_axis(inputs, where[a : a + step, :, None], 1)
    return out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = 500,
    folds: int = 5,
    held_out: int = 0,
    label: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 7,
) -> Network:
    """Learn from ``per_label`` documents of each label (the bound of the sample), chosen by a keyed order of ids among
    labelled rows outside the held-out fold.

    Null labels and labels other than 0 and 1 are left out; of several labels of an id the lowest holds; of several
    documents of an id one is learned from. Without rows of both labels the network stays as it starts, with a score of
    a half everywhere."""
    known = labels.filter(F.col(label).isin(0, 1) & (fold(id_column, folds) != held_out))
    known = known.groupBy(id_column).agg(F.min(label).cast("int").alias("known_label"))
    picked = [
        known.filter(F.col("known_label") == value).orderBy(keyed_rank(id_column, seed), id_column).limit(per_label)
        for value in (0, 1)
    ]
    text = F.coalesce(F.col(text_column), F.lit(""))
    length, part = F.length(text), LEARN_BYTES // 8
    spaced = F.concat(*[text.substr((length * k / 8).cast("int") + 1, F.lit(part)) for k in range(8)])
    chosen = picked[0].union(picked[1]).select(F.col(id_column).alias("known_id"), "known_label")
    # at most 2 * per_label ids are sent to the scan of documents
    sample = docs.select(F.col(id_column).alias("known_id"), F.when(length > LEARN_BYTES, spaced).otherwise(text).alias("known_text"))
    sample = sample.join(F.broadcast(chosen), "known_id").groupBy("known_id", "known_label").agg(F.min("known_text").alias("known_text"))
    rows = sorted(sample.collect(), key=lambda r: str(r.known_id))
    values = [r.known_label for r in rows]
    if len(set(values)) < 2:
        net = Network.start(seed)
        net.weights[:] = 0
        return net
    # both labels weigh the same: the rarer one is repeated
    rows += [rows[i] for i in _balance(values)]
    return train([r.known_text for r in rows], [r.known_label for r in rows], seed=seed)


def _balance(values: list[int]) -> list[int]:
    by = {v: [i for i, x in enumerate(values) if x == v] for v in (0, 1)}
    few, many = sorted(by.values(), key=len)
    return [few[i % len(few)] for i in range(len(many) - len(few))]


def quality_score(net: Network, text: Column | str) -> Column:
    """Probability that a whole text has label 1; null and empty texts are scored as no bytes."""
    return text_column_udf(lambda: lambda texts: pa.array(probabilities(net, texts), pa.float64()), "double")(text)


def score_quality(docs: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    scored = docs.select(id_column, quality_score(net, text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
