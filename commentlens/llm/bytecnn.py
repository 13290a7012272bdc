"""Quality classifier: a convolutional network over bytes, trained and applied with numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector;
learned filters of ``WIDTH`` bytes slide over a chunk in steps of ``STEP``. A filter's answer for a
chunk is its maximum; for a text, the maximum and the mean over the chunks. A logistic layer combines
these into one probability. Chunks overlap by ``WIDTH - STEP`` bytes, so that every position of a
filter lies inside some chunk, and a text is scored in pieces, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, STEP, CHUNK = 16, 4, 512
VECTOR, FILTERS = 6, 24
#: Labelled rows that the network learns from at most, each with its whole text.
FIT_ROWS = 4000
_PAD = 256
_BLOCKS = WIDTH // STEP
#: Chunks that are convolved at once.
_BATCH = 256


def chunked(data: bytes) -> np.ndarray:
    """Rows of ``CHUNK`` byte numbers; the last row is filled up with ``_PAD``."""
    stride = CHUNK - WIDTH + STEP
    count = 1 if len(data) <= CHUNK else 1 + -(-(len(data) - CHUNK) // stride)
    padded = np.full((count - 1) * stride + CHUNK, _PAD, np.int16)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::stride]


class ByteNetwork:
    """Weights: byte vectors, filters, filter offsets, and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.5, (_PAD + 1, VECTOR)).astype(np.float32)
        self.vectors[_PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * VECTOR), (WIDTH * VECTOR, FILTERS)).astype(np.float32)
        self.offsets = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def convolved(self, chunks: np.ndarray) -> np.ndarray:
        """Filter answers before the maximum: chunk x position x filter."""
        blocks = self.vectors[chunks].reshape(len(chunks), CHUNK // STEP, STEP * VECTOR)
        positions = CHUNK // STEP - _BLOCKS + 1
        size = STEP * VECTOR
        out = blocks[:, :positions] @ self.filters[:size]
        for k in range(1, _BLOCKS):
            out += blocks[:, k:k + positions] @ self.filters[k * size:(k + 1) * size]
        return out

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        parts = [self.convolved(chunks[k:k + _BATCH]).max(axis=1) for k in range(0, len(chunks), _BATCH)]
        return np.tanh(np.concatenate(parts) + self.offsets)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability per text; texts are chunked one by one and convolved together."""
        out = np.zeros(len(texts))
        held: list[np.ndarray] = []
        first = size = 0
        for i, text in enumerate(texts):
            held.append(chunked(text))
            size += len(held[-1])
            if size >= _BATCH or i == len(texts) - 1:
                answers = self.answers(np.concatenate(held))
                edges = np.cumsum([0, *(len(h) for h in held)])
                most = np.maximum.reduceat(answers, edges[:-1])
                mean = np.add.reduceat(answers, edges[:-1]) / np.diff(edges)[:, None]
                z = np.concatenate([most, mean], axis=1) @ self.weights + self.bias[0]
                out[first:i + 1] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                held, first, size = [], i + 1, 0
        return out

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offsets, self.weights, self.bias]

    def strongest(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk and filter, where its answer is highest and the answer."""
        places, answers = [], []
        for k in range(0, len(chunks), _BATCH):
            raw = self.convolved(chunks[k:k + _BATCH])
            places.append(raw.argmax(axis=1))
            answers.append(np.take_along_axis(raw, places[-1][:, None], 1)[:, 0])
        return np.concatenate(places), np.tanh(np.concatenate(answers) + self.offsets)

    def gradients(self, chunks: list[np.ndarray], labels: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss over all chunks; a maximum passes its gradient to one place only."""
        all_chunks = np.concatenate(chunks)
        place, answers = self.strongest(all_chunks)
        edges = np.cumsum([0, *(len(c) for c in chunks)])
        grads = [np.zeros_like(p) for p in self.parameters()]
        back = np.zeros_like(answers)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = answers[a:b]
            top = own.argmax(axis=0)
            features = np.concatenate([own.max(axis=0), own.mean(axis=0)])
            z = float(np.clip(features @ self.weights + self.bias[0], -30, 30))
            error = (1 / (1 + np.exp(-z)) - labels[i]) * importance[i] / len(chunks)
            grads[3] += error * features
            grads[4] += error
            back[a:b] += error * self.weights[FILTERS:] / (b - a)
            back[a + top, np.arange(FILTERS)] += error * self.weights[:FILTERS]
        back *= 1 - answers ** 2
        grads[2] += back.sum(axis=0)
        for k in range(0, len(all_chunks), _BATCH):
            part = slice(k, k + _BATCH)
            spots = place[part][:, :, None] * STEP + np.arange(WIDTH)
            seen = np.take_along_axis(all_chunks[part][:, None, :], spots, axis=2)
            windows = self.vectors[seen].reshape(len(seen), FILTERS, WIDTH * VECTOR)
            grads[1] += np.einsum("cf,cfw->wf", back[part], windows)
            to_vectors = (back[part][:, :, None] * self.filters.T[None]).reshape(-1, VECTOR)
            for v in range(VECTOR):
                grads[0][:, v] += np.bincount(seen.ravel(), to_vectors[:, v], _PAD + 1)
        grads[0][_PAD] = 0
        return grads

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        """Adam on batches of whole texts; both labels weigh the same in sum."""
        rng = np.random.default_rng(seed)
        share = labels.mean() if len(labels) else 0.0
        if not 0 < share < 1:
            # nothing to tell apart: a constant on the side of the only label
            self.weights[:] = 0
            self.bias[0] = (8.0 * share - 4.0) if len(labels) else 0.0
            return self
        importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        pieces = [chunked(t) for t in texts]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                take = order[k:k + batch]
                step += 1
                speed = rate * (0.2 if epoch >= epochs * 3 // 4 else 1)
                grads = self.gradients([pieces[i] for i in take], labels[take], importance[take])
                for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= speed * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return self


def held_out(id_col: Column) -> Column:
    """The rows that no model may learn labels from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 6, id_col: str = "doc_id", text_col: str = "text") -> ByteNetwork:
    """Fits on at most ``fit_rows`` labelled rows, those with the smallest id hashes, never on held-out ones.

    Labels other than 0 and 1 and rows without id are left out; of texts with one id the first in byte order counts. Texts
    are learnt from whole. Without both labels the score is constant.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = (
        usable.groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    )
    plain = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    # at most fit_rows rows of two numbers; one text of each id reaches the driver, however often it repeats
    single = plain.join(F.broadcast(chosen), "__id").groupBy("__id", "__quality").agg(F.min("__text").alias("__text"))
    picked = single.toPandas().sort_values("__id")
    return ByteNetwork().fit([t.encode() for t in picked["__text"]], picked["__quality"].to_numpy(float), epochs)


def scored(docs: DataFrame, network: ByteNetwork, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a null text counts as empty.

    All columns stay; columns of ``docs`` that are called score or predicted are replaced. An empty
    text has the score of an empty chunk.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.scores([(t or "").encode() for t in texts]))

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
