"""A byte-level convolutional network, trained and applied in numpy, that scores the quality of whole documents.

A document's bytes are cut into overlapping chunks that cover it whole. Learned filters slide over the bytes of a chunk; the
strongest answer of each filter in a chunk describes the chunk. The mean and the largest of these over all chunks go
through one hidden layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import held_out

WIDTH, STEP, EMBED, FILTERS, HIDDEN = 8, 2, 8, 24, 16
CHUNK, HOP = 256, 128  # windows of one chunk, and from one chunk's start to the next one's
_PARTS = 8192  # windows taken at once, a multiple of HOP


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    hidden: np.ndarray  # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @staticmethod
    def new(seed: int) -> Network:
        draw = np.random.default_rng(seed).normal
        shapes = (256, EMBED), (WIDTH * EMBED, FILTERS), (FILTERS,), (2 * FILTERS, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)
        scales = 0.5, (WIDTH * EMBED) ** -0.5 * 2, 0.0, (2 * FILTERS) ** -0.5, 0.0, HIDDEN ** -0.5, 0.0
        return Network(*[draw(0, s or 1e-9, shape).astype(np.float32) for s, shape in zip(scales, shapes)])

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def windows(text: bytes) -> np.ndarray:
    """Start of each window of WIDTH bytes, STEP apart, over the padded text; the last window reaches its end."""
    return np.arange(0, max(len(text) - WIDTH, 0) + STEP, STEP)


def chunk_peaks(net: Network, text: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """For each chunk the strongest answer of each filter, and, if asked for, the window it came from.

    Answers are computed a bounded number of windows at a time. Chunks are CHUNK windows, HOP apart, so each window
    but those at the ends is in two chunks.
    """
    count = len(windows(text))
    codes = np.zeros((count - 1) * STEP + WIDTH, np.uint8)
    codes[:len(text)] = np.frombuffer(text, np.uint8)
    peaks, spots = [], []
    for start in range(0, count, _PARTS):
        stop = min(count, start + _PARTS)
        part = net.embed[codes[start * STEP:(stop - 1) * STEP + WIDTH]]
        view = np.lib.stride_tricks.as_strided(part, (stop - start, WIDTH * EMBED), (STEP * EMBED * 4, 4))
        answers = view @ net.filters
        bounds = np.arange(0, stop - start, HOP)
        peaks.append(np.maximum.reduceat(answers, bounds))
        if places:
            whole = len(answers) // HOP * HOP
            inside = answers[:whole].reshape(-1, HOP, FILTERS).argmax(axis=1) + np.arange(0, whole, HOP)[:, None] + start
            spots += [*inside, *([start + whole + answers[whole:].argmax(axis=0)] if whole < len(answers) else [])]
    half = np.concatenate(peaks)  # of HOP windows each; a chunk is two neighbours
    if len(half) == 1:
        return half, np.array(spots) if places else None, codes
    left, right = half[:-1], half[1:]
    if places:
        spots = np.where(left >= right, np.array(spots)[:-1], np.array(spots)[1:])
    return np.maximum(left, right), spots if places else None, codes


def describe(net: Network, peaks: np.ndarray) -> np.ndarray:
    """Mean and largest over the chunks of the filters' answers, cut at zero."""
    active = np.maximum(peaks + net.bias, 0)
    return np.concatenate([active.mean(axis=0), active.max(axis=0)])


def probability(net: Network, described: np.ndarray) -> np.ndarray:
    hidden = np.tanh(described @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias[0], -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.005, seed: int = 7) -> Network:
    """Fit by Adam on the cross-entropy, label 1 with 0.6 of the weight. One class alone gives its constant answer."""
    net = Network.new(seed)
    if not len(texts) or labels.min() == labels.max():
        net.out[:] = 0
        net.out_bias[0] = 0 if not len(texts) else (6 if labels[0] else -6)
        return net
    weight = np.where(labels == 1, 0.6 / labels.mean(), 0.4 / (1 - labels.mean()))
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    order, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        mixed = order.permutation(len(texts))
        for at in range(0, len(mixed), batch):
            chosen = mixed[at:at + batch]
            seen = [chunk_peaks(net, texts[i], True) for i in chosen]
            described = np.stack([describe(net, p) for p, _, _ in seen])
            hidden = np.tanh(described @ net.hidden + net.hidden_bias)
            error = ((probability(net, described) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            to_hidden = error[:, None] * net.out * (1 - hidden ** 2)
            to_described = to_hidden @ net.hidden.T
            grads = [np.zeros_like(net.embed), np.zeros_like(net.filters), np.zeros_like(net.bias),
                     described.T @ to_hidden, to_hidden.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            for (peaks, spots, codes), back in zip(seen, to_described):
                strongest = peaks.argmax(axis=0)
                to_peaks = np.repeat(back[None, :FILTERS] / len(peaks), len(peaks), axis=0)
                to_peaks[strongest, np.arange(FILTERS)] += back[FILTERS:]
                to_peaks *= peaks + net.bias > 0
                grads[2] += to_peaks.sum(axis=0)
                rows, kinds = np.nonzero(to_peaks)
                force = to_peaks[rows, kinds]
                inputs = codes[spots[rows, kinds][:, None] * STEP + np.arange(WIDTH)]
                into = (force[:, None] * net.filters[:, kinds].T).reshape(-1, EMBED)
                picked = np.zeros((len(kinds), FILTERS), np.float32)
                picked[np.arange(len(kinds)), kinds] = force
                grads[1] += net.embed[inputs].reshape(len(kinds), -1).T @ picked
                np.add.at(grads[0], inputs.ravel(), into)
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for p, g, a, b in zip(net.parts(), grads, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= pace * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-7)
    return net


def learn_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
                  rows: int = 3000, seed: int = 7) -> Network:
    """Fit on a bounded sample: at most `rows` labelled documents, half of either class where there are enough.

    The sample is that of the smallest hashes of the id, so reruns agree. Rows with a NULL id, text or label, and those
    held out, teach nothing. An id labelled both ways counts once for each.
    """
    marked = (labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id")).distinct()
              .withColumn("draw", F.xxhash64(F.lit(seed), "id")))
    drawn = None
    for value in (0, 1):
        some = marked.where(F.col("label") == value).orderBy("draw", "id").limit(rows // 2)
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = F.broadcast(drawn)  # at most `rows` rows
    found = (docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
             .join(drawn, "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id", "label").collect())
    return train([row.text.encode() for row in found], np.array([row.label for row in found], np.float32), seed=seed)


def score_quality(docs: DataFrame, net: Network, id_column: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every row of `docs`.

    Whole texts are read, a bounded part at a time. A NULL text is scored as an empty one, which is a single padded window.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            described = np.array([describe(net, chunk_peaks(net, (t.as_py() or "").encode())[0]) for t in batch.column(2)])
            scores = probability(net, described.reshape(-1, 2 * FILTERS)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, net: Network, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `threshold`."""
    columns = docs.columns
    place = next(i for i, c in enumerate(columns) if c.lower() == text.lower())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            described = np.array([describe(net, chunk_peaks(net, (str(t) if (t := v.as_py()) is not None else "").encode())[0]) for v in batch.column(place)])
            good = probability(net, described.reshape(-1, 2 * FILTERS)) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
