"""Quality classifier: random-indexing word vectors, pooled, into a small network.

Words and word shapes are hashed into ``BUCKETS`` units. Every unit has a sparse
random index vector of +1 and -1; a unit's word vector is the sum of the index
vectors of its neighbours in the sample, damped by log and scaled to length one.
A document is its word vectors pooled three ways (words by occurrence, words by
type, shapes by occurrence) with how much it repeats itself and how long it is.
Two numpy layers give a logit, and a temperature fitted on rows that the network
has not learned from turns it into a probability.

The classifier (vectors and network) is fitted on a bounded sample of about
``sample_docs`` labelled rows; scoring reads whole texts of all rows.

Defined cases: a null or empty text pools to zeros and gets the score that the
network gives them; rows without a label teach nothing, a repeated label counts
as often as it comes; with no labels, or labels of one kind, every score is that
share; repeated rows score alike, and a sample of few keys is drawn by row; if
either side of the calibration split is empty, all rows serve for both; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import sampled, slices, tidy
from millrace.session import written

BUCKETS, WIDTH, ONES, WINDOW = 1 << 14, 48, 4, 2
EXTRA = 4
FEATURES = 3 * WIDTH + EXTRA
#: Letters, digits and other bytes by kind; what separates words stays.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse row of ``ONES`` times +1 and -1 for every unit."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    place = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, : 2 * ONES]
    out[np.arange(BUCKETS)[:, None], place] = np.repeat([1, -1], ONES)
    return out


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word units and shape units of all words, and how many words each text has."""
    words, shapes, sizes = [], [], []
    crc = zlib.crc32
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        mine = data.split()
        sizes.append(len(mine))
        words += map(crc, mine)
        shapes += map(crc, data.translate(SHAPE).split())
    as_units = lambda x: (np.array(x, np.int64) % (BUCKETS // 2)).astype(np.int32)
    # A non-breaking byte cannot split: both sequences have the same words.
    return as_units(words), as_units(shapes) + BUCKETS // 2, np.array(sizes)


def neighbours(seq: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For every unit the sum of the index vectors of what stands near it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for d in range(1, WINDOW + 1):
        near = owner[d:] == owner[:-d]
        left, right = seq[:-d][near], seq[d:][near]
        # By pairs of units first: a frequent pair is added once.
        for a, b in ((left, right), (right, left)):
            pair, n = np.unique(a.astype(np.int64) * BUCKETS + b, return_counts=True)
            if len(pair):
                unit = pair // BUCKETS
                head = np.flatnonzero(np.diff(unit, prepend=-1))
                out[unit[head]] += np.add.reduceat(index[pair % BUCKETS] * n[:, None].astype(np.float32), head, axis=0)
    return out


@dataclass
class Classifier:
    vectors: np.ndarray
    layers: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float
    share: float

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        words, shapes, sizes = units(texts)
        n = len(texts)
        out = np.zeros((n, FEATURES), np.float32)
        if not len(words):
            return out
        owner = np.repeat(np.arange(n), sizes)
        full = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[full]
        size = sizes[full, None]
        out[full, :WIDTH] = np.add.reduceat(self.vectors[words], first, axis=0) / size
        out[full, 2 * WIDTH : 3 * WIDTH] = np.add.reduceat(self.vectors[shapes], first, axis=0) / size
        kind = np.unique(owner * np.int64(BUCKETS) + words)
        kinds = np.bincount(kind // BUCKETS, minlength=n)
        start = (np.cumsum(kinds) - kinds)[full]
        out[full, WIDTH : 2 * WIDTH] = np.add.reduceat(self.vectors[kind % BUCKETS], start, axis=0) / kinds[full, None]
        again = np.zeros(len(words))
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        shape_kinds = np.bincount(np.unique(owner * np.int64(BUCKETS) + shapes) // BUCKETS, minlength=n)
        out[:, 3 * WIDTH] = np.log1p(sizes)
        out[full, 3 * WIDTH + 1] = np.add.reduceat(again, first) / size[:, 0]
        out[full, 3 * WIDTH + 2] = kinds[full] / size[:, 0]
        out[full, 3 * WIDTH + 3] = np.log1p(shape_kinds[full]) / np.log1p(size[:, 0])
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.share)
        z = np.clip(self.logits(self.pooled(texts).astype(np.float64)) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z))


def learned(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> list[np.ndarray]:
    """Two layers by Adam on cross entropy over small batches."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 128)):
            step += 1
            w1, b1, w2, b2 = layers
            h = np.tanh(x[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[part]) / len(part)
            back = error[:, None] * w2 * (1 - h**2)
            for k, g in enumerate((x[part].T @ back + decay * w1, back.sum(0), h.T @ error + decay * w2, np.array([error.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                layers[k] = layers[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy on held-back rows."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.clip(z / t, -30, 30)) - y * np.clip(z / t, -30, 30)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = 5000) -> Classifier:
    """A classifier for ``label`` 0 or 1 from a bounded sample of ``labelled``."""
    rows = labelled.select(key, text, F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    size = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).collect()[0]
    # Bounded, as the sample is; read twice below.
    chosen = written(sampled(rows, key, sample_docs, size["n"]).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), "label").repartition(8, "key"), "sample")
    share = 0.5 if size["share"] is None else float(size["share"])
    index = index_vectors()
    blank = Classifier(index, [], np.zeros(FEATURES), np.ones(FEATURES), 1.0, share)
    if share in (0.0, 1.0) or not size["n"]:
        return blank

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH), np.float32)
        for part in slices(batches, 0):
            words, shapes, sizes = units(part.column(0).to_pylist())
            for seq in (words, shapes):
                total += neighbours(seq, sizes, index)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = np.zeros((BUCKETS, WIDTH))
    for row in chosen.select("text").mapInArrow(tidy(contexts), "total binary").toLocalIterator():
        total += np.frombuffer(row["total"], np.float32).reshape(BUCKETS, WIDTH)
    total = np.sign(total) * np.log1p(np.abs(total))
    # Unseen units keep their index vectors.
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = np.where(norm > 0, total / np.maximum(norm, 1e-9), index / np.sqrt(2 * ONES)).astype(np.float32)
    draft = Classifier(vectors, [], blank.mean, blank.scale, 1.0, share)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            features = draft.pooled(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(features), pa.list_(pa.float32()))], names=["key", "label", "x"])

    found = chosen.select("key", "text", "label").mapInArrow(tidy(pooled), "key string, label int, x array<float>").toPandas()  # a bounded sample
    found = found.iloc[np.lexsort((found["x"].map(lambda v: np.asarray(v, np.float32).tobytes()), found["label"], found["key"].fillna("").to_numpy(str)))] if len(found) else found
    if not len(found):
        return blank
    x = np.stack(found["x"].to_numpy()).astype(np.float64)
    y = found["label"].to_numpy(np.float64)
    back = np.array([zlib.crc32(f"back{k}".encode()) % 5 == 4 for k in found["key"]])
    front = ~back
    if back.all() or front.all():
        back = front = np.ones(len(y), bool)
    mean, scale = x[front].mean(0), x[front].std(0) + 1e-3
    layers = learned((x[front] - mean) / scale, y[front])
    model = Classifier(vectors, layers, mean, scale, 1.0, share)
    model.temperature = fitted_temperature(model.logits(x[back]), y[back])
    return model


def score(documents: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every row."""
    kept = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept.value.scores(part.column(1).to_pylist()))], names=[key, "score"])

    return documents.select(key, text).mapInArrow(tidy(work), f"`{key}` {kind}, score double")
