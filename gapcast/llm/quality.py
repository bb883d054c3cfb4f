"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token hashes to one of ``vocabulary`` codes. A code has a sparse random
index vector; its context vector is the sum of the index vectors of the tokens
around it, gathered over all documents. Documents are pooled from the context
vectors of their tokens. A small network learns the label from the pools, and a
temperature fitted on held-back rows calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from gapcast.llm.labelled import labelled_sample, slices, with_columns

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
REACH = (1, 2)
NONZERO = 2
BLOCK = 256
KNOWN_WORDS = 400_000


class Codes(dict):
    """Token to code, with a bounded memory of tokens seen."""

    def __init__(self, vocabulary: int):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        code = self[token] = xxhash.xxh64_intdigest(token) % self.vocabulary
        return code

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens end to end, and the number of tokens of each text."""
        tokens = [TOKEN.findall(t.encode()) if t else [] for t in texts]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter((self[w] for t in tokens for w in t), np.int64, lengths.sum()), lengths


def index_vectors(vocabulary: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every code's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dims, (vocabulary, NONZERO)), rng.choice([-1.0, 1.0], (vocabulary, NONZERO))


def _add_contexts(total: np.ndarray, codes: np.ndarray, lengths: np.ndarray, index) -> None:
    places, signs = index
    vocabulary, width = total.shape  # the last column counts
    doc = np.repeat(np.arange(len(lengths)), lengths)
    flat = total.reshape(-1)
    for reach in REACH:
        same = doc[reach:] == doc[:-reach]
        near, far = codes[:-reach][same], codes[reach:][same]
        for word, other in ((near, far), (far, near)):
            for j in range(NONZERO):
                flat += np.bincount(word * width + places[other, j], signs[other, j], flat.size).astype(np.int64)
    total[:, -1] += np.bincount(codes, minlength=vocabulary)


def context_vectors(
    docs: DataFrame, text_col: str = "text", vocabulary: int = 1 << 14, dims: int = 48, seed: int = 17
) -> np.ndarray:
    """Unit context vectors of all codes, from every token of every document.

    Each task sums its own documents and gives out blocks of codes; these are
    added up per block in a stream, so memory is one matrix of vocabulary x dims
    whatever the corpus. The driver gets that one matrix. Sums are of whole
    numbers, so no order of tasks changes them.
    """
    index, width = index_vectors(vocabulary, dims, seed), dims + 1

    def blocks(total: np.ndarray, keys) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[i].tobytes() for i in range(len(keys))], pa.binary())], ["block", "sums"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = Codes(vocabulary), np.zeros((vocabulary, width), np.int64)
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            if held:
                _add_contexts(total, np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]), index)
                held.clear()

        for batch in batches:
            for _, texts in slices(batch, 0):
                held.append(codes.of(texts))
                size += len(held[-1][0])
                if size > 1 << 19:  # a sum over the matrix costs the same for any number of tokens
                    flush()
                    size = 0
        flush()
        if total.any():
            yield blocks(total.reshape(-1, BLOCK * width), range(vocabulary // BLOCK))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, np.int64)
                sums[key] = sums[key] + part if key in sums else part.copy()
        if sums:
            yield blocks(np.stack(list(sums.values())), list(sums))

    parts = docs.select(text_col).mapInArrow(gather, "block int, sums binary").repartition("block")
    total = np.zeros((vocabulary // BLOCK, BLOCK * width), np.int64)
    for row in parts.mapInArrow(add, "block int, sums binary").collect():  # vocabulary / BLOCK rows
        total[row["block"]] = np.frombuffer(row["sums"], np.int64)
    total = total.reshape(vocabulary, width).astype(np.float64)
    context, count = total[:, :-1], total[:, -1:]
    centred = context - count * (context.sum(axis=0) / max(count.sum(), 1))
    return (centred / (np.linalg.norm(centred, axis=1, keepdims=True) + 4)).astype(np.float32)


def pools(vectors: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean, mean square, agreement of neighbours and length of every document's word vectors."""
    dims, n = vectors.shape[1], len(lengths)
    out = np.zeros((n, 2 * dims + 4), np.float32)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    own = vectors[codes]
    starts = (np.cumsum(lengths) - lengths)[full]
    size = lengths[full, None].astype(np.float32)
    out[full, :dims] = np.add.reduceat(own, starts) / size
    out[full, dims : 2 * dims] = np.sqrt(np.add.reduceat(own * own, starts) / size)
    beside = np.zeros((len(codes), 2), np.float32)
    doc = np.repeat(np.arange(n), lengths)
    beside[:-1, 0] = np.einsum("ij,ij->i", own[:-1], own[1:]) * (doc[:-1] == doc[1:])
    beside[:-1, 1] = (codes[:-1] == codes[1:]) & (doc[:-1] == doc[1:])
    out[full, 2 * dims : 2 * dims + 2] = np.add.reduceat(beside, starts) / size
    out[full, -2] = np.linalg.norm(out[full, :dims], axis=1)
    out[full, -1] = np.log1p(lengths[full])
    return out


@dataclass
class Network:
    """Standardized input, one hidden layer, one output; ``temperature`` divides the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; a tenth of the rows is held back for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = len(x) // 10
    calibrate, learn = order[:cut], order[cut:]
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(learn), max(12, len(learn) // 256)):
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            error = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -30, 30))) - y[rows]
            back = np.outer(error, weights[2]) * (1 - h * h) / len(rows)
            grads = [z[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error / len(rows) + 1e-4 * weights[2], np.array([error.mean()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    if cut >= 50:
        logits, truth = net.logits(x[calibrate]), y[calibrate]
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        losses = [np.mean(np.logaddexp(0, -np.where(truth > 0.5, 1, -1) * logits / t)) for t in heats]
        net.temperature = float(heats[int(np.argmin(losses))])
    return net


@dataclass
class QualityModel:
    """Word vectors and network: about vocabulary x dims floats, whatever the corpus."""

    vectors: np.ndarray
    network: Network | None
    prior: float = 0.5


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    vocabulary: int = 1 << 14,
    dims: int = 48,
) -> QualityModel:
    """Word vectors from all documents; the network from at most ``max_rows`` labelled ones.

    ``learn`` is a condition on the columns of ``labels``. Without labelled
    documents every score is 0.5; with labels of one kind only it is their share
    of ones.
    """
    vectors = context_vectors(docs, text_col, vocabulary, dims)
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, learn, max_rows)
    width = 2 * dims + 4

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        for batch in batches:
            for piece, texts in slices(batch, 0):
                x = pools(vectors, *codes.of(texts))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), piece.column(1), piece.column(2)], ["x", "label", "id"])

    id_type = sample.schema["id"].dataType.simpleString()
    rows = sample.select("text", "label", "id").mapInArrow(pooled, f"x binary, label double, id {id_type}").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["label"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return QualityModel(vectors, None, float(y[0]) if len(rows) else 0.5)
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, width).astype(np.float64)
    return QualityModel(vectors, fit_network(x, y))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1. Null and empty texts are scored as texts without words.

    A column already named like the score is replaced. Repeated rows are scored alike.
    """
    prior = model.prior
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.network))  # vocabulary x dims floats
    state: dict = {}

    def score(texts: list[str | None]) -> list[np.ndarray]:
        vectors, network = shared.value
        if network is None:
            return [np.full(len(texts), prior)]
        codes = state.setdefault("codes", Codes(len(vectors)))
        return [network.probability(pools(vectors, *codes.of(texts)).astype(np.float64))]

    return with_columns(docs, text_col, f"{score_col} double", score)

