"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, their stems (the
n-grams of letters a word begins with), pairs of neighbours and pairs that skip
a word. Every coordinate has its own learning rate, and the
L1 penalty leaves few weights that are not zero, so the model is small enough to
send to every task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.llm.labelled import labelled_sample, slices, with_columns
from gapcast.llm.tables import stage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KNOWN_WORDS = 400_000
STEMS = (4, 5)


class _Hashes(dict):
    """Word to row of ``table``: hashes of the word and of its stems, its first 4 and 5 letters."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 16, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        letters = word.decode("utf-8", "replace")
        self.table[row] = [xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest(letters[:n].encode(), n) for n in STEMS)]
        self[word] = row
        return row


def features(texts: list[str | None], hashes: _Hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all n-grams and skip-grams, with repetitions."""
    if len(hashes) >= KNOWN_WORDS:
        hashes.clear()
    found = [WORD.findall(t.lower().encode()) if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    rows = np.fromiter((hashes[w] for words in found for w in words), np.int64, lengths.sum())
    doc, code = np.repeat(np.arange(len(texts)), lengths), hashes.table[rows]
    docs, grams = [doc] * (1 + len(STEMS)), list(code.T)
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        mixed = code[:-gap, 0] * np.uint64(0x9E3779B97F4A7C15) + code[gap:, 0] * np.uint64(2 * gap + 1)
        docs.append(doc[gap:][same])
        grams.append((mixed ^ (mixed >> np.uint64(31)))[same] * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(docs), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(sorted_grams: np.ndarray) -> bytes:
    """Sorted features as compressed steps, a quarter of their size."""
    return zlib.compress(np.diff(sorted_grams, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int64)


@dataclass
class ToxicityModel:
    """Sorted features with weights other than zero, and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int


class Ftrl:
    """FTRL-proximal on the log loss, with binary features; the intercept has no penalty."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bits = alpha, beta, l1, l2, bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / (rate + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, 1 << self.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> ToxicityModel:
        every = self.weights(np.arange((1 << self.bits) + 1))
        places = np.flatnonzero(every[:-1])
        return ToxicityModel(places, every[places], float(every[-1]), self.bits)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    bits: int = 20,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.01,
    epochs: int = 5,
) -> ToxicityModel:
    """Weights learnt from at most ``max_rows`` labelled documents, read in a stream, ``epochs`` times.

    ``learn`` is a condition on the columns of ``labels``. The order is that of
    id hashes, so the fit is the same on every run. Without labelled documents
    all scores are 0.5.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, learn, max_rows)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for piece, texts in slices(batch, 0):
                doc, gram = features(texts, hashes, bits)
                both = np.unique((doc << bits) | gram)
                cuts = np.searchsorted(both, np.arange(1, len(texts)) << bits)
                parts = [_packed(p) for p in np.split(both & ((1 << bits) - 1), cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), *piece.columns[1:]], ["grams", "label", "at"])

    rows = sample.select("text", "label", F.xxhash64("id").alias("at"))
    rows = rows.mapInArrow(distinct, "grams binary, label double, at long")
    rows = stage(rows.repartition(8, "at").sortWithinPartitions("at"), "toxicity-sample")
    ftrl = Ftrl(bits, alpha, beta, l1, l2)
    for _ in range(epochs):
        for row in rows.toLocalIterator():
            ftrl.learn(_unpacked(row["grams"]), row["label"])
    return ftrl.model()


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of the label, from whole texts.

    Null and empty texts have no features and get the score of the intercept. A
    column already named like the score is replaced. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^bits weights, few of them kept by L1
    state: dict = {}

    def score(texts: list[str | None]) -> list[np.ndarray]:
        model = shared.value
        if "dense" not in state:
            state["dense"] = np.zeros(1 << model.bits)
            state["dense"][model.places] = model.weights
            state["hashes"] = _Hashes()
        doc, gram = features(texts, state["hashes"], model.bits)
        weighty = np.flatnonzero(state["dense"][gram])
        pairs = np.unique((doc[weighty] << model.bits) | gram[weighty])
        sums = np.bincount(pairs >> model.bits, state["dense"][pairs & ((1 << model.bits) - 1)], len(texts))
        return [1 / (1 + np.exp(-np.clip(sums + model.intercept, -35, 35)))]

    return with_columns(docs, text_col, f"{score_col} double", score)
