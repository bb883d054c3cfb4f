"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its
letters, each permuted by its place, into their product; a text bundles its
trigrams into their sum. The sums of the texts of a language are its prototype,
and a text has the language whose prototype is closest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.llm.labelled import slices, with_columns

UNKNOWN = "und"
KNOWN_GRAMS = 1 << 15
COLUMNS = 4096
SMALL_ALPHABET = 100
# Bundles of unit length are added up as whole numbers, so no order of tasks changes a prototype.
UNIT = float(1 << 24)
# Texts bundled at a time at most.
TEXTS = 2048


class Hypervectors:
    """Vectors of letters and trigrams, made from their code points and kept while there is room."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[tuple[int, int, int], int] = {}
        self.table = np.empty((KNOWN_GRAMS, dims), np.float32)
        self.is_letter = np.zeros(0x110000, bool)
        self.asked = np.zeros(0x110000, bool)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            rng = np.random.default_rng([self.seed, point])
            self.letters[point] = rng.choice(np.array([-1, 1], np.float32), self.dims)
        return self.letters[point]

    def gram(self, points: tuple[int, int, int]) -> np.ndarray:
        a, b, c = map(self.letter, points)
        return np.roll(a, 2) * np.roll(b, 1) * c

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams given as rows of three code points."""
        if len(self.grams) + len(grams) > KNOWN_GRAMS:
            self.grams.clear()
        places = []
        for key in map(tuple, grams.tolist()):
            place = self.grams.get(key)
            if place is None:
                place = self.grams[key] = len(self.grams)
                self.table[place] = self.gram(key)
            places.append(place)
        return self.table[places]

    def points(self, text: str) -> np.ndarray:
        """Code points of the lower-cased letters; any run of other characters is one blank."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        new = np.unique(points[~self.asked[points]])
        self.asked[new] = True
        self.is_letter[new] = [chr(p).isalpha() for p in new.tolist()]
        letter = self.is_letter[points]
        points = np.where(letter, points, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of other characters after a letter
        keep[0] = True
        return points[keep]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled trigrams of every text, and whether it has a letter at all."""
        if len(texts) > TEXTS:  # a bounded number of texts at a time, too, however short they are
            parts = [self.bundles(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        parts = [self.points(t or "") for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), lengths)
        inside = doc[2:] == doc[:-2]
        doc = doc[2:][inside]
        alphabet, ids = np.unique(points, return_inverse=True)
        size = len(alphabet)
        codes = ((ids[:-2] * size + ids[1:-1]) * size + ids[2:])[inside]
        if size <= SMALL_ALPHABET:
            present = np.flatnonzero(np.bincount(codes, minlength=size**3))
            place = np.zeros(size**3, np.int64)
            place[present] = np.arange(len(present))
            codes = place[codes]
        else:
            present, codes = np.unique(codes, return_inverse=True)
        out = np.zeros((len(parts), self.dims), np.float32)
        order = np.argsort(codes, kind="stable") if len(present) > COLUMNS else None
        for start in range(0, len(present), COLUMNS):  # a bounded number of trigrams at a time
            chosen = present[start : start + COLUMNS]
            if order is None:
                d, c = doc, codes
            else:
                low, high = np.searchsorted(codes, [start, start + len(chosen)], sorter=order)
                d, c = doc[order[low:high]], codes[order[low:high]] - start
            counts = np.bincount(d * len(chosen) + c, minlength=len(parts) * len(chosen))
            grams = alphabet[np.stack([chosen // size**2, chosen // size % size, chosen % size], axis=1)]
            out += counts.reshape(len(parts), -1).astype(np.float32) @ self.rows(grams)
        return out, lengths > 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    """One prototype of unit length per language, and what letters are made of."""

    languages: list[str]
    prototypes: np.ndarray
    dims: int
    seed: int


def fit_languages(
    docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", dims: int = 512, seed: int = 29
) -> LanguageModel:
    """Prototypes from all documents that meet ``learn`` and have a language and a letter.

    Every document counts alike, however long. Each task gives one vector per
    language; these are added in a stream, and one per language comes to the
    driver. The number of languages must be small: it is that of the label's values.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            vectors = pa.array([v.tobytes() for v in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), vectors], ["lang", "bundle"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Hypervectors(dims, seed), {}
        for batch in batches:
            for piece, texts in slices(batch, 1):
                found, lettered = space.bundles(texts)
                whole = np.rint(_unit(found) * UNIT).astype(np.int64)
                langs = np.array(piece.column(0).to_pylist(), object)
                for lang in set(langs[lettered]):
                    sums[lang] = sums.get(lang, 0) + whole[lettered & (langs == lang)].sum(axis=0)
        yield from rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(part, np.int64)
        yield from rows(sums)

    parts = known.mapInArrow(bundle, "lang string, bundle binary").repartition("lang")
    found = {r["lang"]: np.frombuffer(r["bundle"], np.int64) for r in parts.mapInArrow(add, "lang string, bundle binary").collect()}
    languages = sorted(found)
    prototypes = np.array([found[lang] for lang in languages], np.float64).reshape(-1, dims)
    return LanguageModel(languages, _unit(prototypes).astype(np.float32), dims, seed)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with lang_pred and score (the cosine, 0 where it is negative).

    ``und`` with score 0 where the text is null or has no letter, or no language
    was learnt. Equal cosines go to the language first in the alphabet. Older
    columns named lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x dims floats
    state: dict = {}

    def score(texts: list[str | None]) -> list:
        model = shared.value
        if not model.languages:
            return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
        space = state.setdefault("space", Hypervectors(model.dims, model.seed))
        found, lettered = space.bundles(texts)
        cosines = (_unit(found) @ model.prototypes.T).astype(np.float64)
        best = cosines.argmax(axis=1)
        values = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
        return [[model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], values]

    return with_columns(docs, text_col, "lang_pred string, score double", score)
