"""Benchmark decontamination by winnowing.

Both sides keep, of every window of consecutive k-gram hashes, the smallest one.
With grams of k words and windows of n - k + 1 grams, any span of n words that a
document shares with an item holds a gram that both sides keep. Kept grams are
joined on their hash; around each meeting the words themselves are compared and
the match is extended as far as a window of n words can reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.tables import stage

# Runs of digits, letters a-z and anything beyond ASCII, on lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BATCH_BYTES = 4 << 20
VOCABULARY = 500_000
# The filter of benchmark grams sent to all tasks: 2^22 bits in 64-bit words, half a megabyte whatever the benchmark.
FILTER_WORDS = 1 << 16
SALT = 32
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per run of k word hashes."""
    n = len(codes) - k + 1
    mixed = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def kept_grams(hashes: np.ndarray, window: int) -> np.ndarray:
    """Marks every gram that is smallest in some window of ``window`` grams."""
    n = len(hashes) - window + 1
    marks = np.zeros(len(hashes), bool)
    if n > 0:
        least = reduce(np.minimum, [hashes[i : i + n] for i in range(window)])
        for i in range(window):
            marks[i : i + n] |= hashes[i : i + n] == least
    return marks & (hashes != NEVER)


def _filter_word(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(6)) % np.uint64(FILTER_WORDS)).astype(np.int64)


def _batch_grams(texts: list[list[bytes]], codes: np.ndarray, k: int, window: int):
    """(document, place, hash) arrays of the kept grams of several documents laid end to end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes = gram_hashes(codes, k)
    for i in range(1, k):  # grams that reach over the end of a document
        over = starts[1:-1] - i
        hashes[over[(over >= 0) & (over < len(hashes))]] = NEVER
    at = np.flatnonzero(kept_grams(hashes, window))
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], hashes[at]


SCHEMA = "id {id}, row_hash long, n_words long, size int, place array<int>, gram array<long>, context array<binary>"


def _grams(source: DataFrame, sizes: list[int], k: int, bits: np.ndarray | None) -> DataFrame:
    """One row per text and window size: number of words, kept grams, and the words around each.

    ``source`` has columns id, text and row_hash. With ``bits`` only grams of the filter are given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _WordHashes()
        for batch in batches:
            first, volume = 0, 0
            for i in range(batch.num_rows):
                volume += len(batch.column(1)[i].as_buffer() or b"")
                if volume >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield from part(batch.slice(first, i + 1 - first), vocabulary)
                    first, volume = i + 1, 0

    def part(batch: pa.RecordBatch, vocabulary: _WordHashes) -> Iterator[pa.RecordBatch]:
        texts = [words(t.as_py()) for t in batch.column(1)]
        total = sum(map(len, texts))
        codes = np.fromiter((vocabulary[w] for t in texts for w in t), np.uint64, total)
        for size in sizes:
            gram = min(k, size)
            doc, place, value = _batch_grams(texts, codes, gram, size - gram + 1)
            if bits is not None:
                known = (bits[_filter_word(value)] >> (value & np.uint64(63)) & np.uint64(1)).astype(bool)
                doc, place, value = doc[known], place[known], value[known]
            reach = size - gram
            found = [([], [], []) for _ in texts]
            for d, p, v in zip(doc.tolist(), place.tolist(), value.view(np.int64).tolist()):
                around = texts[d][max(0, p - reach) : p + size]
                found[d][0].append(p)
                found[d][1].append(v)
                found[d][2].append(b" ".join(around))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([size] * len(texts), pa.int32()),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.binary())),
                ],
                ["id", "row_hash", "n_words", "size", "place", "gram", "context"],
            )

    return source.mapInArrow(run, SCHEMA.format(id=source.schema["id"].dataType.simpleString()))


def _filter_bits(grams: DataFrame) -> np.ndarray:
    """The filter of all benchmark grams; what reaches the driver is bounded by FILTER_WORDS rows."""
    word = F.pmod(F.shiftrightunsigned("gram", 6), F.lit(FILTER_WORDS))
    bit = F.expr("shiftleft(1L, CAST(gram & 63 AS INT))")
    bits = np.zeros(FILTER_WORDS, np.uint64)
    for row in grams.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return bits


def _extend(size: int, k: int, place: int, ours: list[bytes], theirs_place: int, theirs: list[bytes]):
    """The matched run (start, end) around a shared gram, or None if it is shorter than a window."""
    gram = min(k, size)
    a, b = min(place, size - gram), min(theirs_place, size - gram)  # where the gram starts in its context
    if ours[a : a + gram] != theirs[b : b + gram]:
        return None
    left, right = 0, gram
    while left < min(a, b) and ours[a - left - 1] == theirs[b - left - 1]:
        left += 1
    while right < min(len(ours) - a, len(theirs) - b) and ours[a + right] == theirs[b + right]:
        right += 1
    return (place - left, place + right) if left + right >= size else None


def _extended(pairs: DataFrame, k: int) -> DataFrame:
    kept = [f for f in pairs.schema.fields if f.name in ("id", "row_hash", "item")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("size", "place", "context", "item_place", "item_context")]
            spans = [_extend(n, k, p, c.split(b" "), q, d.split(b" ")) for n, p, c, q, d in zip(*columns)]
            hit = pa.array([s is not None for s in spans])
            out = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            out += [pa.array([s and s[i] for s in spans], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in kept] + ["first", "end"]).filter(hit)

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", first int, end int")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 10,
    k: int = 5,
) -> DataFrame:
    """(id, n_words, spans, items) of every document row.

    A window is a run of ``n`` words of an item; an item of fewer words, but not
    none, is one window. ``spans`` are the runs of document words (start, end,
    item) that hold windows of an item, each at most 2n - k words long, so longer
    matches are several overlapping spans; ``items`` are the distinct items found,
    as text. Both are empty arrays where nothing is found.

    Null and empty texts have no words. Rows with a null id are compared like any
    other. Repeated rows get the same result each; repeated items count once per
    id, and items without an id are found but not named. Empty tables on either
    side are fine. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_hash"))
    tests = items.select(
        F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"), F.xxhash64(item_text_col).alias("row_hash")
    )
    lengths = _grams(tests, [n], k, None).select(F.least("n_words", F.lit(n)).cast("int").alias("size"))
    sizes = sorted(r["size"] for r in lengths.where("size > 0").distinct().collect())  # at most n values
    spread = F.explode(F.arrays_zip("place", "gram", "context"))
    fixed = _grams(tests, sizes or [n], k, None).where(F.least("n_words", F.lit(n)) == F.col("size"))
    fixed = stage(fixed.select(F.col("id").alias("item"), "size", spread.alias("g")).select("item", "size", "g.*"), "benchmark-grams")

    bits = _filter_bits(fixed)
    seen = stage(_grams(source, sizes or [n], k, bits), "document-grams")
    place = F.explode(F.arrays_zip("place", "gram", "context"))
    ours = seen.where(F.size("gram") > 0).select("id", "row_hash", "size", place.alias("g")).select(
        "id", "row_hash", "size", "g.*", F.pmod(F.xxhash64("id", "row_hash"), F.lit(SALT)).alias("salt")
    )
    # A passage may sit in a third of all documents: its grams are spread over SALT keys.
    theirs = fixed.select(
        "item", "size", "gram", F.col("place").alias("item_place"), F.col("context").alias("item_context"),
        F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALT)])).alias("salt"),
    )
    spans = _extended(ours.join(theirs, ["gram", "size", "salt"]), k)
    found = spans.groupBy("id", "row_hash").agg(
        F.array_sort(F.collect_set(F.struct("first", "end", "item"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    every = seen.where(F.col("size") == (sizes or [n])[0]).select("id", "row_hash", "n_words")
    joined = every.alias("e").join(
        found.alias("f"), F.expr("e.id <=> f.id AND e.row_hash = f.row_hash"), "left"
    )
    return joined.select(
        F.col("e.id").alias(id_col),
        "e.row_hash",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int,item:string>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def words_hit(spans: str = "spans"):
    """Number of words inside any span."""
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["end"] - 1)))
    return F.size(F.array_distinct(places)).cast("long")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents that hold no window of any item, with all their columns.

    Rows go by id and text together, so rows that share an id are judged each by
    its own text. Null texts and null ids stay unless their text is hit.
    """
    bad = contamination(docs, items, id_col, text_col, **rules).where(F.size("spans") > 0)
    bad = bad.select(F.col(id_col).alias("id"), "row_hash").distinct()
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text_col).alias("text_hash"))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("row_hash"))
    return marked.join(bad, same, "left_anti").select("row.*")
