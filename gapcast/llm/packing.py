"""Pack tokenized documents into few sequences of a fixed length.

The packing is planned on the histogram of piece lengths, which has at most as
many rows as a sequence has tokens. A configuration linear program (how often to
use each way to fill a sequence) is solved by multiplicative weights: lengths not
yet covered weigh more, and a knapsack dynamic program over the sequence finds
the filling of most weight. Neighbouring lengths form groups of equal token mass, so
that the program has a few hundred rows for any data; true lengths then take the
places of their groups. Uses are rounded down, what is left is solved again, and the
last few per cent are packed best fit, longest first, in bulk. Pieces then take the planned places by
their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapcast.llm.labelled import slices
from gapcast.llm.tables import partitions, stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
# In a text of these characters alone, the tokenizer's words can be cut out beforehand and tokenized
# one by one with the same result: none of them composes with a neighbour, changes length in lower
# case, or is a blank, letter or digit to one side only.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ſ]*").fullmatch
CUT = r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\d|[^\s\p{L}\d]+"
KNOWN_WORDS = 400_000
LONG_WORD = 64
SLICE_BYTES = 8 << 20
LEARN_ROWS = 1 << 16  # words that are tokenized in one call
PLACE_ROWS = 1 << 18  # words whose ids are put in place at a time


@dataclass
class Ids:
    """Token ids of many strings: ``size`` ids each, from ``start`` of ``flat``."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def in_a_row(cls, flat: np.ndarray, size: np.ndarray) -> Ids:
        return cls(flat, np.cumsum(size) - size, size)

    def take(self, rows: np.ndarray) -> Ids:
        return Ids(self.flat, self.start[rows], self.size[rows])

    def joined(self) -> np.ndarray:
        """All strings' ids, one after the other."""
        parts = [self.flat[:0]]
        for first in range(0, len(self.size), PLACE_ROWS):
            start, size = self.start[first : first + PLACE_ROWS], self.size[first : first + PLACE_ROWS]
            at = np.repeat(start - np.cumsum(size) + size, size)
            parts.append(self.flat[at + np.arange(len(at))])
        return np.concatenate(parts)

    def summed(self, offsets: np.ndarray) -> Ids:
        """The ids of runs of strings: run i has the strings from ``offsets[i]`` to before ``offsets[i + 1]``."""
        ends = np.append(0, np.cumsum(self.size))[offsets]
        return Ids(self.joined(), ends[:-1], np.diff(ends))


class Known:
    """Strings whose ids are known; beyond ``KNOWN_WORDS``, half of them, least lately met, are forgotten."""

    def __init__(self) -> None:
        self.strings = pa.array([], pa.string())
        self.ids = Ids.in_a_row(np.zeros(0, "<u4"), np.zeros(0, np.int64))
        self.met = np.zeros(0, np.int64)
        self.now = 0

    def look_up(self, strings: pa.StringArray, find: Callable[[pa.StringArray], Ids]) -> Ids:
        """Ids of distinct strings; ``find`` has those of the unknown ones."""
        at = pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(at < 0)
        self.now += 1
        self.met[at[at >= 0]] = self.now
        if not len(lost):
            return self.ids.take(at)
        unknown = strings.take(pa.array(lost))
        found = find(unknown)
        at[lost] = len(self.met) + np.arange(len(lost))
        both = Ids(
            np.concatenate([self.ids.flat, found.flat]),
            np.concatenate([self.ids.start, len(self.ids.flat) + found.start]),
            np.concatenate([self.ids.size, found.size]),
        )
        result = both.take(at)
        short = np.flatnonzero(pc.binary_length(unknown).to_numpy() <= LONG_WORD)[: KNOWN_WORDS // 2]
        kept = np.concatenate([np.arange(len(self.met)), len(self.met) + short])
        self.strings = pa.concat_arrays([self.strings, unknown.take(pa.array(short))])
        self.met = np.concatenate([self.met, np.full(len(short), self.now)])
        if len(kept) > KNOWN_WORDS:
            lately = np.sort(np.argsort(-self.met, kind="stable")[: KNOWN_WORDS // 2])
            self.strings, self.met, kept = self.strings.take(pa.array(lately)), self.met[lately], kept[lately]
        self.ids = Ids.in_a_row(both.take(kept).joined(), both.size[kept]) if len(kept) < len(both.size) else both
        return result


class WordIds:
    """Ids of texts by the tokenizer.

    A plain text is cut at blanks, and every distinct string between blanks is looked up
    once a call. An unknown one is cut into the tokenizer's words, which are looked up
    likewise; unknown words are tokenized.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.strings, self.words = Known(), Known()
        # Only a tokenizer that marks the ends of words and drops blanks can be fed word by word.
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            # Words cut out of plain texts are in normal form and need no further cutting.
            self.by_word = Tokenizer(self.tokenizer.model)
            self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), self.tokenizer.pre_tokenizer[1]])
        self.suffix = suffix

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: pa.StringArray) -> Ids:
        """Ids of words that ``CUT`` has cut out, or of the empty string."""
        flat, size = [], (pc.binary_length(words).to_numpy() > 0).astype(np.int64)
        rows = np.flatnonzero(size)
        for first in range(0, len(rows), LEARN_ROWS):
            own = rows[first : first + LEARN_ROWS]
            text = " ".join(words.take(pa.array(own)).to_pylist())
            ids = np.array(self.by_word.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            size[own] = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            flat.append(ids)
        return Ids.in_a_row(np.concatenate([self.words.ids.flat[:0], *flat]), size)

    def cut(self, strings: pa.StringArray) -> Ids:
        """Ids of strings without blanks, by their words."""
        return self.distinct(pc.replace_substring_regex(strings, CUT, r"\0 "), self.words, self.learn)

    def distinct(self, texts: pa.StringArray, known: Known, find: Callable[[pa.StringArray], Ids]) -> Ids:
        """Ids of texts, by the distinct strings between their blanks."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.values.dictionary_encode()
        return known.look_up(coded.dictionary, find).take(coded.indices.to_numpy()).summed(parts.offsets.to_numpy())

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """The tokenizer's ids of whole texts; special tokens are left to the tokenizer."""
        plain = [bool(t and self.suffix and "<|" not in t and PLAIN(t)) for t in texts]
        found = self.distinct(pa.array([t.lower() if p else "" for t, p in zip(texts, plain)], pa.string()), self.strings, self.cut)
        starts, ends = found.start.tolist(), (found.start + found.size).tolist()
        return [found.flat[a:b].tobytes() if p else self.encode(t) if t else b"" for t, p, a, b in zip(texts, plain, starts, ends)]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words that this worker process knows; tasks that follow each other share them."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def tokenized_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 4096,
    tokenizer_path: str = TOKENIZER,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's ids, with the end id, cut at ``length``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    width, end = 4 * length, np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            for part, texts in slices(batch, 1, SLICE_BYTES):
                rows, pieces = [], []
                for row, ids in enumerate(words.documents(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        own = ids[at : at + width]
                        rows.append(row)
                        pieces.append((piece, at // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*pieces))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *arrays[: len(names) - 1]], names)

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return source.mapInArrow(run, schema)


@dataclass
class Filling:
    """``copies`` sequences filled alike: (length, how many) in order, and the space left."""

    parts: list[tuple[int, int]]
    copies: int
    space: int


def best_filling(values: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack over the capacity: the multiset of lengths of most value. ``values[l]`` is the worth of length l.

    No length is below the shortest, so that many capacities are settled at a time.
    """
    lengths = np.flatnonzero(values)
    block, worth = int(lengths[0]), values[lengths]
    pad = int(lengths[-1])  # capacities below zero, worth nothing at all
    best, last = np.full(pad + capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[pad : pad + block] = 0.0
    for start in range(block, capacity + 1, block):
        rows = np.arange(start, min(start + block, capacity + 1))
        reach = best[pad + rows[:, None] - lengths] + worth
        which = reach.argmax(axis=1)
        most = reach[np.arange(len(rows)), which]
        upto = np.maximum.accumulate(np.append(best[pad + start - 1], most))
        best[pad + rows] = upto[1:]
        last[rows] = np.where(most > upto[:-1], lengths[which], 0)
    chosen: dict[int, int] = {}
    c = capacity
    while c > 0:
        if last[c]:
            chosen[int(last[c])] = chosen.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return chosen


@dataclass
class Groups:
    """Neighbouring lengths that the linear program takes for one: ``size`` stands for the lengths of ``low`` to ``high``."""

    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pieces: np.ndarray


def length_groups(counts: np.ndarray, shortest: int, groups: int) -> Groups:
    """At most ``groups`` (and a few) runs of lengths of about equal token mass, each standing at its mean length."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths >= shortest]
    mass = np.cumsum(lengths * counts[lengths])
    run = (mass - lengths * counts[lengths]) * groups // max(int(mass[-1]), 1) if len(mass) else mass
    first = np.flatnonzero(np.diff(run, prepend=-1))
    pieces = np.add.reduceat(counts[lengths], first) if len(first) else mass
    mean = np.add.reduceat(lengths * counts[lengths], first) / pieces if len(first) else mass
    ends = np.append(first[1:], len(lengths)) - 1
    return Groups(np.rint(mean).astype(np.int64), lengths[first], lengths[ends], pieces)


def fractional_fillings(
    sizes: np.ndarray, pieces: np.ndarray, capacity: int, power: float = 1.5, heat: float = 2.0, stride: float = 0.25
) -> list[tuple[dict[int, int], float]]:
    """Fillings with their fractional use that cover all ``pieces`` of the distinct ``sizes``; the fullest first.

    Multiplicative weights: a round raises the use of the filling that is worth most
    by ``stride`` of what its scarcest size allows, or by what that size still lacks.
    A size is worth exp(-heat x covered share), times a power of its tokens above one:
    long pieces are the hard ones to place. Every round covers one size by a further
    ``stride`` or in full, so (1 / stride + 1) rounds a size cover everything.
    """
    counts = np.zeros(capacity + 1)
    counts[sizes] = pieces
    covered, value = np.zeros(capacity + 1), np.arange(capacity + 1.0) ** power
    used: dict[tuple, float] = {}
    open_ = counts > 0
    while open_.any():
        values = np.zeros(capacity + 1)
        values[open_] = np.exp(-heat * covered[open_] / counts[open_]) * value[open_]
        filling = best_filling(values, capacity)
        step, scarce = min((min(stride * counts[n], counts[n] - covered[n]) / m, n) for n, m in filling.items())
        key = tuple(sorted(filling.items(), reverse=True))
        used[key] = used.get(key, 0.0) + step
        for n, m in filling.items():
            covered[n] += step * m
        if covered[scarce] >= counts[scarce] * (1 - 1e-9):
            covered[scarce], open_[scarce] = counts[scarce], False
    fullest = sorted(used.items(), key=lambda f: (-sum(n * m for n, m in f[0]), f[0]))
    return [(dict(k), x) for k, x in fullest]


def _nearest(there: np.ndarray, target: int) -> int:
    """The number nearest to a target, or 0 if there is none."""
    return int(there[np.abs(there - target).argmin()]) if len(there) else 0


def _last_two(left: np.ndarray, space: int, waste: int, target: int) -> tuple[int, int] | None:
    """Two lengths left that fill a space, but for ``waste`` at most; the first near a target."""
    for total in range(space, max(space - waste, 2) - 1, -1):
        both = (left[1:total] > 0) & (left[total - 1 : 0 : -1] > 0)
        if total % 2 == 0 and left[total // 2] < 2:
            both[total // 2 - 1] = False
        if first := _nearest(np.flatnonzero(both) + 1, target):
            return first, total - first
    return None


def _placed(filling: dict[int, int], copies: int, group: dict[int, tuple[int, int]], left: np.ndarray, waste: int) -> list[Filling]:
    """Sequences that follow a filling, with true lengths taken out of ``left``.

    Every place takes a length of its group, so chosen that the sequence keeps to the
    filling's sizes, or the nearest one if the group is used up; the last two take the
    lengths near theirs that fill the space best. As many copies are made at a time as
    the scarcest length allows, so a length is used up or the filling done. Sequences
    that would leave more than ``waste`` are not made.
    """
    capacity = len(left) - 1
    order = [n for n, m in sorted(filling.items(), reverse=True) for _ in range(m)]
    done: list[Filling] = []
    while copies:
        taken: list[int] = []
        ahead = 0
        for n in order[:-2]:
            low, high = group[n]
            own = np.flatnonzero(left[low : high + 1]) + low
            length = _nearest(own if len(own) else np.flatnonzero(left), n - ahead)
            taken.append(length)
            left[length] -= 1
            ahead += length - n
        space = capacity - sum(taken)
        if len(order) == 1:
            ends = np.flatnonzero(left[capacity - waste :]) + capacity - waste
            last = (int(ends[-1]),) if len(ends) else None
        else:
            last = _last_two(left, space, waste, order[-2] - ahead) if all(taken) else None
        for n in taken:
            left[n] += 1
        if last is None:
            break
        parts = Counter([*taken, *last])
        many = min([copies, *(int(left[n]) // m for n, m in parts.items())])
        for n, m in parts.items():
            left[n] -= many * m
        done.append(Filling(sorted(parts.items(), reverse=True), many, space - sum(last)))
        copies -= many
    return done


def linear_plan(counts: np.ndarray, capacity: int, groups: int, power: float = 1.5, waste: float = 0.01, passes: int = 6) -> tuple[list[Filling], np.ndarray]:
    """What the linear program packs, and the pieces left by length.

    Uses of fillings are rounded down. What that leaves over is a smaller histogram:
    it is solved again, with fewer groups, so that the part lost to rounding shrinks.
    Pieces of less than a 64th of the capacity are left to fill gaps.
    """
    left = counts.astype(np.int64).copy()
    done: list[Filling] = []
    shortest, size = max(1, capacity // 64), np.arange(len(counts))
    for _ in range(passes):
        tokens = int((left * size)[shortest:].sum())
        few = min(groups, tokens // capacity // 2)  # fillings enough that most are used more than once
        if few < 1:
            break
        g = length_groups(left, shortest, few)
        bounds = {int(n): (int(a), int(b)) for n, a, b in zip(g.size, g.low, g.high)}
        before = len(done)
        for filling, use in fractional_fillings(g.size, g.pieces, capacity, power):
            if copies := int(use + 1e-6):
                done += _placed(filling, copies, bounds, left, int(waste * capacity))
        if len(done) == before:
            break
    return done, left


def plan(counts: np.ndarray, capacity: int, groups: int = 200) -> list[Filling]:
    """Fillings that hold every piece of the histogram ``counts`` (by length) exactly once.

    The linear program's sequences that waste no more than a share stay, and best fit
    packs the rest. The share with the fewest sequences wins. With 0 groups all is
    packed best fit.
    """
    made, rest = linear_plan(counts, capacity, groups)
    plans = []
    for waste in (capacity // 100, capacity // 1000, 0):
        left = rest.copy()
        for f in made:
            for n, m in f.parts if f.space > waste else ():
                left[n] += m * f.copies
        plans.append(_best_fit(left, capacity, [f for f in made if f.space <= waste]))
    return min(plans, key=lambda p: sum(f.copies for f in p))


def _best_fit(left: np.ndarray, capacity: int, opened: list[Filling]) -> list[Filling]:
    """Best fit, longest first, for all pieces of a length at once."""
    by_space: dict[int, list[Filling]] = {}
    spaces: list[int] = []

    def put(f: Filling) -> None:
        if f.space not in by_space:
            by_space[f.space] = []
            insort(spaces, f.space)
        by_space[f.space].append(f)

    for f in opened:
        put(f)
    for n in np.flatnonzero(left)[::-1].tolist():
        need = int(left[n])
        while need:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                f = Filling([], -(-need // (capacity // n)), capacity)
            else:
                f = by_space[spaces[at]].pop()
                if not by_space[f.space]:
                    del by_space[f.space]
                    del spaces[at]
            each = f.space // n
            full = min(f.copies, need // each)
            if full:
                put(Filling([*f.parts, (n, each)], full, f.space - n * each))
            need -= full * each
            rest = f.copies - full
            if rest and need:  # fewer than one filling's worth, or no copy left
                some = min(each, need)
                put(Filling([*f.parts, (n, some)], 1, f.space - n * some))
                need -= some
                rest -= 1
            if rest and f.parts:
                put(Filling(f.parts, rest, f.space))
    return [f for space in spaces for f in by_space[space]]


def places(fillings: list[Filling]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), sorted: where pieces go by rank."""
    rows, taken, sequence = [], {}, 0
    for f in fillings:
        offset = 0
        for length, many in f.parts:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, many, offset))
            taken[length] = rank + f.copies * many
            offset += length * many
        sequence += f.copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of every piece among those of its length, counted from 0.

    A length may hold a third of all pieces, so they are ranked within buckets
    (hashes of the piece) and the buckets' counts are added up before.
    """
    own = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(partitions(pieces.sparkSession)))
    pieces = pieces.withColumn("bucket", own)
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("row", F.row_number().over(order) - 1)
    return ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("row")).drop("bucket", "row", "before")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 4096,
    tokenizer_path: str = TOKENIZER,
    groups: int = 200,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    A document is its ids and an end id. Only documents longer than ``length``
    are cut, into pieces of that length and a shorter last one. Sequences are
    filled from offset 0 without gaps and hold at most ``length`` ids.

    Null and empty texts are one piece, the end id. A null id is kept; repeated
    rows are documents of their own. An empty table has no pieces. Other columns
    are not read. The plan has one row per length and kind of filling: its size
    depends on ``length``, not on the documents.
    """
    pieces = stage(tokenized_pieces(docs, id_col, text_col, length, tokenizer_path, keep_ids), "pieces")
    counts = np.zeros(length + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``length`` rows
        counts[row["length"]] = row["n"]
    table = places(plan(counts, length, groups))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = _ranked(pieces)
    schema = ranked.schema.names

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(schema.index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (size << 45) + rank, side="right") - 1]
            sequence, place = np.divmod(rank - row[:, 1], row[:, 3])
            added = [pa.array(row[:, 2] + sequence), pa.array(row[:, 4] + place * size)]
            kept = [batch.column(schema.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*names, "sequence_id", "offset"])

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id_col)
