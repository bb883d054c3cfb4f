"""Remove passages that documents share, by partitioning super-k-mers.

A k-mer is a window of ``window`` consecutive words, its minimiser the smallest
hash of the runs of ``gram`` words in it. Consecutive windows with one minimiser
travel together as one string of words, a super-k-mer, to the bucket of that
minimiser, where windows are sorted and compared word by word: equal windows
always meet, and a text is shipped about three times over, not ``window`` times.

Every task first settles what its own documents show: a window that starts in
two of them is removed from the larger one at once, and only the smallest
document goes on. A passage that a third of all documents share thus costs one
string per task. Minimisers with a large share of all windows are found on a
bounded sample; their windows travel alone, each to the bucket of its own hash.
The sample steers the routing only: results do not depend on it. A bucket that
outgrows its bound is settled in parts, and the windows left over meet in an
exchange of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.llm.tables import partitions, stage

# Bytes of text settled at a time by a mapping task.
CHUNK = 4 << 20
# Bytes of packed strings a bucket should hold, and at most holds in memory.
BUCKET, BUCKET_MOST = 16 << 20, 48 << 20
# What buckets hold for a byte of text, about.
GROWTH = 3.2
# Windows in one super-k-mer at most (a repeated minimiser could go on without end).
LONGEST = 64
# Bytes of text that the search for hot minimisers reads, and how many it names at most.
SAMPLE, HOT_MOST, HOT_LEAST = 32 << 20, 10_000, 32
LONG_WORD = 256
_EIGHT = np.array([0, *[(1 << 8 * i) - 1 for i in range(1, 8)], (1 << 64) - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with one space after each word, and the words' first and end places.

    Blanks are 0x20 and 0x09 to 0x0D.
    """
    data = np.frombuffer(text, np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    flat = np.where(solid, data, np.uint8(32))[kept]
    if len(data) and solid[-1]:
        flat = np.append(flat, np.uint8(32))
    ends = np.flatnonzero(flat == 32)
    return flat.tobytes(), np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


def _word_codes(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, eight bytes at a time."""
    eights = np.ndarray((len(flat),), np.uint64, flat + b"\0" * 8, strides=(1,)) if flat else np.zeros(0, np.uint64)
    length = ends - starts
    codes = _mix(length.astype(np.uint64))
    short = length <= LONG_WORD
    live, done = np.flatnonzero(short), 0
    while len(live):
        block = eights[starts[live] + done] & _EIGHT[np.minimum(length[live] - done, 8)]
        codes[live] = _mix(codes[live] ^ block)
        done += 8
        live = live[length[live] > done]
    for i in np.flatnonzero(~short).tolist():
        codes[i] = xxhash.xxh64_intdigest(flat[starts[i] : ends[i]])
    return codes


def _run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of k words."""
    n = max(len(codes) - k + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for i in range(k if n else 0):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return _mix(mixed)


def _minimisers(codes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest hash of a run of ``gram`` words in each window."""
    least, span, left = _run_hashes(codes, gram), 1, window - gram + 1
    while span < left:  # minima of spans that double
        step = min(span, left - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def _larger(hashes: np.ndarray, ranks: np.ndarray, text: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks the windows whose words also start under a smaller rank.

    Windows are sorted by hash, then by rank; those that would go are compared with
    the first of their hash byte by byte, and if two texts share a hash, by text.
    """
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    member = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    gone = np.zeros(len(hashes), bool)
    if not len(member):
        return gone
    member = member[np.lexsort((ranks[member], hashes[member]))]
    turn = np.concatenate([[True], hashes[member][1:] != hashes[member][:-1]])
    head = member[np.flatnonzero(turn)][np.cumsum(turn) - 1]
    larger = ranks[member] > ranks[head]
    member_gone, head_of = member[larger], head[larger]
    places = (first[member_gone], last[member_gone], first[head_of], last[head_of])
    differ = [text[a:b] != text[c:d] for a, b, c, d in zip(*(p.tolist() for p in places))]
    gone[member_gone] = True
    for value in np.unique(hashes[member_gone[np.array(differ, bool)]]):
        least: dict[bytes, int] = {}
        group = [(i, text[first[i] : last[i]]) for i in member[hashes[member] == value].tolist()]
        for i, words in group:
            least[words] = min(least.get(words, ranks[i]), ranks[i])
        for i, words in group:
            gone[i] = ranks[i] > least[words]
    return gone


def _spans(owner: np.ndarray, start: np.ndarray, window: int) -> Iterator[tuple[int, list[int]]]:
    """(owner, [first, end, first, end, ...]) of the words that windows at ``start`` cover."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if not len(owner):
        return
    turn = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + window)])
    at = np.flatnonzero(turn)
    firsts, lasts = start[at], start[np.concatenate([at[1:], [len(start)]]) - 1] + window
    own = owner[at]
    bounds = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
    both = np.stack([firsts, lasts], axis=1)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield int(own[a]), both[a:b].ravel().tolist()


def _planes(values: np.ndarray) -> bytes:
    """Differences of numbers, all their lowest bytes first: compresses well."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8, n * 8).reshape(8, -1).T.copy().view("<i8").ravel())


def _encoded(keys: list[tuple], ordinal: np.ndarray, place: np.ndarray) -> bytes:
    """Documents (id, row hash) of a bucket's strings, and per string its document and place."""
    named = bool(keys) and isinstance(keys[0][0], str)
    texts = [k[0].encode() for k in keys] if named else []
    ids = np.array([len(t) for t in texts] if named else [k[0] for k in keys], np.int64)
    head = np.array([len(keys), len(ordinal), named], np.int64).tobytes()
    return b"".join([head, _planes(ids), np.array([k[1] for k in keys], np.int64).tobytes(), _planes(ordinal), _planes(place), *texts])


def _decoded(data: bytes) -> tuple[list, list, np.ndarray, np.ndarray]:
    """(ids, row hashes, documents of the strings, places of the strings)."""
    docs, strings, named = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + np.cumsum([0, docs * 8, docs * 8, strings * 8, strings * 8])
    ids = _from_planes(data[at[0] : at[1]], docs).tolist()
    if named:
        ends = np.cumsum(ids) + at[4]
        ids = [data[e - n : e].decode() for e, n in zip(ends.tolist(), ids)]
    rows = np.frombuffer(data[at[1] : at[2]], np.int64).tolist()
    return ids, rows, _from_planes(data[at[2] : at[3]], strings), _from_planes(data[at[3] : at[4]], strings)


def _ranks(ids: list) -> np.ndarray:
    """Ranks of ids in their order; equal ids share one."""
    known = {v: i for i, v in enumerate(sorted(set(ids)))}
    return np.fromiter((known[v] for v in ids), np.int64, len(ids))


@dataclass
class _Chunk:
    """Pieces of documents that one task settles together."""

    window: int
    gram: int
    buckets: int
    hot: np.ndarray
    rows: dict = field(default_factory=dict)
    pieces: list = field(default_factory=list)
    volume: int = 0

    def add(self, key: tuple, base: int, text: bytes) -> None:
        self.pieces.append((self.rows.setdefault(key, len(self.rows)), base, text))
        self.volume += len(text) + 1

    def windows(self):
        """flat text, word places, and per window: first word, row, place in the row, hash, minimiser."""
        parts = [_words(text) for _, _, text in self.pieces]
        flat = b"".join(p[0] for p in parts)
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        starts = np.concatenate([p[1] + s for p, s in zip(parts, shift)]).astype(np.int64)
        ends = np.concatenate([p[2] + s for p, s in zip(parts, shift)]).astype(np.int64)
        counts = np.array([len(p[1]) for p in parts])
        piece = np.repeat(np.arange(len(parts)), counts)
        codes = _word_codes(flat, starts, ends)
        hashes, least = _run_hashes(codes, self.window), _minimisers(codes, self.window, self.gram)
        at = np.flatnonzero(piece[: len(hashes)] == piece[self.window - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        owner = np.array([p[0] for p in self.pieces])[piece[at]]
        begun = np.cumsum(counts) - counts
        place = at - begun[piece[at]] + np.array([p[1] for p in self.pieces], np.int64)[piece[at]]
        return flat, starts, ends, at, owner, place, hashes[at], least[at]

    def settled(self) -> Iterator[tuple]:
        """Rows (bucket, ids, row hashes, meta, packed) for the exchange.

        Words to remove (one id, one row hash, spans as meta), or packed strings
        with their documents and places as meta.
        """
        keys = list(self.rows)
        ranks = _ranks([k[0] for k in keys])
        flat, starts, ends, at, owner, place, hashes, least = self.windows()
        gone = _larger(hashes, ranks[owner], flat, starts[at], ends[at + self.window - 1])
        for row, spans in _spans(owner[gone], place[gone], self.window):
            yield row % self.buckets, [keys[row][0]], [keys[row][1]], np.array(spans, np.int32).tobytes(), None
        hot = np.isin(least, self.hot)
        route = np.where(hot, hashes, least)
        open_ = np.flatnonzero(~gone)
        if len(open_):
            yield from self._packed(keys, flat, starts, ends, at[open_], owner[open_], place[open_], route[open_])

    def _packed(self, keys, flat, starts, ends, at, owner, place, route) -> Iterator[tuple]:
        turn = np.concatenate([[True], (route[1:] != route[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
        run = np.flatnonzero(turn)
        lengths = np.diff(np.concatenate([run, [len(at)]]))
        if (long := lengths > LONGEST).any():
            more = [np.arange(a + LONGEST, a + n, LONGEST) for a, n in zip(run[long].tolist(), lengths[long].tolist())]
            run = np.sort(np.concatenate([run, *more]))
            lengths = np.diff(np.concatenate([run, [len(at)]]))
        bucket = (_mix(route[run]) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        run, bucket, lengths = run[order], bucket[order], lengths[order]
        first, last = starts[at[run]], ends[at[run] + lengths + self.window - 2]
        strings = [flat[a:b] for a, b in zip(first.tolist(), last.tolist())]
        pack = zstandard.ZstdCompressor(level=5).compress
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own, ordinal = np.unique(owner[run[a:b]], return_inverse=True)
            meta = _encoded([keys[i] for i in own.tolist()], ordinal, place[run[a:b]])
            yield int(bucket[a]), None, None, pack(meta), pack(b"\n".join(strings[a:b]))


def _slices(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(place of the first word, text) of parts of a text that hold each of its windows once."""
    begin, base, tail = 0, 0, b""
    while True:
        end = begin + CHUNK
        while end < len(text) and not text[end : end + 1].isspace():
            nearest = [p for p in (text.find(b, end, end + CHUNK) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if p >= 0]
            end = min(nearest) if nearest else end + CHUNK
        part = tail + text[begin:end]
        yield base, part
        if end >= len(text):
            return
        tokens = part.split()
        base += max(0, len(tokens) - window + 1)
        tail = b" ".join(tokens[-(window - 1) :]) if window > 1 else b""
        begin = end


def _chunks(batches: Iterator[pa.RecordBatch], new: Callable[[], _Chunk]) -> Iterator[_Chunk]:
    """Rows (id, row hash, text) in chunks of about CHUNK bytes; longer texts are cut."""
    chunk = new()
    for batch in batches:
        for key, row_hash, text in zip(*(batch.column(i) for i in range(3))):
            row = (key.as_py(), row_hash.as_py())
            if row in chunk.rows:  # a repeated row adds nothing to its first copy
                continue
            for base, part in _slices(text.as_buffer().to_pybytes(), window=chunk.window):
                if chunk.volume and chunk.volume + len(part) > CHUNK:
                    yield chunk
                    chunk = new()
                chunk.add(row, base, part)
    if chunk.pieces:
        yield chunk


def _mapped(source: DataFrame, window: int, gram: int, buckets: int, hot: np.ndarray, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, lambda: _Chunk(window, gram, buckets, hot)):
            rows = list(chunk.settled())
            for i in range(0, len(rows), 4096):
                columns = zip(*rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kind = pa.int64() if id_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
    schema = pa.schema(
        [("bucket", pa.int64()), ("ids", pa.list_(kind)), ("rows", pa.list_(pa.int64())), ("meta", pa.binary()), ("packed", pa.binary())]
    )
    name = "bigint" if kind == pa.int64() else "string"
    return source.mapInArrow(run, f"bucket bigint, ids array<{name}>, rows array<bigint>, meta binary, packed binary")


@dataclass
class _Bucket:
    """Super-k-mers of one bucket, as many as fit in memory."""

    window: int
    ids: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    owners: list = field(default_factory=list)
    places: list = field(default_factory=list)
    hashes: list = field(default_factory=list)
    firsts: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    volume: int = 0

    def add(self, meta: bytes, packed: bytes) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        text, (ids, rows, ordinal, place) = unpack(packed), _decoded(unpack(meta))
        starts, ends, breaks = self._places(text)
        codes = _word_codes(text, starts, ends)
        string = np.searchsorted(breaks, starts)
        hashes = _run_hashes(codes, self.window)
        at = np.flatnonzero(string[: len(hashes)] == string[self.window - 1 :])
        begun = np.searchsorted(string, np.arange(len(ordinal)))
        own = string[at]
        self.owners.append(ordinal[own] + len(self.ids))
        self.places.append(place[own] + at - begun[own])
        self.hashes.append(hashes[at])
        self.firsts.append(starts[at] + self.volume)
        self.lengths.append((ends[at + self.window - 1] - starts[at]).astype(np.int32))
        self.ids += ids
        self.rows += rows
        self.texts.append(text)
        self.volume += len(text)

    @staticmethod
    def _places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        ends = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))
        return np.concatenate([[0], ends[:-1] + 1]), ends, np.flatnonzero(data == 10)

    def settled(self, whole: bool) -> Iterator[tuple]:
        """Rows (id, row hash, spans, window): words to remove, or with a window, words to remove if a smaller document has it."""
        if not self.ids:
            return
        text = b"".join(self.texts)
        owner, place, hashes, first, length = map(np.concatenate, (self.owners, self.places, self.hashes, self.firsts, self.lengths))
        last = first + length
        gone = _larger(hashes, _ranks(self.ids)[owner], text, first, last)
        for row, spans in _spans(owner[gone], place[gone], self.window):
            yield self.ids[row], self.rows[row], spans, None
        if whole:
            return
        left = np.flatnonzero(~gone)
        left = left[np.lexsort((owner[left], hashes[left]))]
        for i in left.tolist():
            yield self.ids[owner[i]], self.rows[owner[i]], [int(place[i]), int(place[i]) + self.window], text[first[i] : last[i]]


def _reduced(dealt: DataFrame, window: int, most: int) -> DataFrame:
    kind = dealt.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, number, parts = _Bucket(window), None, 0
        for batch in batches:
            for record in zip(*(batch.column(i) for i in range(5))):
                bucket, ids, hashes, meta, packed = (v.as_py() for v in record)
                if packed is None:
                    rows.append((ids[0], hashes[0], np.frombuffer(meta, np.int32).tolist(), None))
                else:
                    if bucket != number:
                        rows += held.settled(parts == 0)
                        held, number, parts = _Bucket(window), bucket, 0
                    elif held.volume >= most:
                        yield from out(held.settled(False))
                        held, parts = _Bucket(window), parts + 1
                    held.add(meta, packed)
                if len(rows) >= 4096:
                    yield from out(rows)
                    rows = []
        yield from out(rows)
        yield from out(held.settled(parts == 0))

    def out(rows) -> Iterator[pa.RecordBatch]:
        rows = iter(rows)
        while part := [r for _, r in zip(range(4096), rows)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    arrow = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("id", arrow), ("row_hash", pa.int64()), ("spans", pa.list_(pa.int32())), ("words", pa.binary())])
    return dealt.mapInArrow(run, f"id {kind}, row_hash bigint, spans array<int>, words binary")


def _hot_minimisers(source: DataFrame, volume: int, window: int, gram: int, buckets: int) -> np.ndarray:
    """Minimisers that hold a large share of the windows of a sample of about SAMPLE bytes."""
    share = min(1.0, SAMPLE / max(volume, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, lambda: _Chunk(window, gram, 1, np.zeros(0, np.uint64))):
            least, count = np.unique(chunk.windows()[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(count)], ["least", "n"])

    counted = source.sample(share, seed=11).mapInArrow(run, "least bigint, n bigint").groupBy("least").agg(F.sum("n").alias("n"))
    enough = max(HOT_LEAST, int(min(volume, SAMPLE) / 6 / (8 * buckets)))
    rows = counted.where(F.col("n") >= enough).orderBy(F.desc("n"), "least").limit(HOT_MOST).collect()
    return np.array([r["least"] for r in rows], np.int64).view(np.uint64)


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    gram: int = 3,
    bucket_bytes: int = BUCKET,
    bucket_most: int = BUCKET_MOST,
) -> DataFrame:
    """(id, row_hash, spans): words to remove per text, as first and end places laid in a row.

    ``row_hash`` is xxhash64 of the text. Spans of one text may overlap.
    """
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    source = source.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-int(volume * GROWTH) // bucket_bytes))
    hot = _hot_minimisers(source, volume, window, gram, buckets)
    mapped = _mapped(source, window, gram, buckets, hot, id_type)
    dealt = mapped.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = stage(_reduced(dealt, window, bucket_most), "repeated-windows")
    # Windows of buckets that were settled in parts: one row per part and document, dealt by their words.
    least = F.min("id").over(Window.partitionBy("words"))
    rest = found.where("words IS NOT NULL").withColumn("least", least).where("id > least")
    return found.where("words IS NULL").select("id", "row_hash", "spans").unionByName(rest.select("id", "row_hash", "spans"))


def _without(text: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    tokens = text.split()
    if not spans:
        return b" ".join(tokens), len(tokens), 0
    gone = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(gone, np.asarray(spans[::2]), 1)
    np.add.at(gone, np.asarray(spans[1::2]), -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([tokens[i] for i in kept.tolist()]), len(tokens), len(tokens) - len(kept)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents with ``text_col`` cleaned, and columns n_words and n_removed.

    Words are runs of anything but ASCII blanks, as they are. A word goes where a
    window of ``window`` words that covers it also starts in a document with a
    smaller id. All windows are judged on the input. The words left are joined by
    one space. Other columns stay, but for older ones named n_words and n_removed,
    which are replaced.

    Null and empty text have no words and become the empty text. Texts shorter
    than a window lose nothing. Ids are whole numbers or strings. Rows without an
    id lose nothing and remove nothing. Rows that share an id are one document, so
    none removes words of another. An empty table gives an empty table.
    """
    spans = repeated_spans(docs, id_col, text_col, **rules)
    spans = spans.groupBy("id", "row_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    left = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"), F.struct(*rest).alias("rest")
    )
    joined = left.join(spans, ["id", "row_hash"], "left").select("rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_without((t.as_py() or "").encode(), s.as_py()) for t, s in zip(batch.column(1), batch.column(2))]
            text, n, gone = zip(*made) if made else ((), (), ())
            arrays = [batch.column(0), pa.array([t.decode() for t in text], pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["rest", "text", "n_words", "n_removed"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")]
    cleaned = joined.mapInArrow(run, T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), *counts]))
    return cleaned.select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], F.col("text").alias(text_col), "n_words", "n_removed")
