import random

import numpy as np
import pytest

from gapcast.llm import super_kmers
from gapcast.llm.super_kmers import _decoded, _encoded, _larger, _minimisers, _run_hashes, _slices, _word_codes, _words, drop_repeated_passages


def plain(rows, window=13):
    """Windows in a dictionary: the definition."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, kept, len(w), len(gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in df.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "\t \r\n"]).join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1].replace(" ", "\x0b\x0c")), (502, None), (503, ""), (504, " \n "), (505, "x " * 3000)]
    rows += [(506, "x " * 40), (507, "naïve\u00a0été " * 30), rows[5], (7, "another text " * 20), (None, rows[3][1]), (None, None)]
    return rows


@pytest.mark.parametrize("window", [1, 5, 13])
def test_equals_the_definition(make_docs, window):
    rows = corpus(window)
    docs = make_docs(rows)
    found = drop_repeated_passages(docs, window=window, gram=min(3, window))
    assert result(found) == plain(rows, window)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["text", "n_words", "n_removed"]


def test_small_chunks_and_buckets_in_parts(make_docs, monkeypatch):
    """Texts cut into pieces, buckets settled in parts, hot minimisers: the same rows."""
    rows = corpus(4)
    expected = plain(rows)
    docs = make_docs(rows).repartition(5)
    monkeypatch.setattr(super_kmers, "HOT_LEAST", 2)
    assert result(drop_repeated_passages(docs)) == expected
    for size in (50, 400):
        monkeypatch.setattr(super_kmers, "CHUNK", size)
        assert result(drop_repeated_passages(docs, bucket_most=100)) == expected


def test_text_ids_and_empty_tables(spark, make_docs):
    rows = corpus(8, 40)
    named = [(f"d{i:04d}" if i is not None else None, t) for i, t in rows]
    assert result(drop_repeated_passages(make_docs(named, "doc_id string, text string"))) == plain(named)
    assert drop_repeated_passages(make_docs([])).count() == 0


def test_a_very_long_word_and_text(make_docs):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(99999)}" for _ in range(200_000))
    rows = [(1, text), (2, f"{'z' * 3_000_000} {text[100:]}"), (3, "z" * 100)]
    assert result(drop_repeated_passages(make_docs(rows))) == plain(rows)


def test_slices_hold_every_window_once(monkeypatch):
    rng = random.Random(5)
    text = b" ".join(b"x" * rng.randint(1, 30) for _ in range(500)) + b"\n "
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(super_kmers, "CHUNK", size)
        seen = [(base + k, w[k : k + 13]) for base, part in _slices(text, 13) for w in [part.split()] for k in range(len(w) - 12)]
        whole = text.split()
        assert seen == [(k, whole[k : k + 13]) for k in range(len(whole) - 12)]


def test_words_codes_and_minimisers():
    flat, starts, ends = _words(b"\n one  two\x0b\tthree" + b"y" * 400 + b" one two")
    assert [flat[a:b] for a, b in zip(starts, ends)] == [b"one", b"two", b"three" + b"y" * 400, b"one", b"two"]
    codes = _word_codes(flat, starts, ends)
    assert codes[0] == codes[3] and codes[1] == codes[4] and len(set(codes.tolist())) == 3
    codes = np.random.default_rng(1).integers(0, 1 << 60, 50).astype(np.uint64)
    runs = _run_hashes(codes, 3)
    assert _minimisers(codes, 13, 3).tolist() == [min(runs[i : i + 11].tolist()) for i in range(38)]


def test_windows_with_equal_hashes_and_other_words():
    text = b"aabbaacc"
    first, last = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    gone = _larger(np.array([7, 7, 7, 7], np.uint64), np.array([1, 0, 3, 4]), text, first, last)
    assert gone.tolist() == [False, False, True, False]


@pytest.mark.parametrize("ids", [[5, -3, 2**62], ["b", "", "naïve\n"], []])
def test_documents_and_places_survive_packing(ids):
    keys = [(i, 7 - 2**k) for k, i in enumerate(ids)]
    ordinal, place = np.arange(len(ids) * 2) // 2, np.arange(len(ids) * 2) * 1000 % 777
    got = _decoded(_encoded(keys, ordinal, place))
    assert [list(g) for g in got] == [ids, [k[1] for k in keys], ordinal.tolist(), place.tolist()]
