import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapcast.llm import packing
from gapcast.llm.packing import TOKENIZER, best_filling, fractional_fillings, linear_plan, pack_documents, plan, word_ids

CHARACTERS = "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x180), 9, 10, 13])) + "'stredmvl  " * 8


def test_ids_equal_the_tokenizer():
    rng = random.Random(5)
    texts = ["".join(rng.choices(CHARACTERS, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["it's 'S' they'LL", "a<|endoftext|>b", "İstanbul x² ½", "\x0b\x1c\x85\xa0a", "é ﬁ 漢字 ①", "_a__'s", "q" * 500, "", None]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(texts, word_ids(TOKENIZER).documents(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_plain_texts_are_tokenized_by_distinct_words(monkeypatch):
    """Plain texts never go to the tokenizer whole, and a word that every call meets goes there once, however full the memory is."""
    for name, value in [("KNOWN_WORDS", 60), ("LEARN_ROWS", 7), ("PLACE_ROWS", 5)]:
        monkeypatch.setattr(packing, name, value, raising=False)
    words, learnt, whole = packing.WordIds(TOKENIZER), [], []
    learn, encode = words.learn, words.encode
    monkeypatch.setattr(words, "learn", lambda new: (learnt.extend(map(str, new)), learn(new))[1])
    monkeypatch.setattr(words, "encode", lambda text: (whole.append(text), encode(text))[1])
    rng = random.Random(7)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for call in range(12):
        texts = ["Größe, größe! (größe) it's " + " ".join("".join(rng.choices("aeiouß'1", k=rng.randint(1, 90))) for _ in range(9)) for _ in range(5)]
        for text, ids in zip(texts, words.documents([*texts, None, "", " \n "])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not whole and learnt.count("größe") == 1


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for text, ids in zip(texts := ["Two words, it's", " a  b\n"], word_ids(path).documents(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(docs, rows, length):
    """No piece is lost or changed, sequences are gapless and not too long."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = []
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, n, at, len(own := ids[at : at + length]), zlib.crc32(own.tobytes())) for n, at in enumerate(range(0, len(ids), length))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert ends[r["sequence_id"]] <= length
    return len(ends)


def test_documents_are_packed_whole(make_docs):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "Größe", "x", "naïveté"], k=rng.choice([1, 5, 30, 70])))) for i in range(80)]
    docs += [(90, None), (91, ""), (None, "no id"), docs[0], docs[0], (0, "again"), (92, "long " * 500)]
    rows = pack_documents(make_docs(docs), length=64, keep_ids=True).collect()
    sequences = check_packing(docs, rows, 64)
    assert sequences <= -(-sum(r["length"] for r in rows) // 64) + 3
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert pack_documents(make_docs([]), length=64).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    sizes = [rng.integers(1, 101, 2000), rng.integers(30, 60, 500), np.full(77, 34), rng.choice([26, 49, 51, 74], 400)][seed]
    counts = np.bincount(sizes, minlength=capacity + 1)
    fillings = plan(counts, capacity, 60)
    back = np.zeros_like(counts)
    for f in fillings:
        assert sum(n * m for n, m in f.parts) + f.space == capacity and f.space >= 0 and f.copies > 0
        for n, m in f.parts:
            back[n] += m * f.copies
    assert (back == counts).all()
    used = sum(f.copies for f in fillings)
    bound = [-(-sizes.sum() // capacity), None, 39, None][seed]
    assert bound is None or used <= bound * 1.02 + 2
    assert used <= sum(f.copies for f in plan(counts, capacity, 0))  # no worse than best fit alone


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    values = np.zeros(31)
    values[[3, 7, 8, 13]] = rng.random(4)
    best = {0: 0.0}
    for c in range(1, 31):
        best[c] = max([best[c - 1], *(best[c - n] + values[n] for n in (3, 7, 8, 13) if n <= c)])
    chosen = best_filling(values, 30)
    assert sum(n * m for n, m in chosen.items()) <= 30
    assert sum(values[n] * m for n, m in chosen.items()) == pytest.approx(best[30])


def test_uses_cover_every_size():
    rng = np.random.default_rng(9)
    sizes = np.unique(rng.integers(20, 500, 60))
    pieces = rng.integers(1, 200, len(sizes))
    fillings = fractional_fillings(sizes, pieces, 1000)
    covered = {n: sum(f.get(n, 0) * use for f, use in fillings) for n in sizes.tolist()}
    assert [covered[n] for n in sizes.tolist()] == pytest.approx(pieces.tolist())
    assert all(sum(n * m for n, m in f.items()) <= 1000 for f, _ in fillings)
    used, bound = sum(use for _, use in fillings), (sizes * pieces).sum() / 1000
    assert bound <= used <= 1.02 * bound
    assert fractional_fillings(sizes[:0], pieces[:0], 1000) == []


@pytest.mark.parametrize("many", [10_000, 3_000_000])
def test_the_program_decides(many):
    """At least nine tokens in ten lie where the linear program puts them, in hardly more sequences than the tokens fill."""
    rng = np.random.default_rng(4)
    sizes = np.minimum(4096, np.exp(rng.normal(6.3, 1.0, many)).astype(int) + 2)
    counts = np.bincount(sizes, minlength=4097)
    _, left = linear_plan(counts, 4096, 200)
    size = np.arange(4097)
    assert (left * size).sum() <= 0.1 * sizes.sum()
    fillings = plan(counts, 4096)
    back = np.zeros_like(counts)
    for f in fillings:
        for n, m in f.parts:
            back[n] += m * f.copies
    assert (back == counts).all()
    assert sum(f.copies for f in fillings) <= -(-sizes.sum() // 4096) * 1.002 + 1
    assert len(fillings) <= 30_000
