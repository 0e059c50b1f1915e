"""Texts that are unlike but have equal sums of bytes times powers of any odd number,
modulo 2 ** 64: equal is what has equal bytes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import frame, prose

from curbwait.llm import line_dedup, near_dup, quality, suffix_dedup
from curbwait.llm.blocks import ByteHash, blocks, numbered, order_by, word_hashes

MORSE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OTHER = "".join("ba"[k.bit_count() % 2] for k in range(1024))


def test_hashes_tell_them_apart():
    data = np.frombuffer((MORSE + OTHER + MORSE).encode(), np.uint8)
    starts = np.arange(3) * 1024
    a, b, c = ByteHash(data)(starts, starts + 1024).tolist()
    assert a == c != b
    assert numbered(data, starts, starts + 1024).tolist() in ([0, 1, 0], [1, 0, 1])


def test_numbers_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr(ByteHash, "__call__", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"red blue red green blue", np.uint8)
    starts, ends = np.array([0, 4, 9, 13, 19]), np.array([3, 8, 12, 18, 23])
    assert numbered(data, starts, ends).tolist() == [0, 1, 0, 2, 1]


def test_hashes_of_words():
    rng = random.Random(1)
    made = [bytes(rng.choices(b"ab", k=rng.choice([1, 7, 8, 9, 10, 11, 12, 63, 64, 65, 200]))) for _ in range(5000)]
    for spread in (made, made[::-1]):
        ends = np.cumsum([len(w) + 1 for w in spread]) - 1
        starts = ends - [len(w) for w in spread]
        hashes = word_hashes(np.frombuffer(b" ".join(spread), np.uint8), starts, ends).tolist()
        known = dict(zip(spread, hashes, strict=True)) if spread is made else known
        assert [known[w] for w in spread] == hashes
    assert len(set(known.values())) == len(known)


def test_order_of_values_alike_in_their_first_bits():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 300, 5000))
    for values in (rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 9, 5000).astype(np.uint64)):
        order = order_by(group, values)
        assert (np.diff(group[order]) >= 0).all()
        assert (values[order] == values[np.lexsort((values, group))]).all()


def test_memory_of_a_block_of_lines():
    block = next(blocks(pa.array([prose(random.Random(1), 90_000)])))
    tracemalloc.start()
    line_dedup.lines(block)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < len(block.data) and most < 30 * len(block.data)


def test_sums_of_long_blocks():
    data = np.tile(np.random.default_rng(1).integers(0, 256, 1 << 20, np.uint8), 20)
    starts = np.array([5, 5 + (1 << 20), 5 + (18 << 20)])
    assert len(set(ByteHash(data)(starts, starts + 1_000_000).tolist())) == 1


def test_counts_of_lines_and_windows(spark):
    texts = [f"{MORSE}\n{OTHER}", f"{MORSE} x y {OTHER} x y", f"{MORSE}\n{MORSE}", f"{MORSE} x y {MORSE} x y"]
    stats = quality.text_stats(frame(spark, list(enumerate(texts))), ["doc_id"], "text").collect()
    found = {r.doc_id: (r[-1].n_dup_lines, r[-1].n_repeat_words) for r in stats}
    assert found == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (0, 6)}


def test_lines_and_shingles(spark):
    rows = [(1, f"{MORSE} red blue"), (2, f"{OTHER} red blue"), (3, f"{OTHER} red blue")]
    found = {r.doc_id: r.removed for r in line_dedup.deduped(frame(spark, rows)).collect()}
    assert found == {1: [], 2: [], 3: [0]}
    rows = [(k, f"{t} red blue sun moon") for k, t in ((1, MORSE), (2, OTHER), (3, OTHER))]
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 2}


def test_byte_strings(spark):
    rows = [(1, "x" + MORSE + "1"), (2, "y" + OTHER + "2")]
    whole = suffix_dedup.deduped(frame(spark, rows)).collect()
    seen = {}
    for _, t in rows:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    for r, (_, t) in zip(sorted(whole), rows, strict=True):
        gone = {j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert bytes(r.kept).decode() == "".join(c for j, c in enumerate(t) if j not in gone)
