import random

import numpy as np
import pytest
from helpers import AWKWARD, frame, prose
from tokenizers import Tokenizer

from curbwait.llm import cutting_stock, packing, token_orc, tokens
from curbwait.session import scratch_path

PATH = tokens.default_path()


def reference(text, end):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def corpus():
    rng = random.Random(8)
    rows = [*AWKWARD, (8, "<|endoftext|> It's\tTHE 42nd  <|startoftext|>"), (9, "x" * 5000)]
    return rows + [(100 + k, prose(rng, rng.choice([5, 50, 400, 3000]))) for k in range(25)]


def test_words_encode_like_texts():
    encode, whole = tokens.encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "É", "ß", "x", "1", "²", "½", "'", "'s", "'Ll", ".", "!", "-", "<|", "|>", "<|endoftext|>", "µ",
                "İ", "Σ", "ς", "日", "e\u0301", "\u0301", "\xa0", "\xad", "\x85", "\t", "\x1c", " ", " ", "\n", "×", "÷", "ÿ", "ﬁ"]
    texts = [t or "" for _, t in corpus()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(20_000)]
    assert encode._known is not None
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts():
    path = PATH.replace("word_bpe_49k", "byte_bpe_50k")
    encode, whole = tokens.encoder(path), Tokenizer.from_file(path)
    for text in ("", "It's  a\ntest", "x" * 300):
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_cover_documents_and_fill_sequences(spark):
    rows = corpus()
    found = packing.pack(frame(spark, rows), PATH).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == r.length
    for doc, text in rows:
        ids = reference(text, 1)
        pieces = sorted((p for p in by_doc[doc] if p.doc_tokens == len(ids)), key=lambda p: p.start)
        copies = sum(1 for d, t in rows if (d, t) == (doc, text))
        assert sum(p.length for p in pieces) == copies * len(ids)
        assert all(p.ids == ids[p.start : p.start + p.length] for p in pieces)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for pieces in held.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    assert padded <= 1.05 * sum(r.length for r in found)


@pytest.mark.parametrize("n", [0, 1, 10, 5000])
def test_patterns_use_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths, many = np.unique(rng.integers(1, 65, n), return_counts=True)
    counts = dict(zip(lengths.tolist(), many.tolist(), strict=True))
    chosen, left = cutting_stock.patterns(counts, 64)
    used = dict(left)
    for pattern, times in chosen:
        assert sum(k * a for k, a in pattern.items()) <= 64 and times > 0
        for k, a in pattern.items():
            used[k] = used.get(k, 0) + a * times
    assert used == counts
    if n == 5000:
        total = sum(k * c for k, c in counts.items())
        assert sum(t for _, t in chosen) + sum(k * c for k, c in left.items()) / 64 < 1.01 * total / 64


def test_no_documents(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []


def test_orc_holds_ids_in_order(spark):
    rows = corpus()
    path = scratch_path(spark, "orc")
    token_orc.write_tokens(frame(spark, rows), path, PATH)
    found = token_orc.read_tokens(spark, path).orderBy("start").collect()
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted((d for d, _ in rows), key=lambda d: (d is None, d))
    wanted = sorted((repr(d), reference(t, 2)) for d, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in found) == wanted
    plan = token_orc.read_tokens(spark, path).where("doc_id = 105")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,105)" in plan
    assert [r.ids for r in token_orc.read_tokens(spark, path).where("doc_id = 105").collect()] == [
        reference(dict(rows)[105], 2)
    ]


def test_orc_of_no_documents(spark):
    path = scratch_path(spark, "orc")
    token_orc.write_tokens(frame(spark, []), path, PATH)
    assert token_orc.read_tokens(spark, path).collect() == []
