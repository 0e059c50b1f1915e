import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, prose

from curbwait.llm import collocations, hat_trie
from curbwait.llm.bitmap import Bitmap

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(rows, least=10, share=50, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, held in counts.items():
        often = {p: n for p, n in held.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * n >= share * a and p in (q[:-1], q[1:]) for q, n in often.items()):
                continue
            cuts = [(10**6 * a * a // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    schema = "doc_id long, lang string, text string, phrase string, n int, part string"
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    result = collocations.collocations(docs, **options)
    assert result.columns == COLUMNS
    return sorted(map(tuple, result.collect()))


def texts(rng, n, words=30):
    vocabulary = prose(rng, words).split()
    for _ in range(n):
        made = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ", ", "\t", "\r\n", " É"]) for _ in range(60)]
        yield rng.choice([" ", "  "]).join(made).title() if rng.random() < 0.3 else " ".join(made)


def documents(rng):
    rows = [(d, None, t) for d, t in AWKWARD]
    rows += [(k, rng.choice(["en", "de", None, ""]), t) for k, t in enumerate(texts(rng, 300))]
    return rows + [(9, "en", "one two three, one two. four"), (10, "en", "!?.")] * 12


@pytest.mark.parametrize("options", [{}, {"least": 3, "share": 90, "most": 50}])
def test_agree_with_plain_counts(spark, options):
    rows = documents(random.Random(7))
    wanted = expected(rows, **options)
    assert {r[0] for r in wanted} >= {"en", "de", "und"}
    assert found(spark, rows, **options) == wanted


def test_agree_when_tries_spill(spark, monkeypatch):
    rng = random.Random(8)
    for name, value in (("_CHUNK", 500), ("_STEP", 64), ("_WORDS", 40), ("_ENTRIES", 100)):
        monkeypatch.setattr(collocations, name, value)
    rows = documents(rng)
    batches = [(lang or "und", [t.encode()]) for _, lang, t in rows if t]
    for size in (1, 2, 3):
        counter, got, steps = collocations._Counter("en", size, None), Counter(), 0
        for _, some in batches:
            words = collocations.words_of(some)
            for k in range(0, len(words), 64):
                counter.add(words[k : k + 64 + size - 1])
                if len(counter.vocabulary) > 40:
                    for batch in counter.spilled(0):
                        for r in batch.to_pylist():
                            got[r["phrase"]] += r["n"]
                    counter.vocabulary, steps = collocations._Vocabulary(), steps + 1
                for batch in counter.spilled(50):
                    for r in batch.to_pylist():
                        got[r["phrase"]] += r["n"]
        for batch in counter.spilled(0):
            for r in batch.to_pylist():
                got[r["phrase"]] += r["n"]
        wanted = Counter()
        for _, some in batches:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(some[0].decode())):
                words = re.findall(r"[^\x20\x09]+", piece)
                wanted.update(" ".join(words[k : k + size]) for k in range(len(words) - size + 1))
        assert got == wanted and steps


def test_trie_bursts_and_spills_in_order():
    rng = random.Random(9)
    trie, wanted = hat_trie.HatTrie(3), Counter()
    for _ in range(30):
        keys = sorted({rng.randrange(1, 4) << 42 | rng.randrange(1, 900) << 21 | rng.randrange(1, 90) for _ in range(2000)})
        numbers = [rng.randint(1, 5) for _ in keys]
        trie.add(np.array(keys), np.array(numbers))
        for k, n in zip(keys, numbers, strict=True):
            wanted[k] += n
    assert trie.entries == len(wanted) > 2 * 16_384 and isinstance(trie._root, hat_trie._Node)
    got = Counter()
    for left in (len(wanted) // 2, 10, 0):
        keys, counts = (x.tolist() for x in trie.spill(left))
        assert trie.entries <= left and keys == sorted(keys) and not got.keys() & set(keys)
        got.update(dict(zip(keys, counts, strict=True)))
    assert got == wanted
    assert [len(x) for x in trie.spill(0)] == [0, 0]


def test_tasks_and_spark_hash_phrases_alike(spark):
    rows = spark.createDataFrame([("en", "été"), ("und", "b")], "lang string, phrase string")
    assert Bitmap(rows, collocations.phrase_hash(1), 20)
    text = [b"red blue red blue green. red blue"]
    words = collocations.words_of(text)
    often = spark.createDataFrame([("en", "red blue"), ("en", "blue red")], "lang string, phrase string")
    counter = collocations._Counter("en", 3, Bitmap(often, collocations.phrase_hash(2), 20))
    counter.add(words)
    got = {r["phrase"]: r["n"] for b in counter.spilled(0) for r in b.to_pylist()}
    assert got == {"red blue red": 1, "blue red blue": 1}


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**9
    one = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 11)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big)], one.schema)
    row = collocations._scored(two, one, two.limit(0)).first()
    assert (row.l, row.r, row.score) == (big + 7, big + 11, 10**6 * big * big // ((big + 7) * (big + 11)))


def test_no_documents(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "en", None), (2, None, "")]) == []


def test_long_text(spark):
    rng = random.Random(10)
    rows = [(1, "en", " ".join(texts(rng, 4000, 200)))]
    assert len(rows[0][2]) > 1 << 20
    assert found(spark, rows) == expected(rows)
