import random
from collections import Counter

import numpy as np
from helpers import AWKWARD, frame, prose

from curbwait.llm import suffix_dedup
from curbwait.llm.suffix_array import suffix_array


def expected(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        out.append((d, bytes(np.frombuffer(b, np.uint8)[~gone]), [tuple(e) for e in edges.tolist()]))
    return sorted(out, key=repr)


def found(spark, rows):
    result = suffix_dedup.deduped(frame(spark, rows)).collect()
    return sorted([(r.doc_id, bytes(r.kept), [(s.a, s.b) for s in r.removed]) for r in result], key=repr)


def test_agrees_with_all_windows(spark):
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (20, 40, 80)]
    rows = list(AWKWARD)
    for k in range(30):
        parts = [prose(rng, rng.randint(1, 60)), rng.choice(passages)[rng.randint(0, 30) :], "é" * rng.randint(0, 250)]
        rng.shuffle(parts)
        rows.append((100 + k, " ".join(parts)))
    rows += [(200, passages[2]), (201, passages[2]), (202, "a" * 199), (203, "a" * 199), (204, "b" * 200)]
    assert found(spark, rows) == expected(rows)


def test_no_documents(spark):
    assert found(spark, []) == []


def test_suffixes_in_order():
    rng = random.Random(1)
    for _ in range(100):
        text = [rng.randint(2, rng.choice([3, 5, 9])) for _ in range(rng.randint(1, 200))] + [0]
        order = suffix_array(np.array(text, np.int16), 10, 10**6)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
