import random
import tracemalloc
from collections import Counter

import numpy as np
from helpers import AWKWARD, frame, prose

from curbwait.llm import near_dup


def bags(text):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    grams = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    return Counter(grams)


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def expected(rows):
    """Smallest doc_id by class, by comparing all pairs."""
    found = [bags(t) for _, t in rows]
    classes = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if found[i] and found[j] and similarity(found[i], found[j]) >= 0.8:
                classes = [classes[j] if c == classes[i] else c for c in classes]
    low = {}
    for (doc, _), c in zip(rows, classes, strict=True):
        if doc is not None:
            low[c] = min(low.get(c, doc), doc)
    return sorted(((d, low.get(c)) for (d, _), c in zip(rows, classes, strict=True)), key=repr)


def classes(spark, rows):
    return sorted(
        [(r.doc_id, r.class_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect()], key=repr
    )


def edited(rng, text, n):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = "edit" + str(rng.random())
    return " ".join(words)


def test_classes_agree_with_all_pairs(spark):
    rng = random.Random(3)
    texts = [prose(rng, 200) for _ in range(6)]
    rows = list(AWKWARD)
    for k in range(60):
        text = rng.choice(texts)
        rows.append((100 + k, edited(rng, text, rng.choice([0, 1, 2, 4, 6]))))
    assert classes(spark, rows) == expected(rows)


def test_no_documents(spark):
    assert classes(spark, []) == []
    assert near_dup.one_of_each(frame(spark, [])).count() == 0


def test_one_of_each_keeps_the_lowest_id_and_all_columns(spark):
    rng = random.Random(5)
    text = prose(rng, 300)
    docs = frame(spark, [*AWKWARD, (50, text), (40, text), (40, text), (60, edited(rng, text, 1))])
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=repr)
    # wordless texts and the two words-alike rows: 5 stands for the null id as well
    assert ids == sorted([1, 2, 2, 3, 4, 5, 6, 7, 40], key=repr)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = np.ones(300, np.int64) * 3
    b = a.copy()
    b[:100] = 1
    rows = np.repeat([0, 1], 300)
    found = near_dup.bag_min_hash(rows, np.concatenate([base, base]), np.concatenate([a, b]), 2, 4096)
    wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - wanted) < 0.03


def test_signatures_of_many_shingles_take_little_memory(monkeypatch):
    rng = np.random.default_rng(4)
    rows, hashes = np.sort(rng.integers(0, 200, 80_000)), rng.integers(0, 1 << 63, 80_000).astype(np.uint64)
    counts = rng.integers(1, 4, 80_000)
    tracemalloc.start()
    found = near_dup.bag_min_hash(rows, hashes, counts, 200, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000 * 8 * 60
    monkeypatch.setattr(near_dup, "_POINTS", 1 << 22)  # the points drawn at a time change nothing
    assert (near_dup.bag_min_hash(rows, hashes, counts, 200, 128) == found).all()
