"""Each stage of the pipeline against a brute-force version on what it was given."""

import random

import pytest
from helpers import prose
from pyspark.sql import functions as F
from test_line_dedup import expected as lines_expected
from test_near_dup import expected as classes_expected
from test_near_dup import edited
from test_packing import reference
from test_texts import stats, words_of

import corpus_pipeline
from curbwait.session import written


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, shared lines, benchmark passages and junk."""
    rng, made = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    passages, shared = [prose(rng, 30).replace("\n", " ") for _ in range(3)], prose(rng, 60).split("\n")
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    texts += [edited(rng, t, 1) for t in texts[:8]] + texts[8:12]
    texts += [f"{t}\n{rng.choice(passages)}" for t in texts[20:30]]
    texts += [f"{prose(rng, 60)}\n{rng.choice(shared)}\n{prose(rng, 20)}" for _ in range(10)]
    # lines of a word each
    texts += ["\n".join(t.split()) for t in [*texts[30:33], edited(rng, texts[30].replace("\n", " "), 1)]]
    texts += ["spam spam " * 100, "a | b | c | d | " * 30, "short", "", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{made}/documents.parquet"
    )
    spark.createDataFrame(enumerate(passages), "item_id long, text string").write.parquet(f"{made}/benchmark.parquet")
    labels = [(k, int("|" not in (t or "")), 0) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


def test_stages(spark, folder):
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], folder), "stage")[0])
    before = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:5]]

    failed = lambda t: stats(t)[0] < 50 or 100 * stats(t)[4] > 50 * stats(t)[0]
    assert sorted(before[1]) == sorted((d, t) for d, t in before[0] if not failed(t) and "|" not in t)

    cut = [(d, t) for d, t, gone in lines_expected(before[1]) if not gone or words_of(t)]
    assert sorted(before[2]) == sorted(cut)

    classes = dict(classes_expected(before[2]))
    assert sorted(before[3]) == sorted((d, t) for d, t in before[2] if classes[d] == d)

    grams = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words_of(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    after = dict(before[4])
    for d, t in before[3]:
        w = words_of(t)
        hit = {k + j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in grams for j in range(10)}
        assert (d in after) == (2 * len(hit) <= len(w))
        if d in after:
            assert words_of(after[d]) == [x for k, x in enumerate(w) if k not in hit]
            assert hit or after[d] == t

    held = {}
    for r in frames[5].collect():
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert held.keys() == after.keys()
    for d, t in before[4]:
        n, at = len(reference(t, 1)), 0
        for start, length, tokens in sorted(held[d]):
            assert (start, tokens) == (at, n)
            at += length
        assert at == n
    assert len(before[0]) > len(before[1]) > len(before[2]) > len(before[3]) > 0


CLASHING = ["spans", "items", "n_words", "kept", "stats", "base_failed", "removed", "quality", "node", "class", "a.b"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_carry_clashing_columns(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    found = stage(spark, named, folder)
    assert found.columns == named.columns
    rows = found.collect()
    assert 0 < len(rows) <= docs.count()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)
