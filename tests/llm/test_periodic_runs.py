import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from helpers import AWKWARD, frame, prose
from pyspark.sql import types as T

from curbwait.llm import periodic_runs, queries
from curbwait.llm.suffix_automaton import runs


def plain(words, least=6, repeats=4):
    """Every maximal run by comparing all places at every distance."""
    out, n = [], len(words)
    for period in range(1, n // repeats + 1):
        start = 0
        while start + period < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, period))
            if end > start and length >= max(least, repeats * period) and not smaller:
                out.append((start, length, period))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, held):
    gone = {k for start, length, period in held for k in range(start + period, start + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        words += [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return words


@pytest.mark.parametrize("least,repeats", [(6, 4), (4, 2), (6, 3), (9, 5)])
def test_runs_agree_with_all_places(least, repeats):
    rng = random.Random(least)
    for _ in range(300):
        words = repetitive(rng, rng.randint(0, 60), rng.choice([1, 2, 3, 8]))
        assert runs([ord(w) for w in words], least, repeats) == plain(words, least, repeats)
        assert periodic_runs.found([w.encode() for w in words], least, repeats) == plain(words, least, repeats)


def test_runs_amid_prose():
    rng = random.Random(2)
    for _ in range(40):
        words = prose(rng, 100).split()
        for _ in range(3):
            at = rng.randrange(len(words))
            words[at:at] = repetitive(rng, rng.randint(1, 40), 3)
        assert periodic_runs.found([w.encode() for w in words], 6, 4) == plain(words)


def test_documents(spark):
    rng = random.Random(3)
    rows = [*AWKWARD, (20, "a\tb\x0b" * 9 + "\x1ca b " * 8), (21, "x " * 5), (22, "x " * 6)]
    rows += [(30 + k, " ".join(repetitive(rng, rng.randint(1, 80), 3))) for k in range(30)]
    found = periodic_runs.collapsed(frame(spark, rows))
    assert found.columns == [*frame(spark, []).columns, "runs", "collapsed"]
    wanted = []
    for d, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        held = plain(words)
        wanted.append((d, t, held, " ".join(left(words, held))))
    got = [(r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_names_taken(spark):
    docs = spark.createDataFrame([(1, "x " * 9, "own", "own")], "doc_id long, text string, runs string, COLLAPSED string")
    row = periodic_runs.collapsed(docs).first().asDict()
    assert (row["runs"], row["COLLAPSED"], row["collapsed_"]) == ("own", "own", "x")
    assert [tuple(r) for r in row["runs_"]] == [(0, 9, 1)]


def test_no_documents(spark):
    assert periodic_runs.collapsed(frame(spark, [])).collect() == []


def test_long_text(spark):
    rng = random.Random(4)
    words = prose(rng, 180_000).split()
    words[70_000:70_000] = words[10:300] * 5
    row = periodic_runs.collapsed(frame(spark, [(1, " ".join(words))])).first()
    held = [tuple(r) for r in row.runs]
    assert len(" ".join(words)) > 1 << 20
    assert len(held) == 1 and held[0][2] == 290 and 1450 <= held[0][1] < 1500
    assert row.collapsed == " ".join(left(words, held))


def query_row(doc, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    held = plain(words)
    best = min(held, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc,
        len(held),
        *best,
        1000 * best[1] // best[2] if held else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in held)),
        digest(" ".join(left(words, held))),
    )


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = list(AWKWARD)
    for k in range(150):
        rows.append((10 + k, prose(rng, rng.randint(1, 60)) + " " + " ".join(repetitive(rng, rng.randint(1, 30), 2))))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns[1:6] == ["n_runs", "start", "length", "period", "exponent_milli"]
    assert {t for _, t in found.dtypes[:6]} == {"bigint"}
    wanted = [query_row(d, t) for d, t in rows]
    assert sum(r[1] > 1 for r in wanted) > 20
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
