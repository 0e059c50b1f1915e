import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, frame, prose

from curbwait.llm import line_dedup
from curbwait.llm.bitmap import held_by


def words(line):
    return frozenset("".join(c if c.isalnum() or ord(c) > 127 else " " for c in line.lower()).split())


def expected(rows):
    lines = [
        ((d is None, d or 0, k), words(x)) for d, t in rows for k, x in enumerate((t or "").split("\n"))
    ]
    out = []
    for d, t in rows:
        gone = []
        for k, x in enumerate((t or "").split("\n")):
            own, at = words(x), (d is None, d or 0, k)
            if own and any(p < at and len(own & w) >= 0.8 * len(own | w) for p, w in lines if w):
                gone.append(k)
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((d, kept, gone))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    result = line_dedup.deduped(frame(spark, rows), line_dedup.Settings(**settings))
    return sorted([(r.doc_id, r.text, r.removed) for r in result.collect()], key=repr)


@pytest.mark.parametrize("most", [1, 16])
def test_lines_agree_with_all_pairs(spark, most):
    rng = random.Random(2)
    lines = prose(rng, 300).split("\n")
    rows = list(AWKWARD)
    for k in range(40):
        made = []
        for line in rng.sample(lines, 6):
            parts = line.split(" ")
            if rng.random() < 0.5:
                parts[rng.randrange(len(parts))] = rng.choice(["new", "words", "here"])
            made.append(" ".join(parts))
        rows.append((100 + k, "\n".join(made)))
    rows.append((130, "new\n" + lines[0]))
    assert found(spark, rows, most=most) == expected(rows)


def test_short_lines(spark):
    rows = [(1, "red\nred\nblue red\nRed, blue!\n...\n..."), (2, "red blue green\nred\ngreen blue red"), (3, "日\n日")]
    assert found(spark, rows) == expected(rows)
    assert [gone for _, _, gone in found(spark, rows)] == [[1, 3], [1, 2], [1]]


def test_no_documents(spark):
    assert found(spark, []) == []


def pieces(line):
    """Words, but two neighbouring characters of Han, kana or Thai in place of a run."""
    script = "\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\U00020000-\U0002a6df"
    out = set()
    for run in re.findall(rf"[{script}]+|(?:(?![{script}])[a-z0-9\x80-\U0010ffff])+", line.lower()):
        if re.match(f"[{script}]", run):
            out |= {run[k : k + 2] for k in range(max(1, len(run) - 1))}
        else:
            out.add(run)
    return out


@pytest.mark.parametrize("most", [1, 16])
def test_lines_without_spaces(spark, most):
    rng = random.Random(5)
    scripts = ["".join(map(chr, range(0x4E00, 0x4E60))), "".join(map(chr, range(0x3041, 0x3090))), "กขคงจฉชซญณดตถทธน\U00020000\U00020001"]
    lines = ["".join(rng.choices(s, k=rng.randint(1, 40))) for s in scripts for _ in range(12)]
    rows = [(1, "日本語\n日本語"), (1, "東京都に住む人々\nabc東京都def。大阪 x"), (2, "東京都に住む人々\nabc東京都def。大阪 x")]
    for k in range(40):
        made = []
        for line in rng.sample(lines, 5):
            at = rng.randrange(len(line))
            made.append(line[:at] + rng.choice(["", "新", " ", "é"]) + line[at + 1 :] if rng.random() < 0.4 else line)
        rows.append((10 + k, "\n".join(made)))
    held = [((d, k), pieces(x)) for d, t in rows for k, x in enumerate(t.split("\n"))]
    wanted = []
    for d, t in rows:
        gone = [
            k
            for k, x in enumerate(t.split("\n"))
            if (w := pieces(x)) and any(p < (d, k) and len(w & v) >= 0.8 * len(w | v) for p, v in held)
        ]
        wanted.append((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), gone))
    result = found(spark, rows, most=most)
    assert result == sorted(wanted, key=repr)
    assert sum(len(gone) for _, _, gone in result) > 60


def test_postings_are_moved_in_large_rows(spark):
    rng = random.Random(7)
    docs = frame(spark, [(k, prose(rng, 400)) for k in range(-5, 25)]).select("doc_id", "text").repartition(2)
    settings = line_dedup.Settings()
    rarity, n = line_dedup.word_rarity(line_dedup.line_table(docs, settings))
    lines = [words(x) for r in docs.collect() for x in r.text.split("\n")]
    assert n == sum(map(len, lines))
    rows = line_dedup.postings(docs, np.maximum(rarity, 1), settings, 8).collect()
    assert len(rows) <= 2 * 8
    held = np.concatenate([np.frombuffer(r.held, line_dedup._POSTING) for r in rows])
    assert len(held) == sum(len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1 for x in lines)
    assert {r.bucket for r in rows} == set((held["token"].view(np.uint64) >> np.uint64(61)).tolist())


def test_texts_are_not_read_again_for_candidates_left(spark, monkeypatch):
    dealt, left = [], []
    monkeypatch.setattr(line_dedup, "postings", lambda *a, f=line_dedup.postings: dealt.append(1) or f(*a))
    monkeypatch.setattr(line_dedup, "candidates_left", lambda *a, f=line_dedup.candidates_left: left.append(1) or f(*a))
    # 170 of 200 words in common, the rarest among them: unlike, but all filters let them through
    rng = random.Random(8)
    base, pool = [f"b{k}" for k in range(170)], [f"p{k}" for k in range(300)]
    rows = [(k, " ".join(rng.sample(pool, 50))) for k in range(150)]
    rows += [(200 + k, " ".join(base + rng.sample(pool, 30))) for k in range(12)]
    rows += [(300, rows[-8][1].replace("b7 ", "z "))]
    assert found(spark, rows, most=1) == expected(rows)
    assert (len(dealt), len(left)) == (1, 1)


def test_order_by_place():
    rng = np.random.default_rng(3)
    for docs in ([-(2**63), -1, 0, 5, 2**63 - 1], range(1000)):
        group, line = np.sort(rng.integers(0, 50, 3000)), rng.integers(0, 2**32, 3000)
        doc = rng.choice(np.array(docs, np.int64), 3000)
        for line_ in (line, line % 10, np.full(3000, 2**60) + line):
            order = line_dedup._by_place(group, doc, line_)
            want = sorted(zip(group.tolist(), doc.tolist(), line_.tolist(), strict=True))
            assert list(zip(group[order].tolist(), doc[order].tolist(), line_[order].tolist(), strict=True)) == want


def test_lines_are_moved_in_large_rows(spark):
    rng = random.Random(9)
    texts = [prose(rng, 400) for _ in range(30)]
    rows = [(k, texts[k] + "\n" + texts[0]) for k in range(30)] + [(None, texts[1])]
    docs = frame(spark, rows).select("doc_id", "text").coalesce(1)
    table = line_dedup.line_table(docs, line_dedup.Settings()).where("chunk is null").collect()
    held = [np.frombuffer(r.held, line_dedup._LINE) for r in table if r.held is not None]
    assert len({r.bucket for r in table if r.held is not None}) == len(held)
    held = np.concatenate(held)
    wanted, seen, later = set(), {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, x in enumerate(t.split("\n")):
            if seen.setdefault(words(x), (d, k)) == (d, k):
                wanted.add((d is None, d or 0, k))
            else:
                later.append((d, k))
    assert {(r["last"] == 1, r["doc_id"], r["line"]) for r in held} == wanted
    found = [(r.doc_id, r.line) for r in table if r.line is not None]
    assert sorted(found, key=repr) == sorted(later, key=repr) and len(later) > 30


def test_at_first():
    rng = np.random.default_rng(4)
    rows = np.zeros(3000, line_dedup._LINE)
    for name, n in (("s1", 400), ("s2", 2), ("doc_id", 5), ("line", 4), ("last", 2)):
        rows[name] = rng.integers(0, n, len(rows))
    place = [(r["last"], r["doc_id"], r["line"]) for r in rows]
    least = {}
    for r, p in zip(rows, place, strict=True):
        key = r["s1"], r["s2"]
        least[key] = min(least.get(key, p), p)
    wanted = [p == least[r["s1"], r["s2"]] for r, p in zip(rows, place, strict=True)]
    assert line_dedup._at_first(rows).tolist() == wanted
    assert not len(line_dedup._at_first(rows[:0]))


@pytest.mark.parametrize("most", [1, 50, 1_000_000])
def test_words_shared(most, monkeypatch):
    monkeypatch.setattr(line_dedup, "_COMPARED", most)
    rng = np.random.default_rng(6)
    sets = [[np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in rng.integers(1, 30, 200)] for _ in range(2)]
    v, u = (pa.array([x.tobytes() for x in side], pa.binary()) for side in sets)
    for cut in (slice(0, 200), slice(7, 150), slice(0, 0)):
        some = [side[cut] for side in sets]
        shared, both = line_dedup._shared(v[cut], u[cut])
        assert shared.tolist() == [len(np.intersect1d(x, y)) for x, y in zip(*some, strict=True)]
        assert both.tolist() == [len(x) + len(y) for x, y in zip(*some, strict=True)]


def test_texts_are_not_looked_up_in_python(spark, capsys):
    rows = [(1, "red blue green"), (2, "red blue green\nwhite"), (None, None)]
    line_dedup.deduped(frame(spark, rows).select("doc_id", "text")).explain()
    assert "MapInArrow" not in capsys.readouterr().out
    docs, keys = spark.range(-500, 500).toDF("_map_word"), spark.range(0, 40).toDF("k")
    some, others = (
        {r[0] for r in held_by(docs, "_map_word", keys, "k", how).collect()} for how in ("left_semi", "left_anti")
    )
    assert some == set(range(40)) and some | others == set(range(-500, 500)) and not some & others
