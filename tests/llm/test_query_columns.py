"""Columns of the queries that are digests, and texts longer than a block."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, frame, prose
from test_packing import reference
from test_texts import plain, stats

from curbwait.llm import queries, quality

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, made = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    rows = [(100 + k, t, None) for k, (_, t) in enumerate(AWKWARD)]
    rows += [(k, f"{prose(rng, rng.randint(1, 300))} a{k}@mail.example.org", rng.choice(["en", "de"])) for k in range(60)]
    rows += [(70, "call +49 (30) 123456-78 or 10.0.0.1, card 4111 1111 1111 1111, jane at example dot org", "en")]
    rows += [(71, prose(rng, 200_000), "de"), (72, "é" * 3000 + " x@y.zz", "en")]
    assert len(rows[-2][1]) > 1 << 20
    spark.createDataFrame(rows, DOCS).write.parquet(f"{made}/documents.parquet")
    return made, rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, folder):
    made, rows = folder
    wanted, start = [], 0
    for doc, text, _ in sorted(rows):
        ids = reference(text, 2)
        wanted.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    found = queries.op10_token_orc(spark, made).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == wanted


def test_pieces(spark, folder):
    made, rows = folder
    ids = {doc: reference(text, 1) for doc, text, _ in rows}
    found = queries.op4_pack(spark, made).collect()
    for r in found:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
    places = {doc: sorted((r.start, r.length) for r in found if r.doc_id == doc) for doc in ids}
    for doc, held in places.items():
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()]
        assert sum(n for _, n in held) == len(ids[doc])


def test_personal_data(spark, folder):
    made, rows = folder
    kinds = ["email", "ip", "card", "phone"]
    texts = {doc: text or "" for doc, text, _ in rows}
    hits = 0
    for r in queries.op8_personal_data(spark, made).collect():
        base = sorted((a, kinds.index(k), b) for a, b, k in plain(texts[r.doc_id]))
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = [(int(s.split(":")[1]), kinds.index(s.split(":")[0]), int(s.split(":")[2])) for s in r.spans.split(",") if s]
        assert spans == sorted(spans) and set(base) <= set(spans)
        assert all(0 <= a < b <= len(texts[r.doc_id]) for a, _, b in spans)
        hits += len(spans) - len(base)
    assert hits >= 1


def test_languages_of_documents_held_out(spark, folder, tmp_path):
    made, rows = folder
    found = {r.doc_id: (r.held_out, r.lang_pred) for r in queries.op5_language(spark, made).collect()}
    assert {d: h for d, (h, _) in found.items()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    assert {found[d][1] for d, t, _ in rows if not any(c.isalpha() for c in t or "")} == {"und"}
    # the labels of documents held out change nothing
    other = [(d, t, "xx" if found[d][0] else lang) for d, t, lang in rows]
    spark.createDataFrame(other, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: (r.held_out, r.lang_pred) for r in queries.op5_language(spark, str(tmp_path)).collect()}
    assert again == found and any(h for h, _ in found.values())


def test_counts_of_a_long_text(spark, folder):
    _, rows = folder
    long = max((t for _, t, _ in rows if t), key=len)
    row = quality.text_stats(frame(spark, [(1, long)]), ["doc_id"], "text").first()
    assert tuple(row[-1])[:5] == tuple(stats(long))[:5]
