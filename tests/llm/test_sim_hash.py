import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, frame, prose
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from curbwait.llm import queries, sim_hash, vantage
from curbwait.llm.fingerprints import fingerprint


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, reach=2):
    marks = [plain(t) for _, t in rows]
    classes = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= reach:
                classes = [classes[j] if c == classes[i] else c for c in classes]
    low = {}
    for (doc, _), c in zip(rows, classes, strict=True):
        if doc is not None:
            low[c] = min(low.get(c, doc), doc)
    return sorted(((d, f"{m:016x}", low.get(c)) for (d, _), m, c in zip(rows, marks, classes, strict=True)), key=repr)


def near(rng, n):
    """Texts of which many are a few words from another."""
    made = [prose(rng, 400) for _ in range(4)]
    while len(made) < n:
        words = rng.choice(made).split(" ")
        words[rng.randrange(len(words))] = "new"
        made.append(" ".join(words))
    return made


def test_shingles_are_hashed_as_spark_does(spark):
    texts = ["A b", "one Two three", "été à l’œuvre", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lowered = F.translate("text", "ABT", "abt")
    for r in rows.select("text", F.xxhash64(lowered).alias("h")).collect():
        assert fingerprint(r.text.encode()) == r.h % (1 << 64)


@pytest.mark.parametrize("leaf", [16, 1 << 14])
def test_components_agree_with_all_pairs(spark, tmp_path, leaf):
    rng = random.Random(6)
    rows = [*AWKWARD, (None, ""), *((100 + k, t) for k, t in enumerate(near(rng, 150)))]
    found = sim_hash.near_duplicates(frame(spark, rows), leaf=leaf)
    assert found.columns == [*frame(spark, []).columns, "fingerprint", "component_id"]
    got = [(r.doc_id, f"{r.fingerprint % (1 << 64):016x}", r.component_id) for r in found.collect()]
    wanted = expected(rows)
    assert len({c for _, _, c in wanted}) < 130
    assert sorted(got, key=repr) == wanted
    frame(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.op12_sim_hash(spark, str(tmp_path)).collect()), key=repr) == wanted


def test_names_taken_and_no_documents(spark):
    schema = "doc_id long, text string, fingerprint string, Component_Id int, point int, component int"
    row = sim_hash.near_duplicates(spark.createDataFrame([(4, "a b", "own", 7, 8, 9)], schema)).first().asDict()
    assert (row["fingerprint"], row["Component_Id"], row["point"], row["component"]) == ("own", 7, 8, 9)
    assert row["component_id_"] == 4
    assert sim_hash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_long_text():
    words = " ".join(str(k % 70_001) for k in range(200_000))
    assert fingerprint(words.encode()) == plain(words)


def clustered(rng):
    """Fingerprints at random, near others, and a family on 12 bits."""
    some = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    family = some[0] ^ rng.integers(0, 1 << 12, 1500).astype(np.uint64)
    return np.unique(np.concatenate([some, some[:800] ^ bit(800) ^ bit(800), family]))


def all_pairs(points, reach):
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= reach
    return set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


@pytest.mark.parametrize("reach", [0, 1, 2, 5])
def test_tree_finds_all_pairs(reach):
    points = clustered(np.random.default_rng(1))
    got = {p for a, b in vantage.pairs(points, points, reach) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == all_pairs(points, reach)


def test_pairs_meet_in_a_shard():
    points = clustered(np.random.default_rng(2))
    tree = vantage.shard_tree(points[::4], 100, 2)
    assert len(tree) > 8
    home = vantage.homes(tree, points)
    visited = set(zip(*(x.tolist() for x in vantage.visits(tree, points, 2)), strict=True))
    assert all((a, home[b]) in visited for a, b in all_pairs(points, 2))
    assert np.bincount(home).max() < 1000


def test_links_join_what_pairs_join(spark):
    points = clustered(np.random.default_rng(3))
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    got = sim_hash.links(rows, leaf=500).collect()
    place = {int(p): k for k, p in enumerate(points.view(np.int64))}

    def roots(links):
        root = list(range(len(points)))

        def top(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return [top(k) for k in range(len(points))]

    assert all((points[place[r.a]] ^ points[place[r.b]]) for r in got)
    assert len(got) < 3 * len(points)
    assert roots([(place[r.a], place[r.b]) for r in got]) == roots(all_pairs(points, 2))


def mixed(points):
    """The points, in another order each time they are read, as shuffled rows are on a cluster."""

    def mix(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    return points.select("point").coalesce(1).mapInArrow(mix, "point long")


def test_links_are_the_same_in_any_order_of_rows(spark):
    points = clustered(np.random.default_rng(4))
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    found = sim_hash.links(mixed(rows), leaf=500)
    first, second = (sorted(map(tuple, found.collect())) for _ in range(2))
    assert len(first) > 1000
    assert first == second


def test_components_when_rows_come_in_another_order_each_time(spark, monkeypatch):
    rows = [*AWKWARD, *((100 + k, t) for k, t in enumerate(near(random.Random(8), 150)))]
    links = sim_hash.links
    monkeypatch.setattr(sim_hash, "links", lambda points, *limits: links(mixed(points), *limits))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # or both reads are of one shuffle, in one order
    try:
        found = sim_hash.near_duplicates(frame(spark, rows), keep=["doc_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    got = [(r.doc_id, f"{r.fingerprint % (1 << 64):016x}", r.component_id) for r in found]
    assert sorted(got, key=repr) == expected(rows)
