"""What a Python worker keeps after a task."""

from pathlib import Path

import pyarrow as pa
import pytest
from helpers import frame

import corpus_pipeline
from curbwait.llm.arrow import released
from curbwait.llm.queries import packed
from curbwait.llm.tokens import default_path, encoder


def resident():
    """MB of this process that are in memory."""
    return int(Path("/proc/self/statm").read_text().split()[1]) / 256


def test_free_memory_is_given_back():
    last = []

    def run(batches):
        held = [bytes(100_000) + b for b in batches]  # each too small for a mapping of its own
        last.append(bytes(90_000) + b"y")  # above them
        yield len(held)

    before = resident()
    assert list(released(run)(iter([b"x"] * 3000))) == [3000]
    assert resident() < before + 100
    stopped = released(lambda batches: (b for b in batches))(iter([1, 2]))
    assert next(stopped) == 1
    stopped.close()


def test_the_tokenizer_goes_when_a_task_does_not_use_it(spark):
    def use(batches):
        yield id(encoder(default_path()))

    first = list(released(use)([])) + list(released(use)([]))
    assert first[0] == first[1]
    assert encoder._held.cache_info().currsize == 1
    assert list(released(iter)([1])) == [1]
    assert encoder._held.cache_info().currsize == 0

    def sizes(batches):
        from curbwait.llm import tokens

        tokens.encoder(default_path())
        yield from batches
        assert tokens.encoder._held.cache_info().currsize == 1 and encoder is tokens.encoder

    assert spark.range(3).coalesce(1).mapInArrow(released(sizes), "id long").count() == 3


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bound_what_a_worker_gets_at_a_time(spark, tmp_path, name, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, folder = frame(spark, [(k, f"{k} words in a text") for k in range(5)]), str(tmp_path)
    spark.range(5).selectExpr("id as doc_id", "1 as quality").write.parquet(f"{folder}/labels.parquet")
    docs.selectExpr("doc_id as item_id", "text").write.parquet(f"{folder}/benchmark.parquet")

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)

    long = spark.range(3000).coalesce(1).selectExpr("repeat('x', 10000) as text")
    spark.conf.unset(key)
    try:
        stage(spark, docs, folder)
        got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 30_000_000 and max(got) < 8_000_000
        spark.conf.set(key, "1m")  # a bound of the session's own stays
        stage(spark, docs, folder)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_packing_has_one_worker_a_task(spark):
    found = packed(frame(spark, [(k, f"{k} words " * k) for k in range(300)]))
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    path, workers = [], 0  # what lies above a node: its depth, and the workers of its task so far
    for line in plan:
        node = line.lstrip(" :+-*").split(" ", 1)
        depth = len(line) - len(line.lstrip(" :+-*"))
        path = [p for p in path if p[0] < depth]
        above = path[-1][1] if path else 0
        now = 0 if "Exchange" in line else above + ("MapInArrow" in node[0] or "MapInArrow" in line)
        assert now <= 1, found._jdf.queryExecution().executedPlan().toString()
        workers += "MapInArrow" in line
        path.append((depth, now))
    assert workers > 0
    assert found.count() > 300
