"""Packing of documents into training sequences by cutting stock.

A document's ids are cut into whole sequences, whole quarters and a rest. Pieces are counted by
length, in steps of a few ids; patterns of lengths that fill a sequence come from
column generation on that histogram, whose size does not depend on the input. The
pieces of a length are ranked, and a rank says which use of which pattern it fills.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from curbwait.llm.arrow import released
from curbwait.llm.cutting_stock import patterns
from curbwait.llm.tokens import encoded, lists
from curbwait.session import written

SEQUENCE = 2048
_KEY = ["part", "size", "rank_in_part"]
_PIECES = "doc_id long, start long, length long, doc_tokens long, part int, size int, rank_in_part long, ids array<int>"


def _cut(tokens: np.ndarray, sequence: int) -> tuple[np.ndarray, ...]:
    """Document, start and length of pieces: whole sequences, then whole quarters of
    one, then the rest. Quarters fit together without padding, and short rests pack
    better than long ones."""
    quarter = sequence // 4
    whole, over = tokens // sequence, tokens % sequence
    quarters, rest = over // quarter * quarter, over % quarter
    many = whole + (quarters > 0) + (rest > 0)
    doc = np.repeat(np.arange(len(tokens)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(nth, whole[doc]) * sequence + np.where(nth > whole[doc], quarters[doc], 0)
    left = tokens[doc] - start
    length = np.where(left >= sequence, sequence, np.where(left >= quarter, left // quarter * quarter, left))
    return doc, start, length


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, sequence: int = SEQUENCE, grain: int = 4) -> DataFrame:
    """The documents' ids, ``end`` appended, cut into pieces; written as a table.

    ``size`` is the length in steps of ``grain``, rounded up; ``rank_in_part`` numbers
    a task's pieces of a size. A null text has ``end`` only; repeated rows are packed
    each; other columns are not read.
    """

    def run(batches):
        part, ranks = TaskContext.get().partitionId(), np.zeros(sequence // grain + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids, offsets = encoded(some.column("text"), tokenizer, end)
                tokens = np.diff(offsets)
                doc, start, length = _cut(tokens, sequence)
                size = -(-length // grain)
                order = np.argsort(size, kind="stable")
                many = np.bincount(size, minlength=len(ranks))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
                rank += ranks[size]
                ranks += many
                bounds = np.append(offsets[doc] + start, offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(pa.array(doc)).cast(pa.int64()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(tokens[doc]),
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(rank),
                        lists(ids, bounds),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "part", "size", "rank_in_part", "ids"],
                )

    return written(docs.select("doc_id", "text").mapInArrow(released(run), _PIECES), "pieces")[0]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    sequence: int = SEQUENCE,
    grain: int = 4,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every piece with its ids, ``sequence_id`` and ``offset`` there, gapless.

    ``derive`` may put columns in the place of ``ids`` before pieces are shuffled.
    Sequences of a pattern hold whole pieces. The pieces that rounding left over, at
    most a pattern for each size, are put end to end and cut at sequence ends, the last
    of them into powers of two, which need no padding. Only counts by size, and the
    lengths of those left over, come to the driver.
    """
    derive = derive or (lambda rows: rows)
    cut = pieces(docs, tokenizer, end, sequence, grain)
    held, _ = written(
        cut.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n")), "histogram"
    )
    counts = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    chosen, left = patterns(counts, sequence // grain)
    sequences = sum(times for _, times in chosen)
    used = np.zeros(sequence // grain + 1, np.int64)
    for size, n in counts.items():
        used[size] = n - left.get(size, 0)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.join(base, ["part", "size"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))

    whole = _in_patterns(ranked(derive(cut)), chosen, used)
    limits = F.array(*(F.lit(int(n)) for n in used))
    over = ranked(cut.select(*_KEY)).where(F.col("rank") >= F.get(limits, "size")).select(*_KEY)
    over, _ = written(over, "left_over")
    rest = cut.join(F.broadcast(over), _KEY)  # at most a pattern's pieces for each size
    lengths = rest.select(*_KEY, "length").collect()
    # written, as a task that made and derived them would need two workers
    rest = derive(written(_end_to_end(rest, lengths, sequence, sequences), "end_to_end")[0])
    columns = [c for c in whole.columns if c not in _KEY]
    return whole.select(columns).unionByName(rest.select(columns))


def _in_patterns(rows: DataFrame, chosen: list, used: np.ndarray) -> DataFrame:
    """The pieces that patterns use, with the sequence and offset of their rank. A join, as
    ``derive`` may have a worker in the same task already."""
    named = "_size int, _first long, _end long, _sequence long, _each long, _slot long"
    ranges = F.broadcast(rows.sparkSession.createDataFrame(_slots(chosen, used), named))  # some for each size
    keep = [c for c in rows.columns if c not in ("rank", "base")]
    placed = rows.join(ranges, F.expr("size = _size and rank >= _first and rank < _end")).selectExpr(
        *(f"`{c}`" for c in keep),
        "_sequence + (rank - _first) div _each as sequence_id",
        "_slot + (rank - _first) % _each as slot",
    )
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0))
    return placed.withColumn("offset", offset).drop("slot")


def _end_to_end(rest: DataFrame, lengths: list, sequence: int, first: int) -> DataFrame:
    """The left-over pieces cut so that they fill sequences, numbered from ``first``."""
    order = sorted(lengths, key=lambda r: (-r["size"], r["part"], r["rank_in_part"]))
    places, total = {}, 0
    for r in order:
        places[r["part"], r["size"], r["rank_in_part"]] = total
        total += r["length"]
    ends = list(range(sequence, total + 1, sequence))
    tail = total % sequence
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    bounds = np.array([0, *ends], np.int64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = places[row["part"], row["size"], row["rank_in_part"]]
                stops = bounds[(bounds > at) & (bounds < at + row["length"])]
                edges = [at, *stops.tolist(), at + row["length"]]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    nth = int(np.searchsorted(bounds, a, side="right")) - 1
                    made = row | {
                        "start": row["start"] + a - at,
                        "length": b - a,
                        "ids": row["ids"][a - at : b - at],
                        "sequence_id": first + nth,
                        "offset": a - int(bounds[nth]),
                    }
                    yield pa.RecordBatch.from_pylist([made], schema=schema)

    kind = T.StructType(
        [*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind.fields])
    return rest.mapInArrow(released(run), kind)


def _slots(chosen: list, used: np.ndarray) -> list[tuple[int, ...]]:
    """For ranges of ranks of a size: size, first rank, the one after the last, first
    sequence, pieces of the size in a sequence, and the first one's place there."""
    rows, before, sequence = [], {}, 0
    for pattern, times in chosen:
        slot = 0
        for size, each in sorted(pattern.items(), reverse=True):
            first = before.get(size, 0)
            before[size] = first + each * times
            rows.append((size, first, min(before[size], int(used[size])), sequence, each, slot))
            slot += each
        sequence += times
    return rows
