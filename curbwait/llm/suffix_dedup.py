"""Removal of byte strings that occur again, by suffix arrays over shards.

A window is a string of ``length`` bytes. Its anchor is the smallest of the hashes of
its short substrings, so equal windows have equal anchors. Windows in a row with one
anchor make a segment, some half a window longer than a window. Only segments whose
anchor occurs again can hold a repeated window. Equal ones are counted, and one of
each goes to the shard of its anchor; there a suffix array over the shard's segments
shows which windows occur twice. A window therefore meets every equal one, wherever
it stands, and no pairs are made.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from curbwait.llm.arrow import appended, fresh
from curbwait.llm.bitmap import Bitmap
from curbwait.llm.blocks import Block, blocks, mix
from curbwait.llm.suffix_array import repeats, suffix_array
from curbwait.session import drop_scratch, written


@dataclass(frozen=True)
class Settings:
    """Window, anchor length, the bytes of segments that one suffix array takes, and the
    bytes of texts among which equal segments are moved once."""

    length: int = 200
    anchor: int = 32
    shard_bytes: int = 1 << 20
    block_bytes: int = 1 << 20


_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, modulo 2 ** 64: it picks anchors,
    and is not taken for what it stands for."""
    if len(_POWERS[0]) < len(data):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(len(data), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _POWERS[0][: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _POWERS[1][: len(data) - size + 1])


def segments(block: Block, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the block's segments, and their anchors. Segments do not
    leave their text; a text shorter than a window has none."""
    k, wide = settings.anchor, settings.length - settings.anchor + 1
    n = len(block.data)
    if n < settings.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _rolling(block.data, k)
    low_bits = np.uint64(max(24, int(n).bit_length()))
    place = (np.uint64(1) << low_bits) - np.uint64(1)
    least = (hashes & ~place) | np.arange(n - k + 1, dtype=np.uint64)
    # the smallest of `wide` in a row, by doubling
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = wide - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    # windows within one text, cut where the smallest is another
    able = np.zeros(len(least) + 2, bool)
    for a, b in zip(block.starts[:-1], block.starts[1:] - settings.length + 1, strict=True):
        if b > a:
            able[a + 1 : b + 1] = True
    cut = np.ones(len(least) + 1, bool)
    cut[1:-1] = least[1:] != least[:-1]
    opens = np.flatnonzero(able[1:-1] & (cut[:-1] | ~able[:-2]))
    closes = np.flatnonzero(able[1:-1] & (cut[1:] | ~able[2:]))
    return opens, closes + settings.length, hashes[(least[opens] & place).astype(np.int64)]


def _anchors(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), settings.block_bytes):
                found, many = np.unique(segments(block, settings)[2].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many)], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long")


def _segment_table(docs: DataFrame, again: Bitmap, settings: Settings) -> DataFrame:
    """Segments whose anchor may occur again: ``anchor``, ``c1``, ``c2`` (identity of
    the bytes), ``doc_id``, ``hash`` (of the text), ``start``, and ``bytes`` of one of
    the equal segments in a block."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), settings.block_bytes):
                starts, ends, anchors = segments(block, settings)
                hit = again.has(anchors.view(np.int64))
                starts, ends, anchors = starts[hit], ends[hit], anchors[hit]
                raw = block.data.tobytes()
                parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                digests = np.frombuffer(b"".join(map(xxh3_128_digest, parts)), np.int64).reshape(-1, 2)
                c1, c2 = np.ascontiguousarray(digests.T)
                seen: set[bytes] = set()
                held = [None if p in seen else seen.add(p) or p for p in parts]
                row = block.row_of(starts)
                rows = pa.array(row + block.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors.view(np.int64)),
                        pa.array(c1),
                        pa.array(c2),
                        batch.column("doc_id").take(rows),
                        batch.column("hash").take(rows),
                        pa.array(starts - block.starts[row]),
                        pa.array(held, pa.binary()),
                    ],
                    ["anchor", "c1", "c2", "doc_id", "hash", "start", "bytes"],
                )

    return docs.mapInArrow(
        run, "anchor long, c1 long, c2 long, doc_id long, hash long, start long, bytes binary"
    )


def repeated_parts(parts: list[bytes], many: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each segment the merged spans of its windows that occur again: in another
    place of these segments, or because the whole segment is there several times."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    text = data.astype(np.int16) + 2
    text[starts[1:] - 1] = 1
    text[-1] = 0
    bounds = np.zeros(len(data) + 1, np.int64)
    np.add.at(bounds, starts[:-1], 1)
    np.add.at(bounds, starts[:-1] + np.maximum(sizes - length + 1, 0), -1)
    able = np.cumsum(bounds)[:-1] > 0
    order = suffix_array(text, 258, length)
    found = repeats(data, order, length, able)
    found |= able & np.repeat(np.append(many > 1, False), np.append(sizes + 1, 1))
    at = np.flatnonzero(found)
    of = np.searchsorted(starts, at, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(at):
        cut = np.flatnonzero((np.diff(at) > length) | (of[1:] != of[:-1])) + 1
        for a, b, k in zip(
            at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1], of[np.concatenate([[0], cut])],
            strict=True,
        ):
            out[k].append((int(a - starts[k]), int(b - starts[k]) + length))
    return out


def _judged(distinct: DataFrame, settings: Settings) -> DataFrame:
    """``anchor``, ``c1``, ``c2`` and ``spans`` of segments with repeated windows. A
    task takes the anchors of its partition in turn, some of them at a time."""
    fields = ["anchor", "c1", "c2"]

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated_parts([r[4] for r in rows], np.array([r[3] for r in rows]), settings.length)
        kept = [(r, [{"a": a, "b": b} for a, b in s]) for r, s in zip(rows, spans, strict=True) if s]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        keys = [pa.array([r[k] for r, _ in kept], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([s for _, s in kept], kind)], [*fields, "spans"])

    def run(batches):
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*fields, "n", "bytes"]), strict=True):
                if held >= settings.shard_bytes and row[0] != last:
                    yield solved(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
                last = row[0]
        if rows:
            yield solved(rows)

    laid = distinct.repartition(F.col("anchor")).sortWithinPartitions("anchor", "c1", "c2")
    return laid.mapInArrow(run, "anchor long, c1 long, c2 long, spans array<struct<a:long,b:long>>")


def repeated_spans(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``doc_id``, ``hash`` (of the text) and ``spans``, sorted (a, b): windows that
    start again elsewhere, by byte offset, not merged, some perhaps twice; for documents
    that have any."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text", f"xxhash64(`{text}`) as hash")
    rows = rows.where("text is not null")
    often = _anchors(rows, settings).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    table, path = written(_segment_table(rows, Bitmap(often, "anchor"), settings), "segments")
    distinct = table.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    spans, spans_path = written(_judged(distinct, settings), "segment_spans")
    found = (
        table.drop("bytes")
        .join(spans, ["anchor", "c1", "c2"])
        .select("doc_id", "hash", F.expr("transform(spans, s -> struct(start + s.a as a, start + s.b as b))").alias("spans"))
        .groupBy("doc_id", "hash")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    found, _ = written(found, "repeated_spans")
    for p in (path, spans_path):
        drop_scratch(spark, p)
    return found


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


_REMOVED = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def deduped(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents with ``removed``, the maximal runs (a, b) of bytes to remove, and
    ``kept``, the bytes left (binary, as a run may end within a character).

    A null text is empty. Every row is a document, so rows that repeat lose all their
    windows; nothing is kept as a first copy. Only documents that lose bytes are
    shuffled. Columns of these names give way.
    """
    docs = docs.drop("removed", "kept")
    found = repeated_spans(docs, settings, text)
    held = Bitmap(found, "hash")
    hash_, hit = fresh(docs, "_hash"), fresh(docs, "_hit")
    keyed = docs.withColumn(hash_, F.xxhash64(text))
    mark = lambda batch: [pa.array(held.has(batch.column(batch.schema.get_field_index(hash_)).to_numpy()))]
    marked = appended(keyed, [T.StructField(hit, T.BooleanType())], mark)
    doc_, text_, spans_ = (fresh(marked, name) for name in ("_doc", "_text", "_spans"))
    right = found.toDF(doc_, text_, spans_)
    some = marked.where(hit)
    same = some["doc_id"].cast("bigint").eqNullSafe(right[doc_]) & (some[hash_] == right[text_])
    plain = marked.where(~F.col(hit)).withColumn(spans_, F.lit(None).cast(right.schema[spans_].dataType))
    both = some.join(right, same, "left").drop(doc_, text_).unionByName(plain)

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        removed, kept = [], []
        for t, spans in zip(
            batch.column(batch.schema.get_field_index(text)).to_pylist(),
            batch.column(batch.schema.get_field_index(spans_)).to_pylist(),
            strict=True,
        ):
            raw, done, parts = (t or "").encode(), 0, []
            runs = merged(spans or [])
            for a, b in runs:
                parts.append(raw[done:a])
                done = b
            kept.append(b"".join([*parts, raw[done:]]))
            removed.append([{"a": a, "b": b} for a, b in runs])
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return [pa.array(removed, kind), pa.array(kept, pa.binary())]

    fields = [T.StructField("removed", _REMOVED), T.StructField("kept", T.BinaryType())]
    return appended(both, fields, cut, docs.columns)
