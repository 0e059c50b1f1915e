"""Near duplicates: BagMinHash signatures, bands, and exact verification.

A document is the multiset of its five-word shingles. Two documents are linked if
the weighted Jaccard similarity, the sum of the smaller counts over the sum of the
larger, is 0.8 or more; a class is a connected component of links. Exact copies of
a text are one node throughout, so a large group of copies costs one row.

1. A BagMinHash signature for every text, and a key for each band of it.
2. Texts that share a band are compared with the one among them that has most
   company, a star and not all pairs, by signature and then exactly.
3. Texts of a band that are still in different classes are joined exactly, on the
   rarest shingles they have among themselves (a prefix filter). What a large group
   of near copies has in common is frequent there, so it makes no pairs.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbwait.llm.arrow import appended, released
from curbwait.llm.bitmap import Bitmap
from curbwait.llm.blocks import LOWER, WORD, Block, blocks, looked_up, mix, runs, words
from curbwait.llm.components import components
from curbwait.session import drop_scratch, written

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POINTS = 1 << 15  # drawn at a time, or one of each process


@dataclass(frozen=True)
class Settings:
    """Shingle length, similarity, signature length (a power of two) and band width.

    With 32 bands of 4 a pair at similarity 0.8 meets in a band with probability
    1 - 5e-8. ``sure`` is the share of equal components below which a pair is not
    verified: 0.6 is 5.6 standard deviations below 0.8.
    """

    words: int = 5
    similarity: float = 0.8
    length: int = 128
    width: int = 4
    sure: float = 0.6


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block: row, hash, count; sorted by both. Words are runs
    of ASCII letters and digits and of all other characters, in lower case; a text
    of fewer words, but not none, is one shingle."""
    w = words(block, WORD, looked_up(LOWER, block.data))
    found, begins = runs(w.hashes, w.first, size)
    rows = w.rows[begins]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(first)
    return rows[at], found[at], np.diff(np.append(at, len(rows)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(
    rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, length: int
) -> np.ndarray:
    """Signatures, one row of ``length`` 32-bit values for each of ``n`` multisets.

    The weight axis of every shingle is cut at the powers of two into intervals
    [0, 1), [1, 2), [2, 4), ...; each carries a Poisson process whose rate is its
    width, seeded by shingle and interval only. A point in time has a weight within
    its interval, and counts if that lies below the shingle's count, and a slot of
    the signature, which keeps its earliest point. Two multisets keep the same point
    in a slot with a probability equal to their weighted Jaccard similarity. A
    process is followed only until it is later than every slot of its multiset.
    """
    tops = np.maximum(np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)
    each = tops + 1
    source = np.repeat(np.arange(len(rows)), each)
    level = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each)
    row, count = rows[source], counts[source]
    low = np.where(level == 0, 0, np.int64(1) << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    seed = mix(hashes[source] ^ mix(level.astype(np.uint64) * _GOLD + np.uint64(7)))
    earliest = np.full(n * length, np.inf)
    time = np.zeros(len(row))
    latest = np.full(n, np.inf)
    done, steps = 0, 1
    while len(row):
        points = seed[:, None] + (np.arange(done, done + steps, dtype=np.uint64) * _GOLD)[None, :]
        draws = mix(points)
        gaps = -np.log(_uniform(draws)) / width[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        place = mix(draws ^ _GOLD)
        slot = (place & np.uint64(length - 1)).astype(np.int64)
        weight = low[:, None] + ((place >> np.uint64(32)) % width[:, None].astype(np.uint64)).astype(np.int64)
        counts_too = (weight < count[:, None]) & (times < latest[row][:, None])
        at = (row[:, None] * length + slot)[counts_too]
        np.minimum.at(earliest, at, times[counts_too])
        latest = earliest.reshape(n, length).max(axis=1)
        time = times[:, -1]
        going = time < latest[row]
        row, count, low, width, seed, time = (x[going] for x in (row, count, low, width, seed, time))
        done += steps
        steps = max(1, min(32, _POINTS // max(len(row), 1)))
    out = (mix(earliest.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out.reshape(n, length)


def node(text: str = "text") -> str:
    """A text's 128-bit identity, in SQL; null for null."""
    return f"unhex(md5({text}))"


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``node``, ``sig`` and ``bands``, the last two null without words."""
    fields = [T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    length, width = settings.length, settings.width

    def of_block(block: Block) -> tuple[list, list]:
        rows, hashes, counts = shingles(block, settings.words)
        has, compact = np.unique(rows, return_inverse=True)
        found = bag_min_hash(compact, hashes, counts, len(has), length)
        parts = found.reshape(len(has), length // width, width).astype(np.uint64)
        keys = np.broadcast_to(np.arange(length // width, dtype=np.uint64), parts.shape[:2])
        keys = mix(keys + np.uint64(1))
        for k in range(width):
            keys = mix(keys * _GOLD + parts[:, :, k])
        sigs: list = [None] * block.rows
        bands: list = [None] * block.rows
        for k, r in enumerate(has):
            sigs[r] = found[k].tobytes()
            bands[r] = keys[k].view(np.int64)
        return sigs, bands

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        sigs, bands = [], []
        for block in blocks(batch.column(batch.schema.get_field_index("text"))):
            s, b = of_block(block)
            sigs += s
            bands += b
        return [pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    return appended(docs.selectExpr("doc_id", "text", f"{node()} as node"), fields, find, ["doc_id", "node"])


def _alike(pairs: DataFrame, sigs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose signatures agree in a share ``sure`` of the components."""
    least = settings.sure * settings.length
    a, b = sigs.selectExpr("node as a", "sig as sig_a"), sigs.selectExpr("node as b", "sig as sig_b")

    def run(batches):
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, settings.length)
                for c in ("sig_a", "sig_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.join(a, "a").join(b, "b").mapInArrow(released(run), "a binary, b binary")


def _bag_table(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and ``bag`` (its shingles with each repeat as one of its own, sorted
    64-bit values) for the given nodes. A bitmap of them, of fixed size, is sent to
    the tasks; what passes it is shingled and joined, so texts are not shuffled."""
    held = Bitmap(nodes, "xxhash64(node)")

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(held.has(batch.column("hash").to_numpy())))
            nodes_, bags = some.column("node").to_pylist(), []
            for block in blocks(some.column("text")):
                rows, hashes, counts = shingles(block, settings.words)
                rows, bags_ = np.repeat(rows, counts), _occurrences(hashes, counts)
                order = np.lexsort((bags_, rows))
                cuts = np.searchsorted(rows, np.arange(block.rows + 1))
                flat = bags_[order]
                bags += [flat[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes_, pa.binary()), pa.array(bags, pa.binary())], ["node", "bag"]
            )

    found = (
        docs.where("text is not null")
        .selectExpr("text", f"{node()} as node")
        .selectExpr("text", "node", "xxhash64(node) as hash")
        .mapInArrow(released(run), "node binary, bag binary")
    )
    return found.dropDuplicates(["node"]).join(nodes, "node", "left_semi")


def _occurrences(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each hash as often as it counts, every repeat a value of its own."""
    repeat = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(hashes, counts) + repeat.astype(np.uint64) * _GOLD)


def _verified(pairs: DataFrame, bags: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of the required similarity, computed from the whole bags; shingles are
    compared by the 64-bit hashes of their words, mixed."""
    a, b = bags.selectExpr("node as a", "bag as bag_a"), bags.selectExpr("node as b", "bag as bag_b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= settings.similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(released(run), "a binary, b binary")


def _across(bags: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of nodes of different components that may be similar: they share one of
    their rarest shingles, and their sizes and what they can share after it allow it.
    ``bags``: node, component, bag.

    A similar pair shares one of the first ``size - ceil(similarity * size) + 1``
    shingles of each, in any one order; the order is by frequency among these bags.
    Nodes of one component that share a shingle are met as a group, not in pairs, and
    first the groups are compared by the bounds of their members.
    """

    def run(batches):
        for batch in batches:
            for n, c, bag in zip(*(batch.column(x).to_pylist() for x in ("node", "component", "bag")), strict=True):
                tokens = np.frombuffer(bag, np.int64)
                k = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * k, pa.binary()), pa.array([c] * k, pa.binary()), pa.array(np.full(k, k)), pa.array(tokens)],
                    ["node", "component", "size", "token"],
                )

    tokens, path = written(
        bags.select("node", "component", "bag").mapInArrow(released(run), "node binary, component binary, size long, token long"),
        "tokens",
    )
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # a shingle of one bag only is first in order and makes no pair: count those, rank the others
    shared = tokens.join(often, "token")
    alone = tokens.groupBy("node").agg(F.count(F.lit(1)).alias("all_"))
    common = shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared_"))
    singles = alone.join(common, "node").selectExpr("node", "all_ - shared_ as alone")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "token"))
    t = settings.similarity
    need = f"size - ceil({t} * size - 1e-9) + 1"
    # reach: what a bag can share from here on, if this is the first it shares
    prefix, prefix_path = written(
        shared.withColumn("rank", rank)
        .join(singles, "node")
        .where(f"rank + alone <= {need}")
        .selectExpr("token", "component", "node", "size", "size - rank - alone + 1 as reach"),
        "prefix",
    )
    groups = prefix.groupBy("token", "component").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("far")
    )

    def able(low_a, high_a, far_a, low_b, high_b, far_b):
        return f"""{high_a} >= {t}D * {low_b} - 1e-9D and {high_b} >= {t}D * {low_a} - 1e-9D
            and {1 + t}D * least({far_a}, {far_b}) >= {t}D * ({low_a} + {low_b}) - 1e-9D"""

    met = (
        groups.toDF("token", "ca", "low_a", "high_a", "far_a")
        .join(groups.toDF("token", "cb", "low_b", "high_b", "far_b"), "token")
        .where(f"ca < cb and {able('low_a', 'high_a', 'far_a', 'low_b', 'high_b', 'far_b')}")
        .select("token", "ca", "cb", "low_b", "high_b", "far_b")
    )
    found = (
        met.join(prefix.toDF("token", "ca", "a", "size_a", "reach_a"), ["token", "ca"])
        .where(able("size_a", "size_a", "reach_a", "low_b", "high_b", "far_b"))
        .join(prefix.toDF("token", "cb", "b", "size_b", "reach_b"), ["token", "cb"])
        .where(able("size_a", "size_a", "reach_a", "size_b", "size_b", "reach_b"))
        .select("a", "b")
        .distinct()
    )
    found, found_path = written(found, "pairs")
    for p in (path, prefix_path):
        drop_scratch(bags.sparkSession, p)
    return found


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id``, ``node`` (the text's identity, null for a
    null text), ``class`` (the smallest node of its class), ``class_id`` (its smallest
    doc_id) and ``size`` (its rows).

    Documents without a word, null and empty texts among them, are alone, with a null
    ``class``. Rows with one text are one node, however often they repeat; a class of
    rows without any doc_id has none. Other columns are not read.
    """
    spark = docs.sparkSession
    signed, signed_path = written(signatures(docs, settings), "signatures")
    distinct = signed.where("sig is not null").dropDuplicates(["node"])
    keyed = distinct.select("node", F.explode("bands").alias("band"))
    company = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    shared, shared_path = written(keyed.join(company, "band"), "bands")

    near = shared.groupBy("node").agg(F.sum("company").alias("near"))
    hubs = (
        shared.join(near, "node")
        .groupBy("band")
        .agg(F.max(F.struct("near", "node")).alias("top"))
        .selectExpr("band", "top.node as b")
    )
    star = shared.join(hubs, "band").where("node <> b").selectExpr("node as a", "b").distinct()
    pairs, pairs_path = written(_alike(star, distinct.select("node", "sig"), settings), "pairs")
    bags = _bag_table(docs, pairs.selectExpr("a as node").union(pairs.selectExpr("b")).distinct(), settings)
    links, links_path = written(_verified(pairs, bags, settings), "links")
    first = components(links)

    placed = shared.join(first, "node", "left").selectExpr("band", "node", "coalesce(component, node) as component")
    placed, placed_path = written(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = placed.join(mixed, "band", "left_semi").select("node", "component").distinct()
    open_, open_path = written(open_, "open")
    rest = _bag_table(docs, open_.select("node"), settings).join(open_, "node")
    rest, rest_path = written(rest, "bags")
    more = _verified(_across(rest, settings), rest.select("node", "bag"), settings)
    final = components(links.union(more))

    groups = signed.select("doc_id", "node", F.col("sig").isNotNull().alias("worded"))
    held = groups.join(final, "node", "left").withColumn(
        "class", F.when(F.col("worded"), F.coalesce("component", "node"))
    )
    whole = held.where("worded").groupBy("class").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size"))
    result = held.join(whole, "class", "left").selectExpr(
        "doc_id", "node", "class", "if(worded, low, doc_id) as class_id", "coalesce(size, 1L) as size"
    )
    for path in (shared_path, pairs_path, links_path, placed_path, open_path, rest_path):
        drop_scratch(spark, path)
    return result


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without near duplicates: of each class the row with the lowest
    doc_id stays, a row without one last; of rows with equal id and text any one."""
    names = docs.columns
    found = near_duplicates(docs, settings).where("size > 1").groupBy("node").agg(F.first("class").alias("class"))
    held = docs.select(F.struct(*names).alias("row"), F.expr(node()).alias("node"), "doc_id")
    held = held.join(found, "node", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    firsts = held.where("class is not null").groupBy("class").agg(F.min_by("row", order).alias("row"))
    return held.where("class is null").select("row.*").unionByName(firsts.select("row.*"))
