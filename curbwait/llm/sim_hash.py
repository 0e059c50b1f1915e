"""Near duplicates by SimHash: components of fingerprints a few bits apart.

Equal fingerprints are one row first. The others are dealt to the leaves of a
vantage-point tree, and to every leaf beyond their own that a point within the reach may
lie in; each leaf searches a tree of its own and hands back a forest of its links.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.llm import vantage
from curbwait.llm.arrow import fresh
from curbwait.llm.components import components
from curbwait.llm.fingerprints import SHINGLE, fingerprinted
from curbwait.session import drop_scratch, written

REACH = 2
#: Fingerprints that a leaf holds by itself, and how many at most are looked at to
#: choose the vantage points: some for each leaf.
LEAF = 1 << 14
SAMPLE = 1 << 20
_PER_LEAF, _LEAST = 256, 16
_HOT = 1000


def links(points: DataFrame, reach: int = REACH, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links ``a``, ``b`` that join the fingerprints ``point`` (different longs) as all
    pairs within the reach do.

    The tree over the leaves is grown from 256 points a leaf, picked by a hash, and from
    ``sample`` at most; so it has at most a sixteenth as many nodes, and tasks deal every
    point with it.
    Of a pair in two leaves the one in the lesser leaf visits the other. A point has at
    most 64 + 2016 others within two bits, so a leaf's pairs grow with its points.
    A leaf sorts its points, as which of many links a forest has depends on their order,
    and a shuffle's rows come in another one each time they are read.
    """
    wanted = -(-points.count() // leaf)
    size = min(sample, _PER_LEAF * wanted)
    rate = size / max(1, wanted * leaf)
    picked = points.where(f"pmod(xxhash64(point, 1), {1 << 31}) < {int(rate * (1 << 31))}").select("point")
    held = np.sort(picked.limit(2 * size).toArrow().column(0).to_numpy()) if wanted > 1 else np.zeros(0, np.int64)
    tree = vantage.shard_tree(held.view(np.uint64), max(_LEAST, len(held) // max(1, wanted)), reach)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                home = vantage.homes(shared.value, own)
                at, shard = vantage.visits(shared.value, own, reach)
                useful = shard >= home[at]
                at, shard = at[useful], shard[useful]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(own[at].view(np.int64)), pa.array(shard == home[at])],
                    names=["shard", "point", "home"],
                )

    def search(shard: pa.Table) -> pa.Table:
        own = shard.column("point").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False)
        data = np.sort(own[home])
        nodes = np.concatenate([data, np.sort(own[~home])])
        root = forest(nodes, len(data), reach)
        apart = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": nodes[root[apart]].view(np.int64), "b": nodes[apart].view(np.int64)})

    dealt = points.select("point").mapInArrow(deal, "shard int, point long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def forest(nodes: np.ndarray, data: int, reach: int) -> np.ndarray:
    """For each node the least node of its tree, linking the first ``data`` nodes to all
    within the reach of one of them."""
    root = np.arange(len(nodes))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in vantage.pairs(nodes[:data], nodes, reach):
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
    while (root[root] != root).any():
        root = root[root]
    return root


def near_duplicates(
    docs: DataFrame,
    reach: int = REACH,
    shingle: int = SHINGLE,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents' columns, or those in ``keep``, with ``fingerprint`` (long) and
    ``component_id``, the smallest doc_id that links of fingerprints at most ``reach``
    bits apart lead to.

    A null text and one without words have the fingerprint zero and are linked by it as
    others are. Rows without a doc_id belong to components, which take no id from them:
    null if no row of the component has one. Repeated rows all stay. Where the frame has columns of
    the two names, the new ones get underscores.
    """
    mark, found = fresh(docs, "fingerprint"), fresh(docs, "component_id")
    rows, _ = written(fingerprinted(docs, mark, sorted({*(keep or docs.columns), "doc_id"})), "fingerprints")
    points, _ = written(
        rows.groupBy(F.col(mark).alias("point")).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("many")),
        "points",
    )
    found_links, links_path = written(links(points, reach, leaf, sample), "links")  # read twice
    linked = components(found_links)
    drop_scratch(docs.sparkSession, links_path)
    joined = points.join(linked, points["point"] == linked["node"], "left").selectExpr(
        "point", "low", "many", "coalesce(component, point) as component"
    )
    least = joined.groupBy("component").agg(F.min("low").alias("least"))
    names, _ = written(joined.join(least, "component").select("point", "least", "many"), "components")
    return _named(rows, names, mark, found).select(*(keep or docs.columns), mark, found)


def _named(rows: DataFrame, names: DataFrame, mark: str, found: str) -> DataFrame:
    """Rows with the component of their fingerprint. Fingerprints of more than a
    thousandth of the rows each, a thousand at most, are broadcast, and their rows are
    not shuffled."""
    point, least = fresh(rows, "point"), fresh(rows, found)
    total = names.agg(F.sum("many")).first()[0] or 0
    named = names.select(F.col("point").alias(point), F.col("least").alias(least), "many")
    often = F.broadcast(named.where(F.col("many") * _HOT > total).drop("many"))
    rare = named.where(F.col("many") * _HOT <= total).drop("many")
    same = F.col(mark) == F.col(point)
    return rows.join(often, same).union(rows.join(often, same, "left_anti").join(rare, same))
