"""Vantage-point trees over 64-bit fingerprints by Hamming distance, in numpy.

A node has a vantage point and a radius: what is as near as the radius is inside. By the
triangle bound a query of a reach needs the inside only if its own distance is at most
the radius and the reach together, the outside only if it is more than the radius less
the reach.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_TRIED = 16
_USEFUL = 0.95
_LEAF = 64
_MATRIX = 1 << 20


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


@dataclass(frozen=True)
class Split:
    """Where a node's points go: ``point``, ``radius`` and the nodes of either side, a
    number below zero standing for leaf ``-1 - number``."""

    point: np.uint64
    radius: int
    inside: int
    outside: int


def _split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of some tried, that leave least to compare if all
    points are queries too; none if every one leaves nearly all."""
    best = None
    for k in np.linspace(0, len(points) - 1, min(_TRIED, len(points))).astype(int):
        many = np.cumsum(np.bincount(distance(points, points[k]), minlength=65)) / len(points)
        held = np.concatenate([np.zeros(reach + 1), many, np.ones(reach)])  # held[r + reach + 1]: many[r]
        work = many * held[2 * reach + 1 :][:65] + (1 - many) * (1 - held[1:66])
        radius = int(np.argmin(work))
        if work[radius] < _USEFUL and (best is None or work[radius] < best[0]):
            best = work[radius], points[k], radius
    return best and best[1:]


def shard_tree(sample: np.ndarray, leaf: int, reach: int) -> list[Split]:
    """A tree over a sample whose leaves, the shards, have at most ``leaf`` of its points
    (more where no vantage point parts them); the root is the first node. No node: one shard."""
    nodes: list[Split | None] = []
    leaves = 0

    def grown(points: np.ndarray) -> int:
        nonlocal leaves
        found = _split(points, reach) if len(points) > leaf else None
        if found is None:
            leaves += 1
            return -leaves
        here = len(nodes)
        nodes.append(None)
        near = distance(points, found[0]) <= found[1]
        nodes[here] = Split(*found, grown(points[near]), grown(points[~near]))
        return here

    grown(sample)
    return nodes


def homes(tree: list[Split], points: np.ndarray) -> np.ndarray:
    """The shard each point lies in."""
    found = np.zeros(len(points), np.int32)
    for shard, at in _routed(tree, points, 0):
        found[at] = shard
    return found


def visits(tree: list[Split], points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (by place) and shards that may hold something within their reach."""
    held = list(_routed(tree, points, reach))
    shards = np.concatenate([np.full(len(at), shard, np.int32) for shard, at in held])
    return np.concatenate([at for _, at in held]), shards


def _routed(tree: list[Split], points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    todo = [(0 if tree else -1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            yield -1 - node, at
            continue
        split = tree[node]
        far = distance(points[at], split.point)
        todo.append((split.inside, at[far <= split.radius + reach]))
        todo.append((split.outside, at[far > split.radius - reach]))


def pairs(data: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (place in data, place in queries) within the reach, by a tree over the data
    that all queries descend together."""
    todo = [(np.arange(len(data)), np.arange(len(queries)))]
    while todo:
        held, asked = todo.pop()
        if not len(held) or not len(asked):
            continue
        found = _split(data[held], reach) if len(held) > _LEAF else None
        if found is None:
            for k in range(0, len(asked), max(1, _MATRIX // len(held))):
                some = asked[k : k + max(1, _MATRIX // len(held))]
                near = np.bitwise_count(data[held][:, None] ^ queries[some][None, :]) <= reach
                a, b = np.nonzero(near)
                yield held[a], some[b]
            continue
        point, radius = found
        ours, theirs = distance(data[held], point), distance(queries[asked], point)
        todo.append((held[ours <= radius], asked[theirs <= radius + reach]))
        todo.append((held[ours > radius], asked[theirs > radius - reach]))
