"""Suffix arrays by induced sorting, in numpy, to a stated depth.

Suffixes are classified as smaller (S) or larger (L) than the one after; the leftmost
S suffixes of each run (LMS) are sorted and all others induced from them in two linear
sweeps over the symbols. A sweep takes a bucket at a time, in as many vector steps as
the longest run of its symbol.
"""

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than the next? The last symbol is the smallest of all."""
    n = len(text)
    ahead = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(ahead[::-1])[::-1]
    found = np.ones(n, bool)
    found[:-1] = text[nearest + 1] > text[nearest]
    return found


def _deal(text: np.ndarray, places: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append places to the lists of their symbols, in order."""
    if not len(places):
        return
    symbols = text[places]
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for part in np.split(places, cuts):
        into[text[part[0]]].append(part)


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes, given that of the LMS ones among equal symbols."""
    none = np.zeros(0, np.int32)
    joined = lambda parts: np.concatenate(parts) if parts else none
    starts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _deal(text, seeds, starts)

    def before(places: np.ndarray, kind: bool) -> np.ndarray:
        places = places[places > 0] - 1
        return places[smaller[places] == kind]

    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols):
        done, queue = [], joined(larger[c])
        while len(queue):
            done.append(queue)
            found = before(queue, False)
            same = text[found] == c
            _deal(text, found[~same], larger)
            queue = found[same]
        larger[c] = done
        _deal(text, before(joined(starts[c]), False), larger)
    lesser: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    lesser[text[-1]].append(np.array([len(text) - 1], np.int32))
    for c in reversed(range(symbols)):
        done, queue = [], joined(lesser[c])
        while len(queue):
            done.append(queue)
            found = before(queue, True)
            same = text[found] == c
            _deal(text, found[~same], lesser)
            queue = found[same]
        lesser[c] = done
        _deal(text, before(joined(larger[c])[::-1], True), lesser)
    return np.concatenate([x for c in range(symbols) for x in (joined(larger[c]), joined(lesser[c])[::-1])])


def _names(text: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, by their position; ``order`` has them sorted."""
    end = np.append(first[1:], len(text) - 1)
    at_place = np.empty(len(text), np.int32)
    at_place[first] = np.arange(len(first))
    of = at_place[order]
    length = end[of] - order + 1
    same = length[1:] == length[:-1]
    at = np.flatnonzero(same)
    for k in range(int(length.max(initial=0))):
        at = at[length[at] > k]
        equal = text[order[at] + k] == text[order[at + 1] + k]
        same[at[~equal]] = False
        at = at[equal]
        if not len(at):
            break
    ranks = np.empty(len(first), np.int64)
    ranks[of] = np.concatenate([[0], np.cumsum(~same)])
    return ranks


def _doubled(ranks: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the LMS suffixes to a depth in symbols, from those of LMS substrings: those
    that share a rank are ranked by the one after, at twice the distance each time. A
    rank is the place of its first suffix in order, so that other ranks stay."""
    m, gap = len(ranks), 1
    many = np.bincount(ranks)
    ranks, tied = (np.cumsum(many) - many)[ranks], np.flatnonzero(many[ranks] > 1)
    while len(tied):
        reach = first[np.minimum(tied + gap, m - 1)] - first[tied]
        if (reach[tied + gap < m] >= depth).all():
            break
        after = np.zeros(len(tied), np.int64)
        inner = tied + gap < m
        after[inner] = ranks[tied[inner] + gap] + 1
        keys = ranks[tied] * (m + 1) + after
        order = np.argsort(keys)
        tied, keys = tied[order], keys[order]
        start = np.ones(len(tied), bool)  # of ranks as they will be, and as they were
        start[1:] = keys[1:] != keys[:-1]
        was = ranks[tied]
        former = np.ones(len(tied), bool)
        former[1:] = was[1:] != was[:-1]
        place = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(start, place, 0))
        ranks[tied] = was + begin - np.maximum.accumulate(np.where(former, place, 0))
        alone = start & np.append(start[1:], True)
        tied, gap = tied[~alone], 2 * gap
    return ranks


def suffix_array(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, which is right as far as ``depth``
    symbols; suffixes equal so far are next to each other. ``text`` holds symbols below
    ``symbols`` and ends with a 0 that is nowhere else."""
    smaller = _smaller(text)
    first = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    rough = _induced(text, smaller, first, symbols)
    leftmost = np.zeros(len(text), bool)
    leftmost[first] = True
    ranks = _names(text, rough[leftmost[rough]], first)
    ranks = _doubled(ranks, first, depth)
    return _induced(text, smaller, first[np.argsort(ranks, kind="stable")], symbols)


def repeats(data: np.ndarray, order: np.ndarray, length: int, able: np.ndarray) -> np.ndarray:
    """Which positions have ``length`` bytes in common with their neighbour in the
    order, either side: common prefixes in text order, followed only while they hold.
    ``able``: positions that have so many bytes."""
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(able & (before >= 0))
    places = places[able[before[places]]]
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    eight = sum(padded[k : len(data) + k] << np.uint64(8 * k) for k in range(8))
    steps = [*range(0, length - 7, 8), length - 8]
    for k in steps:
        places = places[eight[places + k] == eight[before[places] + k]]
    found = np.zeros(len(data), bool)
    found[places] = True
    found[before[places]] = True
    return found
