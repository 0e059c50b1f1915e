"""Repetitions of a sequence by a suffix automaton and link-cut access.

The suffixes of a prefix are the strings on the path from its state up the suffix links.
Access to that path takes it apart into segments whose strings ended last at the same
place; the distance from there is the period of a square wherever it is no longer than
the segment's longest string.
"""

from collections.abc import Sequence


def suffix_links(sequence: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The automaton's links (0 for none) and longest lengths by state, from 1 on, and
    the state of every prefix. It is built symbol by symbol; 1 is the empty string."""
    follow: list[dict[int, int]] = [{}, {}]
    link, longest, states = [0, 0], [0, 0], []
    last = 1
    for symbol in sequence:
        new = len(link)
        follow.append({})
        link.append(1)
        longest.append(longest[last] + 1)
        at = last
        while at and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at:
            to = follow[at][symbol]
            if longest[to] != longest[at] + 1:
                split = len(link)
                follow.append(follow[to].copy())
                link.append(link[to])
                longest.append(longest[at] + 1)
                link[to] = split
                while at and follow[at].get(symbol) == to:
                    follow[at][symbol] = split
                    at = link[at]
                to = split
            link[new] = to
        states.append(new)
        last = new
    return link, longest, states


class Paths:
    """Preferred paths of a rooted tree: each is a splay tree by depth, coloured at its
    root with the time of the access that made it, -1 if none did."""

    def __init__(self, parent: list[int]):
        self._up = list(parent)
        self._left, self._right = [0] * len(parent), [0] * len(parent)
        self._colour = [-1] * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right, colour = self._up, self._left, self._right, self._colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                colour[x] = colour[z]
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            else:
                colour[x] = colour[y]
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self._up, self._left, self._right
        y = up[x]
        z = up[y]
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            moved = left[y] = right[x]
            right[x] = y
        else:
            moved = right[y] = left[x]
            left[x] = y
        if moved:
            up[moved] = y
        up[x], up[y] = z, x

    def access(self, node: int, time: int) -> list[tuple[int, int]]:
        """Colour the path from the node to the root with ``time``. Returns the segments
        it had, from the node up: the lowest node of each, and its colour until now."""
        up, right, colour = self._up, self._right, self._colour
        found, below = [], 0
        while node:
            self._splay(node)
            found.append((node, colour[node]))
            if right[node]:
                colour[right[node]] = colour[node]
            right[node] = below
            below, node = node, up[node]
        colour[below] = time
        return found


def runs(sequence: Sequence[int], least: int, repeats: int) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every maximal run of at least ``least``
    symbols and ``repeats`` (two or more) periods, in order.

    Where a run ends, its last occurrence of all but one period is one period back:
    any nearer one would be a smaller period. So that distance is among the segments,
    with the string that begins where the run does. Squares met on the way have the same
    start and period, and the last of them reaches the run's end.
    """
    link, longest, states = suffix_links(sequence)
    paths = Paths(link)
    ends: dict[tuple[int, int], int] = {}
    for end, state in enumerate(states):
        for node, before in paths.access(state, end):
            period = end - before
            if before >= 0 and period <= longest[node]:
                length = longest[node] + period
                if length >= least and length >= repeats * period:
                    ends[end - length + 1, period] = end
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())
