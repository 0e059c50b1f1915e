"""A HAT-trie of word-id strings: counts in hash containers under a shallow trie."""

import numpy as np

BITS = 21
#: Words that ids can number, zero left out.
IDS = (1 << BITS) - 1
_DIGIT = 7
_BURST = 16_384


def packed(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the ``size`` ids from each place on, the first one highest; those of one size
    are as their id strings in order."""
    keys = np.zeros(len(at), np.int64)
    for k in range(size):
        keys = keys << BITS | ids[at + k]
    return keys


def unpacked(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The ids of keys, a column for each place."""
    return [keys >> BITS * (size - 1 - k) & IDS for k in range(size)]


class _Node(dict):
    """Containers or further nodes by the digit at ``shift``."""

    def __init__(self, shift: int):
        super().__init__()
        self.shift = shift


class HatTrie:
    """Counts of phrases of ``size`` words, one to three, by packed key.

    Ids are read as digits, three to a word. A container is a hash of all keys below a
    prefix; one that grows beyond 16,384 entries bursts into a node with a container for
    each next digit, so frequent first words come to have subtrees of their own.
    """

    def __init__(self, size: int):
        self._top = BITS * size - _DIGIT
        self._root: dict = {}
        self.entries = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different keys, in order."""
        if len(keys):
            self._root = self._into(self._root, self._top, keys, counts)

    def _into(self, child: dict, shift: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        """The child, or the node it burst into, with the counts added."""
        if isinstance(child, _Node):
            for digit, a, b in _by_digit(keys, shift):
                child[digit] = self._into(child.get(digit, {}), shift - _DIGIT, keys[a:b], counts[a:b])
            return child
        before, held = len(child), child.get
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            child[key] = held(key, 0) + n
        self.entries += len(child) - before
        return _burst(child, shift) if len(child) > _BURST and shift >= 0 else child

    def _leaves(self, node: dict, place: tuple) -> list[tuple]:
        if not isinstance(node, _Node):
            return [(len(node), place)]
        return [leaf for digit in node for leaf in self._leaves(node[digit], (node, digit))]

    def spill(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole containers, the largest first, until at most ``left`` entries are
        held: their keys and counts as one sorted run."""
        taken = []
        if not isinstance(self._root, _Node):
            if self.entries > left:
                taken, self._root = [self._root], {}
        else:
            over = self.entries - left
            for many, (node, digit) in sorted(self._leaves(self._root, ()), key=lambda leaf: -leaf[0]):
                if over <= 0:
                    break
                taken.append(node.pop(digit))
                over -= many
            if left <= 0:
                self._root = {}
        self.entries -= sum(map(len, taken))
        keys = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(c, np.int64, len(c)) for c in taken)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(c.values(), np.int64, len(c)) for c in taken)])
        order = np.argsort(keys)
        return keys[order], counts[order]


def _by_digit(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Digits at the shift, and from where to where in the sorted keys each is."""
    digits = keys >> shift & ((1 << _DIGIT) - 1)
    bounds = [0, *(np.flatnonzero(np.diff(digits)) + 1).tolist(), len(keys)]
    return list(zip(digits[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True))


def _burst(container: dict[int, int], shift: int) -> _Node:
    keys = np.fromiter(container, np.int64, len(container))
    order = np.argsort(keys)
    keys, counts = keys[order], np.fromiter(container.values(), np.int64, len(container))[order]
    node = _Node(shift)
    for digit, a, b in _by_digit(keys, shift):
        node[digit] = dict(zip(keys[a:b].tolist(), counts[a:b].tolist(), strict=True))
    return node
