"""Texts of an Arrow batch as flat byte arrays, and what numpy finds in them.

A block holds a run of rows of bounded size, so that the arrays derived from it
(10 to 70 bytes for each byte of text) stay small; one text longer than the bound
is a block of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Fields that bytes are hashed in: a prime below 2 ** 31 and a base picked at random.
_FIELDS = [(2**31 - 1, 1_326_974_203), (2**31 - 19, 791_045_617)]
_SUMMED = 1 << 23  # bytes summed before the sum is reduced
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in _FIELDS]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Block:
    """Rows ``first`` to ``first + rows``: their bytes, and where each text starts;
    ``starts`` has one entry more than there are rows."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def row_of(self, places: np.ndarray) -> np.ndarray:
        """The row in the block that each byte position belongs to."""
        return np.searchsorted(self.starts, places, side="right") - 1


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch's texts, null as empty, in blocks of about ``size`` bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield Block(first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end


def _powers(n: int, field: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the field's base and of its inverse, up to n."""
    if len(_POWERS[field][0]) <= n:
        prime, base = _FIELDS[field]
        made = []
        for b in (base, pow(base, -1, prime)):
            found = np.ones(1, np.uint32)
            while len(found) <= n:  # b ** (k + m) = b ** k * b ** m
                more = found[: n + 1 - len(found)] * np.uint64(pow(b, len(found), prime)) % np.uint64(prime)
                found = np.concatenate([found, more.astype(np.uint32)])
            made.append(found)
        _POWERS[field] = made[0], made[1]
    return _POWERS[field]


class ByteHash:
    """62-bit hashes of any substrings of a block, from one pass over its bytes: the
    string as a polynomial, at one place of each of two prime fields."""

    def __init__(self, data: np.ndarray):
        self._held = []
        for field, (prime, _) in enumerate(_FIELDS):
            up, down = _powers(len(data), field)
            sums = np.zeros(len(data) + 1, np.uint64)
            for k in range(0, len(data), _SUMMED):
                part = data[k : k + _SUMMED]
                terms = up[k : k + len(part)] * (part + np.uint64(1))
                np.cumsum(terms, out=sums[k + 1 : k + 1 + len(part)])
                if k:
                    sums[k + 1 : k + 1 + len(part)] += sums[k] % np.uint64(prime)
            self._held.append((sums, down, np.uint64(prime)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = np.zeros(len(starts), np.uint64)
        for sums, down, prime in self._held:
            whole = (sums[ends] % prime + prime - sums[starts] % prime) % prime
            found = found << np.uint64(31) | whole * down[starts] % prime
        return mix(found ^ ((ends - starts).astype(np.uint64) * _BASE))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64  # bytes of a word whose hash is taken from sums over the whole block
_SIZES = mix(np.arange(_LONG + 1, dtype=np.uint64) * _BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, the same in every block. Up to eight bytes are one number, and
    unlike words of one length never equal; longer ones are polynomials with a
    coefficient for every three bytes, at one place of each of two prime fields."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    size = ends - starts
    found = eights[starts] & _MASKS[np.minimum(size, 8)]
    some = np.flatnonzero((size > 8) & (size <= _LONG))
    sums = [np.zeros(len(some), np.uint64) for _ in _FIELDS]
    at, left = starts[some], size[some]
    for done in range(0, int(left.max(initial=0)), 3):
        more = np.flatnonzero(left > done)
        part = (eights[at[more] + done] & _MASKS[np.minimum(left[more] - done, 3)]) + np.uint64(1)
        for held, (prime, base) in zip(sums, _FIELDS, strict=True):
            held[more] = (held[more] * np.uint64(base) + part) % np.uint64(prime)
    found[some] = sums[0] << np.uint64(31) | sums[1]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        found[long] = ByteHash(data)(starts[long], ends[long])
    spread = _SIZES[np.minimum(size, _LONG)]
    if len(long):
        spread[long] = mix(size[long].astype(np.uint64) * _BASE)
    return mix(found ^ spread)


def order_by(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by group, small numbers from 0, and then by 64-bit value: one sort of
    both in 64 bits, unless values differ only in those that this cuts off."""
    bits = np.uint64(max(int(group.max(initial=0)).bit_length(), 1))
    joint = group.astype(np.uint64) << (np.uint64(64) - bits) | values >> bits
    order = np.argsort(joint)
    joint, values_ = joint[order], values[order]
    if ((joint[1:] == joint[:-1]) & (values_[1:] < values_[:-1])).any():
        return np.lexsort((values, group))
    return order


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the substrings, equal ones the same. Hashes say which may be equal, the
    bytes of each and of the first with its hash whether they are."""
    _, first, ids = np.unique(ByteHash(data)(starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[ids]
    if (size == size[like]).all():
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(starts, size) + within] == data[np.repeat(starts[like], size) + within]).all():
            return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)])


@dataclass(frozen=True)
class Words:
    """Words of a block in order: byte spans, hashes, and per row where they start."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block, in_word: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes for which the table ``in_word`` holds, never across
    rows. ``data``: the bytes to hash in place of the block's, as many."""
    starts, ends = _spans(block, looked_up(in_word, block.data))
    hashes = word_hashes(block.data if data is None else data, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, block.starts))


def _spans(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of bytes marked ``inside`` start and end, never across rows."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[block.starts] = True
    at = np.flatnonzero(edge)  # what lies between two of them is all inside or all outside
    within = np.flatnonzero(inside[at[:-1]])
    return at[within], at[within + 1]


def cut_words(block: Block, in_word: np.ndarray, data: np.ndarray | None = None) -> Words:
    """As ``words``, but a run of characters of scripts written without spaces is not
    one word: every two neighbours in it are, and one that stands alone. What else is
    in the run are words as before."""
    at = np.flatnonzero(block.data >= 0xE0)  # where characters of three and four bytes start
    long = block.data[at] >= 0xF0
    byte = lambda k: block.data[np.minimum(at + k, len(block.data) - 1)].astype(np.int32) & 63
    code = (block.data[at].astype(np.int32) & 15) << 12 | byte(1) << 6 | byte(2)
    code = np.where(long, (code & 0x7FFF) << 6 | byte(3), code)
    held = np.searchsorted(_UNSPACED, code, side="right") % 2 == 1
    at, end = at[held], (at + 3 + long)[held]
    if not len(at):
        return words(block, in_word, data)
    inside = looked_up(in_word, block.data).copy()
    for k in range(4):
        inside[(at + k)[at + k < end]] = False
    starts, ends = _spans(block, inside)
    row = block.row_of(at)
    joined = (at[1:] == end[:-1]) & (row[1:] == row[:-1])
    alone = np.ones(len(at), bool)
    alone[1:] &= ~joined
    alone[:-1] &= ~joined
    starts = np.concatenate([starts, at[:-1][joined], at[alone]])
    ends = np.concatenate([ends, end[1:][joined], end[alone]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    hashes = word_hashes(block.data if data is None else data, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, block.starts))


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for bytes and a table of 256 of them, read only."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def table(inside) -> np.ndarray:
    """A table over the 256 byte values from a test of one."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Scripts written without spaces between words, from and to (exclusive): Thai to
#: Myanmar, Khmer, Tai, Balinese, Han, kana, Bopomofo, Yi, Javanese, Cham.
_UNSPACED = np.array(
    [
        0x0E00, 0x10A0, 0x1780, 0x1800, 0x1950, 0x1A00, 0x1A20, 0x1AB0, 0x1B00, 0x1B80, 0x2E80, 0x2FE0, 0x3005, 0x3008,
        0x3021, 0x302A, 0x3031, 0x3036, 0x3040, 0x3130, 0x31A0, 0x31C0, 0x31F0, 0x3200, 0x3400, 0x4DC0, 0x4E00, 0xA4D0,
        0xA980, 0xAAE0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1AFF0, 0x1B170, 0x20000, 0x40000,
    ]
)
#: Bytes of words split at ASCII white space.
NOT_SPACE = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits, and every byte of other characters.
WORD = table(lambda b: b >= 0x80 or chr(b).isalnum())
#: The bytes with A-Z in lower case.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and the index of each one's
    first word. A row of fewer words, but not none, is one run."""
    n = len(hashes)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    index = np.arange(n) - first[rows]
    length = np.minimum(counts, size)[rows]
    begins = np.flatnonzero(index <= counts[rows] - length)
    found = np.zeros(len(begins), np.uint64)
    for k in range(size):
        has = length[begins] > k
        at = np.minimum(begins + k, n - 1)
        found = np.where(has, mix(found * _BASE + hashes[at] + np.uint64(k + 1)), found)
    return found, begins
