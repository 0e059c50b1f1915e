"""A bitmap of fixed size that tells tasks which rows may matter to a join.

It holds a hash of every key of a table, however many, and so never misses one; rows
that it lets through are joined as usual. It fills up as the table grows and then
lets more rows through, but does not grow itself.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.llm.arrow import fresh

BITS = 24
MOST_BITS = 27


def bits_for(keys: int) -> int:
    """Bits for so many keys: some sixteen for each, 2 MB to 16 MB in all."""
    return min(max((16 * keys).bit_length(), BITS), MOST_BITS)


def _words(frame: DataFrame, hash: str, bits: int) -> DataFrame:
    """The map's 64-bit words that are not 0, 2 ** (``bits`` - 6) rows at most."""
    return (
        frame.selectExpr(f"({hash}) & {(1 << bits) - 1} as spot")
        .selectExpr("shiftright(spot, 6) as word", "shiftleft(1L, cast(spot & 63 as int)) as bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def held_by(
    frame: DataFrame, hash: str, keys: DataFrame, key: str, how: str = "left_semi", bits: int = BITS
) -> DataFrame:
    """Rows of ``frame`` whose ``hash`` the map of the ``key`` of ``keys`` has, or for
    "left_anti" the others. The map is joined, so that rows with texts need not go to a
    Python worker to be looked up."""
    word_, bits_ = fresh(frame, "_map_word"), fresh(frame, "_map_bits")
    spot = f"(({hash}) & {(1 << bits) - 1})"
    on = f"shiftright({spot}, 6) = {word_} and (shiftright({bits_}, cast({spot} & 63 as int)) & 1) = 1"
    return frame.join(F.broadcast(_words(keys, key, bits).toDF(word_, bits_)), F.expr(on), how)


class Bitmap:
    """``frame``: rows whose 64-bit ``hash`` (in SQL) to hold, in a map of 2 ** ``bits``."""

    def __init__(self, frame: DataFrame, hash: str, bits: int = BITS):
        self._mask = (1 << bits) - 1
        words = _words(frame, hash, bits).toPandas()
        held = np.zeros(1 << (bits - 6), np.int64)
        held[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self._held = frame.sparkSession.sparkContext.broadcast(held)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be held."""
        spots = hashes.astype(np.int64) & np.int64(self._mask)
        return (self._held.value[spots >> 6] >> (spots & 63)) & 1 == 1
