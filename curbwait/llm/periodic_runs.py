"""Periodic runs of words: found in each text, and collapsed to one period.

Texts are independent, so there is no shuffle. The automaton works on the stretches of a
text in which a run can lie at all; three words in a row that come too seldom cannot
begin inside one, which takes nearly all prose out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curbwait.llm.arrow import appended, fresh
from curbwait.llm.suffix_automaton import runs

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_KIND = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.fieldNames()]))
_ROUNDS = 8
_BASE, _APART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones the same."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.uint64)


def stretches(ids: np.ndarray, least: int, repeats: int) -> Iterator[tuple[int, int]]:
    """Ranges of words outside which no run lies, and which no run crosses.

    In a run of ``repeats`` periods each three words come in ``repeats`` - 1 places at
    least, if the period is two or more, else in ``least`` - 2. Those that come less
    often in the text, then in their own stretch, and so on, are no part of one. Three
    words are compared by a hash: equal ones agree, and others that agree only make
    stretches longer. Rounds end early; what they would still take out is no run either.
    """
    times = min(least - 2, repeats - 1)
    keys = (ids[:-2] * _BASE + ids[1:-1]) * _BASE + ids[2:]
    at, group = np.arange(len(keys)), np.zeros(len(keys), np.uint64)
    for _ in range(_ROUNDS):
        _, which, many = np.unique(keys[at] ^ (group * _APART), return_inverse=True, return_counts=True)
        often = many[which] >= times
        if len(at) and often.all() and group[-1]:
            break
        at = at[often]
        nth = np.cumsum(np.diff(at, prepend=-2) != 1)
        long = np.bincount(nth)[nth] >= least - 2 if len(at) else often[:0]
        at, group = at[long], nth[long].astype(np.uint64)
        if not len(at):
            return
    cuts = np.flatnonzero(np.diff(at) != 1)
    for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True):
        yield int(a), int(b) + 3


def found(words: list[bytes], least: int, repeats: int) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of the words."""
    if len(words) < least:
        return []
    ids = numbered(words)
    made = []
    for a, b in stretches(ids, least, repeats):
        made += [(a + start, length, period) for start, length, period in runs(ids[a:b].tolist(), least, repeats)]
    return sorted(made, key=lambda r: (r[0], r[2]))


def kept(n: int, held: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run past its first period."""
    left = np.ones(n, bool)
    for start, length, period in held:
        left[start + period : start + length] = False
    return left


def collapsed(
    docs: DataFrame, least: int = 6, repeats: int = 4, keep: list[str] | None = None
) -> DataFrame:
    """The documents' columns, or those in ``keep``, with ``runs`` and ``collapsed``.

    Words are what stands between ASCII white space. A run is a longest stretch of
    words in which those a period apart are equal, of ``least`` words and ``repeats``
    periods at least; it has its smallest period. ``runs`` has start (a word's number),
    length and period, by start, then period; ``collapsed`` the words but those that any
    run holds after its first period, joined by one space. A null or wordless text has no
    run and an empty ``collapsed``. Rows are independent: repeated ones all stay. Where
    the frame has columns of the two names, the new ones get underscores. A text is held
    by one task, with some 300 bytes for each word of its stretches.
    """
    fields = [
        T.StructField(fresh(docs, "runs"), T.ArrayType(RUN)),
        T.StructField(fresh(docs, "collapsed"), T.StringType()),
    ]

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        all_runs, texts = [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            words = (text.as_py() or "").encode().split()  # at ASCII white space only
            held = found(words, least, repeats)
            all_runs.append([dict(zip(RUN.fieldNames(), r, strict=True)) for r in held])
            if held:
                words = [words[k] for k in np.flatnonzero(kept(len(words), held))]
            texts.append(b" ".join(words))
        return [pa.array(all_runs, _KIND), pa.array(texts, pa.binary()).cast(pa.string())]

    return appended(docs, fields, find, keep)
