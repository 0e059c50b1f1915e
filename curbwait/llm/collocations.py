"""Phrases of two and three words that come more often than their parts would have it.

Phrases are counted by size, one word first: a longer one is counted only where both
phrases of one word less, without its last and without its first word, may be frequent.
Every task counts in HAT-tries, spills whole subtrees as sorted runs when they fill up,
and Spark merges the runs. A partition of that merge has the phrases of one hash, so that
the subtree of a frequent first word is dealt to many.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from curbwait.llm.bitmap import Bitmap, bits_for
from curbwait.llm.hat_trie import HatTrie, packed, unpacked
from curbwait.session import written

LONGEST = 3
_SEED = 42
_SALTS = 16
_CHUNK = 1 << 20  # bytes of text cut into words at once
_STEP = 1 << 18  # words numbered at once
_WORDS = 1 << 19  # words that a vocabulary holds before it is given up
_ENTRIES = 600_000  # phrases that a task's tries hold

#: Every sign that ends a piece becomes a full stop, which is then a word of its own.
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def words_of(texts: list[bytes]) -> Iterator[bytes]:
    """The words of the texts, A-Z lowered, and ``.`` between two pieces."""
    return b" . ".join(texts).lower().translate(_MARKS).replace(b".", b" . ").split()


class _Vocabulary(dict):
    """Numbers of words from 1 on, 0 for the end of a piece, and their hashes."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]
        self.hashes = array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxh64_intdigest(word, _SEED))
        return number


class _Counter:
    """Phrases of a language in one task."""

    def __init__(self, lang: str, size: int, passing: Bitmap | None):
        self.lang, self._size, self._passing = lang, size, passing
        self._lang = np.uint64(xxh64_intdigest(lang.encode(), _SEED))
        self.vocabulary, self.trie, self.total = _Vocabulary(), HatTrie(size), 0

    def add(self, words: list[bytes]) -> None:
        """Count the phrases that begin among the first ``_STEP`` of the words."""
        known = self.vocabulary
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        begins = ids[:_STEP] if len(ids) > _STEP else ids
        self.total += int(np.count_nonzero(begins))
        at = np.flatnonzero(begins[: max(0, len(ids) - self._size + 1)])
        for k in range(1, self._size):
            at = at[ids[at + k] != 0]
        if self._passing is not None:
            hashes = np.array(known.hashes, np.uint64)[ids]
            shorter = hashes
            for k in range(1, self._size - 1):
                shorter = _turned(shorter[:-1]) ^ hashes[k:]
            may = self._passing.has((shorter ^ self._lang).view(np.int64))
            at = at[may[at] & may[at + 1]]
        keys, counts = np.unique(packed(ids, at, self._size), return_counts=True)
        self.trie.add(keys, counts)

    def spilled(self, left: int) -> Iterator[pa.RecordBatch]:
        """A run of subtrees taken out of the trie, as rows."""
        keys, counts = self.trie.spill(left)
        words = pa.array(self.vocabulary.words, pa.binary())
        for k in range(0, len(keys), 1 << 16):
            columns = [words.take(pa.array(c)) for c in unpacked(keys[k : k + (1 << 16)], self._size)]
            phrases = pc.binary_join_element_wise(*columns, b" ") if self._size > 1 else columns[0]
            yield _rows(self.lang, phrases, counts[k : k + (1 << 16)])


def _turned(hashes: np.ndarray) -> np.ndarray:
    return hashes << np.uint64(21) | hashes >> np.uint64(43)


def _rows(lang: str, phrases: pa.Array, counts) -> pa.RecordBatch:
    langs = pa.repeat(pa.scalar(lang, pa.string()), len(phrases))
    return pa.RecordBatch.from_arrays(
        [langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())],
        names=["lang", "phrase", "n"],
    )


def phrase_hash(size: int) -> str:
    """In SQL, the hash that tasks look a phrase of this size up by."""
    found = "xxhash64(split(phrase, ' ')[0])"
    for k in range(1, size):
        found = f"((shiftleft({found}, 21) | shiftrightunsigned({found}, 43)) ^ xxhash64(split(phrase, ' ')[{k}]))"
    return f"({found} ^ xxhash64(lang))"


def counted(docs: DataFrame, size: int, passing: Bitmap | None = None) -> DataFrame:
    """``lang``, ``phrase`` and ``n`` for the phrases of ``size`` words, those left out
    that ``passing`` shows to hold a shorter one it has not; for one word also how many
    there are in all, as the phrase without words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}

        def taken(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
            words = words_of(texts)
            counter = counters.setdefault(lang, _Counter(lang, size, passing))
            for k in range(0, len(words), _STEP):
                counter.add(words[k : k + _STEP + size - 1])
                if len(counter.vocabulary) > _WORDS:
                    yield from counter.spilled(0)
                    counter.vocabulary = _Vocabulary()
            while sum(c.trie.entries + len(c.vocabulary) for c in counters.values()) > _ENTRIES + _WORDS:
                most = max(counters.values(), key=lambda c: c.trie.entries)
                if most.trie.entries:
                    yield from most.spilled(most.trie.entries // 4)
                else:  # words of languages that are not counted now
                    for each in counters.values():
                        each.vocabulary = _Vocabulary()

        for batch in batches:
            held: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append((text.as_py() or "").encode())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] > _CHUNK:
                    yield from taken(held.pop(lang), lang)
                    del sizes[lang]
            for lang in list(held):
                yield from taken(held.pop(lang), lang)
        for counter in counters.values():
            yield from counter.spilled(0)
            if size == 1:
                yield _rows(counter.lang, pa.array([b""], pa.binary()), [counter.total])

    runs = docs.selectExpr("coalesce(lang, 'und') as lang", "text").mapInArrow(count, "lang string, phrase string, n long")
    # runs are counted already, so rows are dealt out as they are and merged there
    return runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int) -> list[DataFrame]:
    """For one to three words the phrases that come ``least`` times, as written tables;
    the first has the number of all words besides, as the phrase without any."""
    found, passing = [], None
    for size in range(1, LONGEST + 1):
        often = counted(docs, size, passing).where((F.col("n") >= least) | (F.col("phrase") == ""))
        found.append(written(often, f"phrases{size}")[0])
        if size < LONGEST:
            held = found[-1].where("phrase <> ''")
            passing = Bitmap(held, phrase_hash(size), bits_for(held.count()))
    return found


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """The ``most`` phrases of each language, ranked: ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n``, ``score``.

    A text is cut into pieces at ``. , ; : ! ?`` and line ends, those into words at spaces
    and tabs; A-Z is lowered. A phrase of two or three words in a piece that comes ``a`` >=
    ``least`` times is cut where the score, floor(10^6 a a / (l r)), is lowest (the first
    such place); l and r count the two parts, n all words of the language. It is left out
    if a longer phrase of ``least`` or more holds it in at least ``share`` % of its
    places. Order: score, a, both from the greatest, then the phrase by its bytes.

    A null lang is ``und``; null, empty and wordless texts have no phrase; repeated rows
    count each; other columns are not read; no documents give no rows. A language with
    no such phrase has none. Arithmetic is in decimals of 38 digits, exact up to counts
    of 10^15.
    """
    one, two, three = frequent(docs, least)
    inner = three.selectExpr(
        "lang",
        "n",
        "explode(array(substring_index(phrase, ' ', 2), substring_index(phrase, ' ', -2))) as phrase",
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = two.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * n")
    scored = _scored(alone.drop("longer").unionByName(three), one, two)
    best = _first(scored, most)
    words = one.where("phrase = ''").selectExpr("lang", "n")
    return best.join(words, "lang").selectExpr("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score``, at the lowest cut. The counts of
    single words are there once for each salt, as many phrases share a frequent word."""
    cuts = f"""filter(transform(sequence(1, {LONGEST - 1}), k -> struct(k as k,
        substring_index(phrase, ' ', k) as left, substring_index(phrase, ' ', k - words) as right)), c -> c.k < words)"""
    salt = f"if(instr(part, ' ') = 0, pmod(xxhash64(phrase), {_SALTS}), 0L) as salt"
    parts = (
        phrases.selectExpr("lang", "phrase", "n as a", "size(split(phrase, ' ')) as words")
        .selectExpr("lang", "phrase", "a", f"inline({cuts})")
        .selectExpr("lang", "phrase", "a", "k", "stack(2, 'l', left, 'r', right) as (side, part)")
        .selectExpr("*", salt)
    )
    single = one.where("phrase <> ''").selectExpr("lang", "phrase as part", "n as held", f"explode(sequence(0L, {_SALTS - 1}L)) as salt")
    held = single.unionByName(two.selectExpr("lang", "phrase as part", "n as held", "0L as salt"))
    joined = parts.join(held, ["lang", "part", "salt"])
    exact = lambda c: f"cast({c} as decimal(19))"
    score = f"({exact('a')} * {exact('a')} * 1000000) div ({exact('l')} * {exact('r')})"
    return (
        joined.groupBy("lang", "phrase", "a", "k")
        .agg(F.expr("max(if(side = 'l', held, null)) as l"), F.expr("max(if(side = 'r', held, null)) as r"))
        .groupBy("lang", "phrase", "a")
        .agg(F.expr(f"min(struct({score} as score, k, l, r)) as low"))
        .selectExpr("lang", "phrase", "a", "low.l as l", "low.r as r", "low.score as score")
    )


def _first(scored: DataFrame, most: int) -> DataFrame:
    """The first rows of each language with their ``rank``: those of each of 64 parts
    first, so that no task orders a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    parts = scored.withColumn("_part", F.expr("pmod(hash(phrase), 64)"))
    best = parts.withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= most).drop("_nth", "_part")
    ranked = best.withColumn("rank", F.row_number().over(whole).cast("long"))
    return ranked.where(F.col("rank") <= most)
