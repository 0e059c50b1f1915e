"""Language identification by prediction by partial matching.

For each language a byte context tree of order three, with counts frozen after
training. A byte costs the code length of its symbol in the longest context that has
seen it, and an escape for every longer context that has not (method C, without
exclusion). A text is in the language that codes it shortest. Bytes are coded as 64
symbols: letters without case, white space, digits, other ASCII, and the bytes of
other characters that are frequent in training.
"""

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbwait.llm.arrow import appended
from curbwait.llm.blocks import blocks

ORDER = 3
_SYMBOLS = 64
#: Symbols: 0 starts a text, 1-26 letters, 27 white space, 28 digits, 29 other ASCII,
#: 30 other bytes, 31 to 63 frequent bytes of 0x80 and over.
_PLAIN = np.array(
    [
        27 if b in (9, 10, 11, 12, 13, 32) else 28 if 48 <= b <= 57 else (b | 32) - 96
        if chr(b | 32).isalpha() and b < 128 else 29 if b < 128 else 30
        for b in range(256)
    ],
    np.int64,
)


@dataclass(frozen=True)
class Settings:
    """``documents`` bounds the training documents of a language, picked by a hash of
    the text; ``contexts`` bounds the strings of four symbols kept for each language,
    the most frequent ones. Every language is learned."""

    documents: int = 3_000
    contexts: int = 100_000


@dataclass(frozen=True)
class Model:
    """Languages, the symbol of each byte, and counts of strings of four symbols."""

    languages: list[str]
    symbols: np.ndarray
    counts: list[tuple[np.ndarray, np.ndarray]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _grams(block, symbols: np.ndarray) -> np.ndarray:
    """For every byte the four symbols that end in it, as a number; before a text's
    start they are 0."""
    s = symbols[block.data]
    found = s.copy()
    place = np.arange(len(s)) - np.repeat(block.starts[:-1], np.diff(block.starts))
    for k in range(1, ORDER + 1):
        earlier = np.zeros(len(s), np.int64)
        earlier[k:] = s[:-k]
        found |= np.where(place >= k, earlier, 0) << (6 * k)
    return found


def _sample(docs: DataFrame, text: str, lang: str, settings: Settings) -> DataFrame:
    """Training documents: of each language about ``documents``, by a hash."""
    spread = F.pmod(F.xxhash64(F.lit(11), text), F.lit(1 << 30)) / float(1 << 30)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), spread.alias("spread"))
    labelled = labelled.where("text is not null and lang is not null")
    many = labelled.groupBy("lang").agg((F.lit(settings.documents) / F.count(F.lit(1))).alias("share"))
    # a row for each language, as in the model
    return labelled.join(F.broadcast(many), "lang").where("spread < share").select("text", "lang")


def train(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Count contexts in a bounded sample of the labelled documents.

    The driver gets at most ``contexts`` counts for each language. Documents without
    text or language are not learned from; without any left there are no languages.
    """
    sample = _sample(docs, text, lang, settings)

    def bytes_of(batches):
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                counts += np.bincount(block.data, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(counts)], ["byte", "n"])

    often = sample.mapInArrow(bytes_of, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    ranked = sorted((-r["n"], r["byte"]) for r in often.where("byte >= 128 and n > 0").collect())
    symbols = _PLAIN.copy()
    for k, (_, byte) in enumerate(ranked[: _SYMBOLS - 31]):
        symbols[byte] = 31 + k

    def grams_of(batches):
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                mine = batch.filter(pa.array([n == name for n in names]))
                grams = np.concatenate([_grams(b, symbols) for b in blocks(mine.column("text"))] or [np.zeros(0, np.int64)])
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"]
                )

    counted = (
        sample.mapInArrow(grams_of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )

    def most(key, table):
        grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        kept = np.sort(grams[np.lexsort((grams, -n))[: settings.contexts]])
        order = np.argsort(grams)
        held = n[order[np.searchsorted(grams, kept, sorter=order)]]
        return pa.table({"lang": [key[0].as_py()], "grams": [kept.astype(np.int32).tobytes()], "counts": [held.tobytes()]})

    # a language has at most _SYMBOLS ** 4 strings, and one row here
    rows = counted.groupBy("lang").applyInArrow(most, "lang string, grams binary, counts binary").collect()
    languages, counts = [], []
    for r in sorted(rows, key=lambda r: r["lang"]):
        languages.append(r["lang"])
        counts.append((np.frombuffer(r["grams"], np.int32), np.frombuffer(r["counts"], np.int64)))
    return Model(languages, symbols, counts)


@dataclass(frozen=True)
class Order:
    """Strings of ``size`` symbols that a language has, sorted, and their code lengths;
    their contexts, and what an escape from each costs."""

    size: int
    strings: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    def over(self, grams: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths in this order, from those in the shorter one."""
        s = grams & (_SYMBOLS**self.size - 1)
        at, known = _place(self.strings, s)
        context, met = _place(self.contexts, s >> 6)
        return np.where(known, self.bits[at], shorter + np.where(met, self.escapes[context], np.float32(0)))


def _place(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values wanted are in a sorted array, and whether they are."""
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return at, held[at] == wanted


def _order(size: int, grams: np.ndarray, n: np.ndarray) -> Order:
    strings, which = np.unique(grams & (_SYMBOLS**size - 1), return_inverse=True)
    counts = np.bincount(which, weights=n)
    contexts, which = np.unique(strings >> 6, return_inverse=True)
    total, kinds = np.bincount(which, weights=counts), np.bincount(which)
    bits = -np.log2(counts / (total + kinds)[which])
    escapes = -np.log2(kinds / (total + kinds))
    return Order(
        size, strings.astype(np.int32), bits.astype(np.float32), contexts.astype(np.int32), escapes.astype(np.float32)
    )


class Costs:
    """Code lengths in bits, for every language from the strings it has: of known ones,
    and for others an escape from the context and the cost in the shorter one. A
    language takes memory by its contexts."""

    def __init__(self, model: Model):
        self.orders = [[_order(k + 1, g, n) for k in range(ORDER + 1)] for g, n in model.counts]

    def bits(self, grams: np.ndarray, lang: int) -> np.ndarray:
        """Code lengths of the last symbols of strings in a language."""
        found = np.full(len(grams), np.log2(_SYMBOLS), np.float32)
        for order in self.orders[lang]:
            found = order.over(grams, found)
        return found

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of strings in every language."""
        grams = grams.astype(np.int32)
        return np.stack([self.bits(grams, k) for k in range(len(self.orders))], axis=1)

    def totals(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths of texts, which start at ``starts``, in every language. Each
        different string is looked up once for a language."""
        number = np.zeros(_SYMBOLS ** (ORDER + 1), np.int32)
        number[grams] = 1
        different = np.flatnonzero(number).astype(np.int32)
        number[different] = np.arange(len(different), dtype=np.int32)
        which = number[grams]
        found = np.empty((len(starts), len(self.orders)))
        for k in range(len(self.orders)):
            found[:, k] = np.add.reduceat(self.bits(different, k)[which], starts, dtype=np.float64)
        return found


_built: dict[str, Costs] = {}


def _costs(key: str, held) -> Costs:
    """The worker's cost tables, of one model at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Costs(held.value)
    return _built[key]


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in ``keep`` with ``lang_pred`` and ``score``.

    The score is the probability of the language given the text, all languages being
    equally likely before. A null text, one without a letter, and every text if no
    language was learned, are ``und`` with score 0. Equal texts get equal answers;
    ties go to the first language by name. Columns of these names give way.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    key, languages = model.key, model.languages

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        costs = _costs(key, held)
        names, scores = [], []
        texts = batch.column(batch.schema.get_field_index(text))
        for block in blocks(texts, 1 << 20):
            letter = np.zeros(block.rows, bool)
            alpha = np.concatenate([[0], np.cumsum((model.symbols[block.data] >= 1) & (model.symbols[block.data] <= 26))])
            letter[:] = alpha[block.starts[1:]] > alpha[block.starts[:-1]]
            for r in np.flatnonzero(~letter):
                held_text = texts[block.first + int(r)].as_py()
                letter[r] = bool(held_text) and any(map(str.isalpha, held_text))
            total = np.zeros((block.rows, len(languages)))
            if len(block.data) and languages:
                has = np.flatnonzero(np.diff(block.starts))
                total[has] = costs.totals(_grams(block, model.symbols), block.starts[has])
            if languages:
                over = total - total.min(axis=1, keepdims=True)
                score = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
                best = total.argmin(axis=1)
            for r in range(block.rows):
                sure = letter[r] and languages
                names.append(languages[best[r]] if sure else "und")
                scores.append(float(score[r]) if sure else 0.0)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return appended(docs, fields, find, keep)
