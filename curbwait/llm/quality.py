"""Quality rules: an ordered decision list learned from labelled documents.

``text_stats`` takes counts of every whole text. ``learn`` grows and prunes rules,
each a conjunction of thresholds on ratios of those counts, by sequential covering
on a bounded sample of labelled documents. ``DecisionList.verdict`` is the list as
one Spark conditional expression.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbwait.llm.arrow import appended, fresh
from curbwait.llm.blocks import NOT_SPACE, blocks, numbered, table, words

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_bars",
    "n_marks",
    "n_distinct_words",
    "n_long_words",
]
_SYMBOLS = table(lambda b: b in b"#*$%&|<>")
_UPPER = table(lambda b: 0x41 <= b <= 0x5A)
_DIGIT = table(lambda b: 0x30 <= b <= 0x39)
_BAR = table(lambda b: b == 0x7C)
_MARK = table(lambda b: b in b"!?")
_LEADING = table(lambda b: not 0x80 <= b < 0xC0)

#: What rules test: a name and a quotient of counts.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "bars": ("n_bars", "n_words"),
    "marks": ("n_marks", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "long_words": ("n_long_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


def later(values: np.ndarray) -> np.ndarray:
    """Which values equal one before them."""
    out = np.ones(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = False
    return out


def _of_block(block) -> np.ndarray:
    data, starts, n = block.data, block.starts, block.rows
    found = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return found
    put = lambda name, values: found.__setitem__((slice(None), COUNTS.index(name)), values)

    def among(inside: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(inside)])
        return sums[starts[1:]] - sums[starts[:-1]]

    w = words(block, NOT_SPACE)
    rows, ids = w.rows, numbered(data, w.starts, w.ends)
    put("n_words", np.diff(w.first))
    put("word_chars", among(NOT_SPACE[data] & _LEADING[data]))
    for name, inside in (
        ("n_symbols", _SYMBOLS),
        ("n_upper", _UPPER),
        ("n_digits", _DIGIT),
        ("n_bars", _BAR),
        ("n_marks", _MARK),
    ):
        put(name, among(inside[data]))
    put("n_distinct_words", np.bincount(rows[~later(ids * n + rows)], minlength=n))
    put("n_long_words", np.bincount(rows[w.ends - w.starts > 20], minlength=n))

    # lines with a word, and those equal to an earlier one of their row
    breaks = np.flatnonzero(data == 0x0A)
    opens = np.union1d(starts[:-1], breaks + 1)
    opens = opens[opens < len(data)]
    closes = np.minimum(
        np.append(breaks, len(data))[np.searchsorted(breaks, opens)],
        starts[np.searchsorted(starts, opens, side="right")],
    )
    worded = np.searchsorted(w.starts, closes) > np.searchsorted(w.starts, opens)
    opens, closes = opens[worded], closes[worded]
    of = block.row_of(opens)
    put("n_lines", np.bincount(of, minlength=n))
    put("n_dup_lines", np.bincount(of[later(numbered(data, opens, closes) * n + of)], minlength=n))

    # words in three-word windows that the row has twice or more
    covered = np.zeros(len(rows), bool)
    begins = np.flatnonzero(rows[2:] == rows[:-2])
    if len(begins):
        kinds = int(ids.max()) + 1
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        windows = np.unique(pairs[begins] * kinds + ids[begins + 2], return_inverse=True)[1]
        begins = begins[repeated(windows * n + rows[begins])]
        for k in range(3):
            covered[begins + k] = True
    put("n_repeat_words", np.bincount(rows[covered], minlength=n))
    return found


def text_stats(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in ``keep`` (default all) with a struct ``stats`` of COUNTS.

    Words are split at ASCII white space. A null text has none, like an empty one;
    equal rows get equal counts; the longest text must fit a task's memory some 40
    times. If a column ``stats`` is there already, the new one is ``stats_``.
    """

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text))
        parts = [_of_block(b) for b in blocks(texts, 1 << 18)]
        counts = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *parts])
        return [pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()], COUNTS)]

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return appended(docs, [T.StructField(fresh(docs, "stats"), kind)], find, keep)


def base_failed(stats: str) -> Column:
    """Too few words, or most of them in repeated windows."""
    return F.expr(f"{stats}.n_words < 50 or 100 * {stats}.n_repeat_words > 50 * {stats}.n_words")


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document one of them covers is rejected. A rule is a tuple
    of (ratio, is it a lower bound, threshold)."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]

    def verdict(self, stats: str) -> Column:
        """Is the document kept? The first rule that holds decides, else yes."""
        cases = [
            " and ".join(
                f"coalesce({stats}.{RATIOS[name][0]} / nullif({stats}.{RATIOS[name][1]}, 0), 0D)"
                f" {'>=' if least else '<='} {value!r}D"
                for name, least, value in rule
            )
            for rule in self.rules
        ]
        if not cases:
            return F.lit(True)
        return F.expr(f"case {' '.join(f'when {c} then false' for c in cases)} else true end")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """COUNTS and ``good`` of at most ``most`` labelled documents, picked by a hash of
    their id; of repeated ids one document is taken, and the lowest label."""
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `most` ids
    return (
        text_stats(chosen, ["doc_id", "_good"])
        .groupBy("doc_id")
        .agg(F.min(F.struct("stats", "_good")).alias("one"))
        .selectExpr("doc_id", "one.stats.*", "one._good as good")
    )


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000, purity: float = 0.9) -> DecisionList:
    """Learn rules for ``labels.quality`` 0 by sequential covering.

    ``most`` bounds the labelled documents that are fitted on. Each round grows a
    rule on two thirds of the documents not yet covered, condition by condition,
    prunes its last conditions on the other third, and keeps it if at least a share
    ``purity`` of what it covers there is labelled 0. No labels, or none of 0: no
    rules, and nothing is rejected.
    """
    rows = labelled_sample(docs, labels, most).orderBy("doc_id").toPandas()  # at most `most` rows
    good = rows["good"].to_numpy() > 0
    top = {name: rows[a].to_numpy(float) for name, (a, _) in RATIOS.items()}
    low = {name: rows[b].to_numpy(float) for name, (_, b) in RATIOS.items()}
    values = np.column_stack(
        [np.divide(top[n], low[n], out=np.zeros(len(rows)), where=low[n] > 0) for n in RATIOS]
    )
    order = np.random.default_rng(0).permutation(len(rows))
    return _cover(values[order], ~good[order], purity)


def _cover(values: np.ndarray, bad: np.ndarray, purity: float) -> DecisionList:
    names, rules = list(RATIOS), []
    grow = np.arange(len(bad)) % 3 < 2
    open_ = np.ones(len(bad), bool)
    while len(rules) < 12 and bad[open_ & grow].sum() >= 5:
        rule = _grow(values[open_ & grow], bad[open_ & grow])
        rule = _prune(rule, values[open_ & ~grow], bad[open_ & ~grow])
        covered = open_ & _holds(rule, values)
        checked = covered & ~grow
        if not rule or checked.sum() < 3 or bad[checked].mean() < purity or bad[covered].mean() < purity:
            break
        rules.append(tuple((names[k], least, float(v)) for k, least, v in rule))
        open_ &= ~covered
    return DecisionList(tuple(rules))


def _holds(rule, values: np.ndarray) -> np.ndarray:
    inside = np.ones(len(values), bool)
    for k, least, at in rule:
        inside &= values[:, k] >= at if least else values[:, k] <= at
    return inside


def _grow(values: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    """Conditions that each gain most information, until only bad rows are left."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < 4 and (~bad[inside]).any():
        best, before = (0.0, None), np.log2(max(bad[inside].mean(), 1e-9))
        for k in range(values.shape[1]):
            column = values[inside, k]
            for least in (True, False):
                order = np.argsort(-column if least else column, kind="stable")
                ranked, hits = column[order], np.cumsum(bad[inside][order])
                ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], False))
                if not len(ends):
                    continue
                gain = hits[ends] * (np.log2(np.maximum(hits[ends], 1e-9) / (ends + 1)) - before)
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-9:
                    middle = (ranked[ends[at]] + ranked[ends[at] + 1]) / 2
                    best = (gain[at], (k, least, middle))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds([best[1]], values)
    return rule


def _prune(rule, values: np.ndarray, bad: np.ndarray):
    """The beginning of the rule that is worth most on rows it was not grown on."""
    def worth(part):
        inside = _holds(part, values)
        hit, miss = bad[inside].sum(), (~bad[inside]).sum()
        return (hit - miss) / max(hit + miss, 1)

    return max((rule[: n + 1] for n in range(len(rule))), key=lambda part: (worth(part), -len(part)), default=[])


def judged(docs: DataFrame, rules: DecisionList, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``stats``, ``base_failed`` and ``kept``, false if the base
    failed and else what the rules say. Clashing columns of these names give way."""
    found = text_stats(docs.drop("stats", "base_failed", "kept"), keep)
    found = found.withColumn("base_failed", base_failed("stats"))
    return found.withColumn("kept", ~F.col("base_failed") & rules.verdict("stats"))
