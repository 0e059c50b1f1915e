"""Line dedup: an exact set-similarity join of the lines of all documents.

A line is the set of its words, and is removed if an earlier line, by (doc_id, line
number), has a Jaccard similarity of 0.8 or more with it. Lines of equal sets are
collapsed first. Of each set left the rarest words are looked up: two similar sets
share one of those (prefix filter), have about equal sizes (length filter), can still
reach the overlap after the shared word (positional filter), and differ in few bits of
a 128-bit map. What passes is verified on all words, each compared by 64 bits.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.llm.arrow import fresh, released
from curbwait.llm.bitmap import Bitmap, held_by
from curbwait.llm.blocks import LOWER, WORD, Block, blocks, cut_words, looked_up, mix, order_by
from curbwait.session import drop_scratch, written

BUCKETS = 24
_CHUNK = 14
_WORDS = 1_000_000  # counted at a time in a task
_HELD = 100_000  # postings or lines dealt out at a time in a task
_POSTINGS = 100_000  # looked through at a time in a task
_COMPARED = 1_000_000  # words of pairs compared at a time in a task
_LAST = np.iinfo(np.int64).max  # in place of a null doc_id
#: A row for a word of a set, see ``postings``.
_POSTING = np.dtype(
    [(n, "<i8") for n in ("token", "id", "doc_id", "size_line")] + [("b1", "<u8"), ("b2", "<u8"), ("place", "<i4")]
)

#: A row for a line: its set, and its place; of no doc_id, ``doc_id`` is 0 and ``last`` 1.
_LINE = np.dtype([(n, "<i8") for n in ("s1", "s2", "doc_id", "hash")] + [("line", "<i4"), ("last", "i1")])


@dataclass(frozen=True)
class Settings:
    """Similarity, and how many candidates of a set are verified before the rest of them."""

    similarity: float = 0.8
    most: int = 16


@dataclass(frozen=True)
class Lines:
    """Lines of a block with words: row, number, and their distinct words by line, in
    the order ``lines`` gives them; ``first`` has where each line's begin, and one entry
    more."""

    row: np.ndarray
    number: np.ndarray
    token: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    def ids(self) -> np.ndarray:
        """A 128-bit identity of each line's set, as two columns."""
        if not len(self.row):
            return np.zeros((2, 0), np.int64)
        parts = [np.add.reduceat(mix(self.token + np.uint64(k)), self.first[:-1]) for k in (1, 2)]
        return mix(np.array(parts)).view(np.int64)

    def some(self, which: np.ndarray) -> "Lines":
        """The lines marked."""
        size = self.size
        first = np.append(0, np.cumsum(size[which]))
        return Lines(self.row[which], self.number[which], self.token[np.repeat(which, size)], first)


def lines(block: Block, rarity: np.ndarray | None = None) -> Lines:
    """Words are runs of ASCII letters and digits and of all other characters, in
    lower case, and in scripts written without spaces two neighbouring characters;
    lines end at line feeds. A line's words are in the order of their hashes, or of
    ``rarity`` and then those."""
    w = cut_words(block, WORD, looked_up(LOWER, block.data))
    n, feeds = len(w.starts), np.flatnonzero(block.data == 0x0A)
    begins = np.zeros(n + 1, bool)
    begins[w.first] = True
    begins[np.searchsorted(w.starts, feeds)] = True
    at = np.flatnonzero(begins[:n])
    row = np.searchsorted(w.first, at, side="right") - 1
    number = np.searchsorted(feeds, w.starts[at]) - np.searchsorted(feeds, block.starts)[row]
    line = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
    group = line if rarity is None else line << 8 | rarity[_bucket(w.hashes)]
    order = order_by(group, w.hashes)
    token = w.hashes[order]  # and the line of each is as before
    distinct = np.ones(n, bool)
    distinct[1:] = token[1:] != token[:-1]
    distinct[at] = True
    return Lines(row, number, token[distinct], np.append(0, np.cumsum(distinct))[np.append(at, n)])


def _bucket(token: np.ndarray) -> np.ndarray:
    """The hash buckets of words that are counted."""
    return (token >> np.uint64(64 - BUCKETS)).astype(np.int64)


def line_table(docs: DataFrame, settings: Settings) -> DataFrame:
    """All lines with words. Those after an equal set among the lines dealt out with them
    have ``doc_id``, ``hash`` (of the text) and ``line``; the others are in ``held``, in
    a row for each ``bucket`` of sets. And rows with a ``chunk`` of the hash buckets of
    words and ``counts``, how many lines have words of each."""
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = np.uint64(64 - max(least, 1023).bit_length())

    def table(part: dict) -> pa.RecordBatch:
        n = len(next(iter(part.values())))
        return pa.RecordBatch.from_arrays([part.get(f.name, pa.nulls(n, f.type)) for f in made], schema=made)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        chunks, first = np.unique(found >> _CHUNK, return_index=True)
        pairs = np.empty(len(found), _COUNT)
        pairs["at"], pairs["n"] = found & ((1 << _CHUNK) - 1), n
        return table({"chunk": pa.array(chunks.astype(np.int32)), "counts": _binaries(pairs, first)})

    def dealt(found: list[np.ndarray]):
        whole = np.concatenate(found)
        first = _at_first(whole)
        yield table(_places(whole[~first]))
        whole = whole[first]
        keys, rows = _dealt(whole, whole["s1"], shift)
        yield table({"bucket": keys, "held": rows})

    def run(batches):
        held: list[np.ndarray] = []
        laid: list[np.ndarray] = []
        for batch in batches:
            docs_ = batch.column("doc_id")
            last, doc = docs_.is_null().to_numpy(zero_copy_only=False), docs_.fill_null(0).to_numpy()
            texts = batch.column("hash").to_numpy()
            for block in blocks(batch.column("text")):
                found = lines(block)
                held.append(_bucket(found.token).astype(np.int32))
                if sum(map(len, held)) >= _WORDS:
                    yield counted(held)
                    held = []
                row, out = found.row + block.first, np.empty(len(found.row), _LINE)
                out["s1"], out["s2"] = found.ids()
                out["doc_id"], out["hash"], out["last"] = doc[row], texts[row], last[row]
                out["line"] = found.number
                laid.append(out)
                if sum(map(len, laid)) >= _HELD:
                    yield from dealt(laid)
                    laid = []
        if sum(map(len, held)):
            yield counted(held)
        if sum(map(len, laid)):
            yield from dealt(laid)

    kinds = {"doc_id": pa.int64(), "hash": pa.int64(), "line": pa.int32(), "bucket": pa.int32(), "held": pa.binary()}
    made = pa.schema(kinds | {"chunk": pa.int32(), "counts": pa.binary()})
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as hash").mapInArrow(
        released(run), "doc_id long, hash long, line int, bucket int, held binary, chunk int, counts binary"
    )


def _at_first(rows: np.ndarray) -> np.ndarray:
    """Which lines are at the first place that their set is at among them."""
    found = np.ones(len(rows), bool)
    s1 = np.ascontiguousarray(rows["s1"])
    order = np.argsort(s1)
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = s1[order[1:]] == s1[order[:-1]]
    some = order[same[1:] | same[:-1]]
    if len(some):
        keys = [rows[c][some] for c in ("line", "doc_id", "last", "s2", "s1")]
        by_set = np.lexsort(keys)
        *place, s2, s1 = (k[by_set] for k in keys)
        begins = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
        first = np.maximum.accumulate(np.where(begins, np.arange(len(s1)), 0))
        found[some[by_set]] = np.logical_and.reduce([c == c[first] for c in place])
    return found


def _places(rows: np.ndarray) -> dict[str, pa.Array]:
    return {
        "doc_id": pa.array(rows["doc_id"], mask=rows["last"] == 1),
        "hash": pa.array(rows["hash"]),
        "line": pa.array(rows["line"]),
    }


def _dealt(rows: np.ndarray, values: np.ndarray, shift: np.uint64) -> tuple[pa.Array, pa.Array]:
    """The buckets by the upper bits of ``values``, and the rows of each."""
    bucket = (values.view(np.uint64) >> shift).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    return pa.array(keys), _binaries(rows[order], first)


_COUNT = np.dtype([("at", "<u2"), ("n", "<u4")])


def _binaries(rows: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows as bytes, in pieces that begin at ``first``."""
    offsets = np.append(first, len(rows)).astype(np.int64) * rows.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]
    ).cast(pa.binary())


def _groups(batches, key: str, held: str, kind: np.dtype):
    """Of batches sorted by ``key``: each key, and the rows in all its pieces."""
    now, parts = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        pieces = batch.column(held)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if keys[i] != now and parts:
                yield now, np.concatenate(parts)
                parts = []
            now = keys[i]
            parts += [np.frombuffer(x.as_buffer(), kind).copy() for x in pieces[i:j]]
    if parts:
        yield now, np.concatenate(parts)


def word_rarity(table: DataFrame) -> tuple[np.ndarray, int]:
    """How many lines of the ``line_table`` have a word, by hash bucket: a byte each, 0 for
    a bucket with one word once, and else rising with the logarithm of the count; and how
    many words lines have in all."""

    def pack(batches):
        for chunk, counts in _groups(batches, "chunk", "counts", _COUNT):
            n = np.bincount(counts["at"], counts["n"], 1 << _CHUNK)  # whole numbers, exact
            dense = np.minimum(np.ceil(np.log2(np.maximum(n, 1)) * 8), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([int(n.sum())]), pa.array([dense.tobytes()])],
                ["chunk", "n", "held"],
            )

    laid = table.where("chunk is not null").select("chunk", "counts").repartition(F.col("chunk"))
    graded = laid.sortWithinPartitions("chunk").mapInArrow(released(pack), "chunk int, n long, held binary")
    found, words = np.zeros(1 << BUCKETS, np.uint8), 0
    for r in graded.collect():  # 2 ** BUCKETS bytes at most
        found[r["chunk"] << _CHUNK : (r["chunk"] + 1) << _CHUNK] = np.frombuffer(r["held"], np.uint8)
        words += r["n"]
    return found, words


def postings(
    docs: DataFrame,
    rarity: np.ndarray,
    settings: Settings,
    buckets: int,
) -> DataFrame:
    """The rarest words of every set: ``token``, the set's ``id`` and ``size``, where a
    line with it is (``doc_id``, ``line``), the word's ``place`` in the order by rarity,
    and a bit map ``b1``, ``b2``. A row has those of a ``bucket`` of tokens, of a stretch
    of text.

    A word that is once in all texts has its place but no posting. A set comes once from
    each block, its first line, and sets that can only equal others not at all.
    """
    held = docs.sparkSession.sparkContext.broadcast(rarity)
    share, shift = settings.similarity, np.uint64(64 - buckets.bit_length() + 1)

    def of_block(block: Block, ids_: np.ndarray) -> np.ndarray:
        found = lines(block, held.value)
        able = np.floor(found.size / share + 1e-9) > found.size
        found = found.some(able)
        ids = found.ids()
        doc = ids_[found.row + block.first]
        by_place = np.lexsort((found.number, doc, ids[0]))
        once = np.ones(len(doc), bool)
        once[by_place[1:][ids[0][by_place[1:]] == ids[0][by_place[:-1]]]] = False
        found, ids, doc = found.some(once), ids[0][once], doc[once]
        if not len(ids):
            return np.empty(0, _POSTING)
        size, starts = found.size, found.first[:-1]
        line = np.repeat(np.arange(len(size)), size)
        spread = mix(found.token + np.uint64(3))
        bit = np.uint64(1) << (spread & np.uint64(63))
        high = (spread >> np.uint64(6)) & np.uint64(1) == 1
        b1 = np.bitwise_or.reduceat(np.where(high, np.uint64(0), bit), starts)
        b2 = np.bitwise_or.reduceat(np.where(high, bit, np.uint64(0)), starts)
        place = np.arange(len(line)) - found.first[line]
        prefix = size - np.ceil(share * size - 1e-9).astype(np.int64) + 1
        kept = np.flatnonzero(place < prefix[line])
        kept = kept[held.value[_bucket(found.token[kept])] > 0]
        token = found.token[kept].view(np.int64)
        at = line[kept]
        out = np.empty(len(kept), _POSTING)
        out["token"], out["id"], out["doc_id"], out["place"] = token, ids[at], doc[at], place[kept]
        out["size_line"], out["b1"], out["b2"] = size[at] << 32 | found.number[at], b1[at], b2[at]
        return out

    def dealt(rows: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([*_dealt(whole, whole["token"], shift)], ["bucket", "held"])

    def run(batches):
        rows: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
            for block in blocks(batch.column("text")):
                rows.append(of_block(block, ids))
                if sum(map(len, rows)) >= _HELD:
                    yield dealt(rows)
                    rows = []
        if sum(map(len, rows)):
            yield dealt(rows)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        released(run), "bucket int, held binary"
    )


def candidates(held: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (``v``, ``u``) of set ids that share a token and pass the filters, ``u``
    standing before ``v``, each with the document it is in, and ``more``.

    Of a token's sets one is compared with the first of all, then with those before it,
    nearest first, until ``most`` have passed; ``more`` says that others are left. So
    what a token makes is in proportion to its sets, also where all are alike. Rows
    without a pair have the postings, ``left``, of tokens where some are left. A task
    reads its buckets one after the other, and looks through some tokens of one at a time
    and no fewer than one.
    """

    def run(batches):
        for _, rows in _groups(batches, "bucket", "held", _POSTING):
            rows = _laid(rows)
            while len(rows):
                # some rows, up to the last of a token
                last = rows["token"][min(_POSTINGS, len(rows)) - 1]
                cut = int(np.searchsorted(rows["token"], last, side="right"))
                v, u, more, left = _passing(rows[:cut], settings, settings.most)
                yield _pairs(rows, v, u, pa.array(more), pa.nulls(len(v), pa.binary()))
                if len(left):
                    none = np.zeros(1, np.int64)
                    yield _pairs(rows, none, none, pa.nulls(1, pa.bool_()), pa.array([left.tobytes()]))
                rows = rows[cut:]

    sorted_ = held.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return sorted_.mapInArrow(released(run), "v long, doc_v long, u long, doc_u long, more boolean, left binary")


def candidates_left(left: DataFrame, settings: Settings, probes: Bitmap) -> DataFrame:
    """All such pairs in the postings ``left``, ``v`` one of the sets in ``probes``."""

    def run(batches):
        for batch in batches:
            for x in batch.column("left"):
                rows = np.frombuffer(x.as_buffer(), _POSTING)
                v, u, _, _ = _passing(rows, settings, None, probes)
                yield _pairs(rows, v, u)

    return left.mapInArrow(released(run), "v long, doc_v long, u long, doc_u long")


def _pairs(rows: np.ndarray, v: np.ndarray, u: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    ident, doc = rows["id"], rows["doc_id"]
    docs = (pa.array(doc[k], mask=doc[k] == _LAST) for k in (v, u))
    made = [pa.array(ident[v]), next(docs), pa.array(ident[u]), next(docs), *more]
    return pa.RecordBatch.from_arrays(made, ["v", "doc_v", "u", "doc_u", "more", "left"][: len(made)])


def _laid(rows: np.ndarray) -> np.ndarray:
    """Postings by token and place; no tokens of one row, and of equal sets of a token the
    first."""
    token = np.ascontiguousarray(rows["token"])
    order = np.argsort(token)
    token = token[order]
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = token[1:] == token[:-1]
    held = same[1:] | same[:-1]
    order, token = order[held], token[held]
    if not len(order):
        return rows[order]
    group = np.append(0, np.cumsum(token[1:] != token[:-1]))
    order = order[_by_place(group, rows["doc_id"][order], rows["size_line"][order] & 0xFFFFFFFF)]
    ident = rows["id"][order].view(np.uint64)
    by_set = order_by(group, ident)
    g, i = group[by_set], ident[by_set]
    begins = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])))
    return rows[order[np.sort(np.minimum.reduceat(by_set, begins))]]


def _passing(
    rows: np.ndarray, settings: Settings, most: int | None, probes: Bitmap | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that pass the filters, v after u; whether others of that v are left;
    and the rows of tokens where some are."""
    t = settings.similarity
    token, doc = (np.ascontiguousarray(rows[c]) for c in ("token", "doc_id"))
    size, line = rows["size_line"] >> 32, rows["size_line"] & 0xFFFFFFFF
    b1, b2 = (np.ascontiguousarray(rows[c]) for c in ("b1", "b2"))
    n = len(token)
    head = np.ones(n, bool)
    head[1:] = token[1:] != token[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # similar sets have (1 + t) * reach >= t * (sum of their sizes), for the reach of each
    most_, own = (1 + t) * (size - rows["place"]) - t * size + 1e-9, t * size
    count, pairs = np.zeros(n, np.int64), []
    active = np.flatnonzero(~head)
    if probes:
        active = active[probes.has(rows["id"][active])]

    def tested(v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Where v and u may be similar; a filter has what those before let through."""
        at = np.flatnonzero((most_[v] >= own[u]) & (most_[u] >= own[v]))
        v, u = v[at], u[at]
        both = size[v] + size[u]
        apart = np.bitwise_count(b1[v] ^ b1[u]).astype(np.int64) + np.bitwise_count(b2[v] ^ b2[u])
        some = np.flatnonzero((1 + t) * (both - apart) >= 2 * t * both - 1e-9)
        at, v, u = at[some], v[some], u[some]
        return at[(doc[u] < doc[v]) | (line[u] < line[v])]

    good = tested(active, first[active])
    pairs.append((active[good], first[active[good]]))
    back, stopped = 1, np.zeros(n, bool)
    active = active[active - back > first[active]]
    while len(active):
        good = tested(active, active - back)
        hit = active[good]
        pairs.append((hit, hit - back))
        count[hit] += 1
        back += 1
        active = active[active - back > first[active]]
        if most is not None and len(hit):
            full = count[active] >= most
            stopped[active[full]] = True
            active = active[~full]
    v, u = (np.concatenate(c) for c in zip(*pairs, strict=True))
    marked = np.zeros(n, bool)
    marked[first[stopped]] = True
    return v, u, stopped[v], rows[marked[first]]


def _by_place(group: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by group, document and line: one sort if they have 63 bits in all."""
    known, doc_ = np.unique(doc, return_inverse=True)
    bits = [int(line.max()).bit_length(), len(known).bit_length()]
    if int(group.max()).bit_length() + sum(bits) > 63:
        return np.lexsort((line, doc, group))
    return np.argsort((group << bits[1] | doc_) << bits[0] | line)


def _sets_of(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``s1``, ``s2`` and the words, as sorted 64-bit values, of the sets with the ids
    wanted. Only documents that may be named beside them are split into words."""
    held = Bitmap(wanted, "id")

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = lines(block)
                ids = found.ids()
                hit = np.flatnonzero(held.has(ids[0]))
                hit = hit[np.unique(ids[0][hit], return_index=True)[1]]
                sets = [found.token[found.first[k] : found.first[k + 1]].tobytes() for k in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[0][hit]), pa.array(ids[1][hit]), pa.array(sets, pa.binary())], ["s1", "s2", "words"]
                )

    named = held_by(docs, "xxhash64(cast(doc_id as bigint))", wanted, "xxhash64(doc_id)")
    found = named.select("text").mapInArrow(released(run), "s1 long, s2 long, words binary")
    ids = wanted.select(F.col("id").alias("s1")).distinct()
    return found.dropDuplicates(["s1", "s2"]).join(ids, "s1", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs of sets, v and u, that are similar, compared word by word."""
    wanted = pairs.selectExpr("v as id", "doc_v as doc_id").union(pairs.selectExpr("u", "doc_u")).distinct()
    sets = _sets_of(docs, wanted, settings)

    def run(batches):
        for batch in batches:
            shared, both = _shared(batch.column("words_v"), batch.column("words_u"))
            keep = shared >= settings.similarity * (both - shared) - 1e-9
            yield batch.select(["v", "v2", "u", "u2"]).filter(pa.array(keep))

    return (
        pairs.select("v", "u")
        .join(sets.toDF("v", "v2", "words_v"), "v")
        .join(sets.toDF("u", "u2", "words_u"), "u")
        .mapInArrow(released(run), "v long, v2 long, u long, u2 long")
    )


def _shared(v: pa.Array, u: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets, each as 64-bit words, how many words they share and have in all."""
    (first_v, words_v), (first_u, words_u) = _words_of(v), _words_of(u)
    both = np.diff(first_v) + np.diff(first_u)
    shared, ends = np.zeros(len(both), np.int64), np.cumsum(both)
    i = 0
    while i < len(both):  # some pairs, and no fewer than one
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - both[i] + _COMPARED, side="right")))
        sizes = np.append(np.diff(first_v[i : j + 1]), np.diff(first_u[i : j + 1]))
        pair = np.repeat(np.append(np.arange(j - i), np.arange(j - i)), sizes)
        word = np.append(words_v[first_v[i] : first_v[j]], words_u[first_u[i] : first_u[j]])
        order = order_by(pair, word)
        pair, word = pair[order], word[order]
        same = (word[1:] == word[:-1]) & (pair[1:] == pair[:-1])
        shared[i:j] = np.bincount(pair[1:][same], minlength=j - i)
        i = j
    return shared, both


def _words_of(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each set's words start, and one entry more, and the words."""
    sets = sets.cast(pa.large_binary())
    first = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1] // 8
    held = sets.buffers()[2]
    return first, np.frombuffer(held, np.uint64, int(first[-1])) if held is not None else np.zeros(0, np.uint64)


def similar_sets(docs: DataFrame, table: DataFrame, settings: Settings) -> DataFrame:
    """For every set that is similar to an earlier one, such sets: (``v``, ``v2``) and
    (``u``, ``u2``). If a set has many like it, some of them are enough.

    A set none of whose first candidates was similar, and which had others, is then
    compared with all of them.
    """
    spark, (rarity, words) = docs.sparkSession, word_rarity(table)
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(least, words >> 20).bit_length()  # a hundred thousand postings or two in each
    held = postings(docs, rarity, settings, buckets)
    made, made_path = written(candidates(held, settings), "line_candidates")
    docs_ = F.min("doc_v").alias("doc_v"), F.min("doc_u").alias("doc_u")
    pairs = made.where("left is null").groupBy("v", "u").agg(*docs_, F.max("more").alias("more"))
    pairs, path = written(pairs, "line_pairs")
    found, _ = written(_verified(docs, pairs, settings), "line_links")
    open_ = pairs.where("more").select("v", "doc_v").join(found.select("v").distinct(), "v", "left_anti")
    open_, open_path = written(open_, "open_lines")
    drop_scratch(spark, path)
    if open_.isEmpty():
        drop_scratch(spark, made_path)
        return found
    rest = candidates_left(made.where("left is not null").select("left"), settings, Bitmap(open_, "v"))
    rest = rest.join(open_.select("v"), "v", "left_semi").groupBy("v", "u").agg(*docs_)
    pairs, path = written(rest, "line_pairs")
    more, _ = written(_verified(docs, pairs, settings), "line_links")
    for p in (path, open_path, made_path):
        drop_scratch(spark, p)
    return found.union(more)


def removed_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``hash`` and ``removed``, the sorted numbers of the lines to remove,
    for documents that have such. Documents without a doc_id come last; lines at one
    (doc_id, number), of repeated ids, are not later than one another."""
    table, _ = written(line_table(docs, settings), "lines")
    links = similar_sets(docs, table, settings)
    rest, _ = written(_resolved(table, links), "line_places")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")
    firsts = rest.where("s1 is not null")
    places = firsts.select("s1", "s2", place.alias("first")).distinct()
    later = (
        links.toDF("s1", "s2", "t1", "t2")
        .join(places, ["s1", "s2"])
        .join(places.toDF("t1", "t2", "other"), ["t1", "t2"])
        .where("other < first")
        .select("s1", "s2")
        .distinct()
    )
    gone = ["doc_id", "hash", "line"]
    return (
        table.where("line is not null").select(*gone)
        .union(rest.where("s1 is null").select(*gone))
        .union(firsts.join(later, ["s1", "s2"], "left_semi").select(*gone))
        .groupBy("doc_id", "hash")
        .agg(F.array_sort(F.collect_set("line")).alias("removed"))
    )


def _resolved(table: DataFrame, links: DataFrame) -> DataFrame:
    """Of the lines held in the ``line_table``: ``doc_id``, ``hash`` and ``line`` of those
    after an equal set, and with ``s1`` and ``s2`` of the first ones of sets in ``links``."""
    linked = Bitmap(links.selectExpr("v as id").union(links.select("u")), "id")

    def run(batches):
        for _, rows in _groups(batches, "bucket", "held", _LINE):
            first = _at_first(rows)
            kept = ~first | linked.has(rows["s1"])
            rows, first = rows[kept], first[kept]
            sets = {c: pa.array(rows[c], mask=~first) for c in ("s1", "s2")}
            yield pa.RecordBatch.from_pydict(_places(rows) | sets)

    held = table.where("bucket is not null").select("bucket", "held").repartition(F.col("bucket"))
    return held.sortWithinPartitions("bucket").mapInArrow(
        released(run), "doc_id long, hash long, line int, s1 long, s2 long"
    )


def deduped(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, later similar lines cut from ``text``, and ``removed``, their
    numbers from 0; the line feed before a line goes with it.

    Lines without a word stay, so null and empty texts do not change. Equal rows get equal results. A column ``removed`` gives way. Only
    documents that lose lines are shuffled.
    """
    docs = docs.drop("removed")
    found, _ = written(removed_lines(docs, settings), "removed")
    hash_ = fresh(docs, "_hash")
    keyed = docs.withColumn(hash_, F.xxhash64("text"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    none = F.expr("cast(array() as array<int>)")
    doc_, text_ = fresh(keyed, "_doc"), fresh(keyed, "_text")
    right = found.toDF(doc_, text_, "removed")
    some, others = (held_by(keyed, hash_, found, "hash", how) for how in ("left_semi", "left_anti"))
    joined = some.join(
        right, some["doc_id"].cast("bigint").eqNullSafe(right[doc_]) & (some[hash_] == right[text_]), "left"
    )
    cut = F.array_join(
        F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n"
    )
    joined = joined.withColumn("text", F.when(F.col("removed").isNotNull(), cut).otherwise(F.col("text")))
    joined = joined.withColumn("removed", F.coalesce("removed", none))
    return others.select(*kept, none.alias("removed")).unionByName(
        joined.select(*kept, "removed")
    )
