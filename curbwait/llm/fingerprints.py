"""SimHash fingerprints of texts: 64 majority bits over hashed shingles of words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from xxhash import xxh64_digest

from curbwait.llm.arrow import appended

SHINGLE = 3
_SEED = 42
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer. Words stand between ASCII white space, A-Z
    is lowered; a text of fewer words than a shingle, but not none, is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    size = min(shingle, len(words))
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), _AT_ONCE):
        spans = zip(starts[k : k + _AT_ONCE], stops[k : k + _AT_ONCE], strict=True)
        digests = b"".join([xxh64_digest(joined[a:b], _SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes())


def fingerprinted(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns, or those in ``keep``, with the fingerprint as a signed
    long called ``name``; zero for a null text and one without words."""

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index("text"))
        made = [fingerprint((t.as_py() or "").encode()) for t in texts]
        return [pa.array(np.array(made, np.uint64).view(np.int64))]

    return appended(docs, [T.StructField(name, T.LongType())], find, keep)
