"""Token ids of texts, by a tokenizer file of the ``tokenizers`` library.

Every worker keeps the ids of words it has met and joins them, instead of encoding
again. That is right for tokenizers whose pre-tokenizer joins nothing across a space or
line feed; the file is looked at, and others encode whole texts. In such a file's own
steps a new word of Latin-1 is lowered, split into runs of letters, digits and other
signs, and handed to the library's model; any other word takes the library's whole way.
"""

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa

from curbwait.llm.arrow import Kept

_CACHED = 250_000
_LONG = 100
# The steps of a tokenizer that words can be encoded apart with.
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same split for lower-case Latin-1 without white space and controls.
_LATIN = re.compile("[!-~¡-ÿ]+")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# Signs beyond Latin-1; a full stop or comma before a space that a sign is joined to.
_BEYOND = re.compile("[^\0-ÿ]")
_JOINED = re.compile(f"[^ {_LETTERS}{_NUMBERS}][.,] ")


def default_path() -> str:
    """The public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids of words, as bytes; what is not there is encoded, or found among the words
    of the generation before."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer, self._model, self._before = tokenizer, tokenizer.model, {}
        self._id_bytes = [packed([k]) for k in range(tokenizer.get_vocab_size())]
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._byte_signs = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}

    def trim(self) -> None:
        """Bound the words held: the older generation goes."""
        if len(self) > _CACHED:
            self._before = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        found = self._before.get(word)
        if found is None:
            found = self._new(word)
        if len(word) <= _LONG:
            self[word] = found
        return found

    def _new(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):
            if not _LATIN.fullmatch(word) or "<|" in word:
                return packed(self._tokenizer.encode(word, add_special_tokens=False).ids)
            if word[-1] in ".,:;!?" and word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
            pieces = _PIECES.findall(word.lower())
            if len(pieces) != 1:
                return b"".join(map(self.__getitem__, pieces))
        low = word.lower()
        if low != word:
            return self[low]
        plain = word if word.isascii() else word.translate(self._byte_signs)
        return b"".join([self._id_bytes[t.id] for t in self._model.tokenize(plain)])


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Known(self._tokenizer) if _by_words(json.loads(self._tokenizer.to_str())) else None

    def __call__(self, text: str) -> bytes:
        if self._known is None:
            return packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
        self._known.trim()
        return b"".join(map(self._known.__getitem__, _parted(text.replace("\n", " ")).split(" ")))


def _parted(text: str) -> str:
    """A text of Latin-1 in lower case, with its full stops and commas as words, so that
    fewer words are new; any other text as it is."""
    if "<|" in text or _BEYOND.search(text):
        return text
    text = text.lower()
    return text if _JOINED.search(text) else text.replace(". ", " . ").replace(", ", " , ")


def _by_words(steps: dict) -> bool:
    """Are the tokenizer's steps those that words can be encoded apart with?"""
    before, split = steps["normalizer"] or {}, (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [(n["type"], n.get("pattern", {}).get("Regex")) for n in before.get("normalizers", [])]
    return (
        kinds == _NORMALIZERS
        and len(split) == 2
        and (split[0].get("pattern", {}).get("Regex"), split[0].get("behavior")) == (_SPLIT, "Removed")
        and (split[1]["type"], split[1]["use_regex"]) == ("ByteLevel", False)
        and steps["model"]["type"] == "BPE"
        and not steps["model"]["dropout"]
    )


@Kept
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return Encoder(path)


def encoded(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, ``end`` after each, and where each text's begin
    (one entry more than there are texts). Null is an empty text."""
    encode, last = encoder(path), np.array([end], "<u4").tobytes()
    parts = [encode(t.as_py() or "") + last for t in texts]
    ids = np.frombuffer(b"".join(parts), "<u4")
    return ids, np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])


def lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow lists of int from flat ids."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def crc32(lists_: pa.ListArray) -> pa.Array:
    """The crc32 of each list as little-endian unsigned 32-bit integers."""
    flat, at = lists_.flatten().to_numpy().astype("<u4"), np.cumsum(np.concatenate([[0], lists_.value_lengths().to_numpy()]))
    raw = flat.tobytes()
    return pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64())
