"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers are found by pattern in the text as it is. For disguised ones the
text passes through transducers, each over what the one before made, that undo
look-alike characters and invisible ones, bracketed ``at`` and ``dot``, written-out
ones, and spelled digits, and note for every character they emit which source
characters it stands for. The same detectors run on
their output, and what they find there is mapped back.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curbwait.llm.arrow import appended

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits that fails from its start fails from within
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Does the check digit hold?"""
    doubled = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Each ``@`` with the longest local part before it and a dotted name after it; in
    time proportional to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        done = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", done)


def plain(text: str) -> list[Span]:
    """The identifiers that stand in the text undisguised, by start and kind. A match
    that fails its test is dropped, and its characters are not looked at again."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# Characters that look like ASCII ones, and words for digits and signs.
_ALIKE = {
    **{0xFF01 + k: chr(0x21 + k) for k in range(94)},
    **dict(zip(map(ord, "аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅ"), "aeopcyxijsdhlABEKMHOPCTYXIJS", strict=True)),
    **dict(zip(map(ord, "οαινρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), "oaivpukABEZHIKMNOPTYX", strict=True)),
    **{0x0660 + k: str(k) for k in range(10)},
    **{0x06F0 + k: str(k) for k in range(10)},
    **{0x0966 + k: str(k) for k in range(10)},
    **dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212], "-"),
    **dict.fromkeys([0x00A0, 0x2007, 0x2009, 0x202F], " "),
    0x2024: ".",
    0x3002: ".",
    0xFE52: ".",
    0xFE6B: "@",
}
_UNSEEN = "­​‌‍⁠﻿"
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9",
}
_AT, _DOT = r"(?:at|arroba|arobase|chez|@)", r"(?:dot|punkt|punto|point|\.)"

_NUMBER = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + "|[0-9])"
_WORDED = _NUMBER.replace("|[0-9]", "")
_OCTET = rf"(?:[0-9]{{1,3}}|{_WORDED}(?:[\s-]+{_WORDED}){{0,2}})"
_BRACKETED = re.compile(rf"(?<!\s)\s*[\[({{<]\s*(?:(?P<at>{_AT})|(?P<dot>{_DOT}))\s*[\])}}>]\s*", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:plus\s+|\+\s*)?{_NUMBER}(?:[\s,.-]+{_NUMBER}){{6,}}(?!\w)", re.I)
_SPELLED_ONE = re.compile(rf"(?P<plus>plus|\+)|{_NUMBER}", re.I)
_SPELLED_IP = re.compile(rf"(?<![\w.]){_OCTET}(?:(?:\s+(?:dot|punkt|punto|point)\s+|\.){_OCTET}){{3}}(?!\w)", re.I)
_IP_ONE = re.compile(rf"(?P<dot>{_DOT})|{_NUMBER}", re.I)
#: The words for signs outside brackets that go together: for at, and for dot.
_FAMILIES = (("at|arroba|arobase", "dot"), ("at|ät", "punkt"), ("arroba", "punto"), ("arobase|chez", "point"))
#: "look at example.org" is as good a text as "jane at example.org": where at is the only
#: word, the words that come before the name of a site, and the last parts a name may have.
_NO_NAMES = set(
    "a and are available be blog book call check contact details download email find found from he her here him home "
    "hosted info information is it join like listed live look looked looking mail me more now of online or order out "
    "page posted published read register sale see seen sell she shop shopping sign site sold store that the them then "
    "there they this to up us video visit was we website were work worked working works write you".split()
)
_ENDS = re.compile(r"\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|online|site|mail)\Z")
_STRANGE = re.compile("[" + "".join(map(chr, _ALIKE)).replace("-", r"\-").replace("]", r"\]").replace("\\", r"\\") + _UNSEEN + "]")


Edits = list[tuple[int, int, str]]


def _kept(found: Edits) -> Edits:
    """The edits in order, without those that overlap an earlier one."""
    out, done = [], 0
    for start, end, by in sorted(found):
        if start >= done:
            out.append((start, end, by))
            done = end
    return out


def _brackets(text: str, wide) -> Edits:
    """Signs in brackets, written out or not."""
    if not any(c in text for c in "[({<"):
        return []
    return _kept([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)])


class _Written:
    """Addresses with some signs written out, by the words for at and for dot."""

    def __init__(self, at: str, dot: str):
        sep = rf"(?:\s++{dot}\s++|\.)"
        self.any = re.compile(rf"\s{dot}\s|\s(?:{at})\s+[\w-]++\.[\w-]", re.I)
        self.local = re.compile(rf"(?<![\w@.%+-])[\w%+-]++(?:{sep}[\w%+-]++)*+", re.I)
        self.at = re.compile(rf"\s++(?P<word>{at})\s++|@", re.I)
        self.domain = re.compile(rf"[\w-]++(?:{sep}[\w-]++)*{sep}[a-z]{{2,}}(?!\w)", re.I)
        self.dot = re.compile(rf"\s+{dot}\s+", re.I)
        self.plain = dot == "dot"

    def edits(self, text: str, wide) -> Edits:
        found: Edits = []
        place = 0
        while m := self.local.search(text, place):
            place = m.end()
            at = self.at.match(text, m.end())
            name = at and self.domain.match(text, at.end())
            if not name or not self.taken(text, m, at, name, wide):
                continue
            found += [(d.start(), d.end(), ".") for d in self.dot.finditer(text, m.start(), m.end())]
            if at["word"]:
                found.append((at.start(), at.end(), "@"))
            found += [(d.start(), d.end(), ".") for d in self.dot.finditer(text, at.end(), name.end())]
            place = name.end()
        return found

    def taken(self, text: str, local, at, name, wide) -> bool:
        """Is it an address, not words that happen to stand so?"""
        if self.dot.search(text, at.end(), name.end()):
            return True
        word = (at["word"] or "").lower()
        if not self.plain:
            return word in ("arroba", "arobase")
        if not word:
            return bool(self.dot.search(text, local.start(), local.end()))
        if word != "at" or any(wide(k) for k in range(at.end(), name.end()) if text[k] == "."):
            return True
        return local[0].lower() not in _NO_NAMES and bool(_ENDS.search(name[0]))


_WRITTEN = [_Written(at, dot) for at, dot in _FAMILIES]


def _signs(text: str, wide) -> Edits:
    """Signs written out without brackets, also beside real ones."""
    return _kept([e for way in _WRITTEN if way.any.search(text) for e in way.edits(text, wide)])


def _numbers(text: str, wide) -> Edits:
    """Spelled digits: of IP addresses with their dots, and of long numbers."""
    found: Edits = []
    for m in _SPELLED_IP.finditer(text):
        last = m.start()
        for s in _IP_ONE.finditer(text, m.start(), m.end()):
            found.append((last, s.end(), "." if s["dot"] else _DIGIT_WORDS.get(s[0].lower(), s[0])))
            last = s.end()
    done = {(a, b) for a, b, _ in found}
    for m in _SPELLED.finditer(text):
        if re.search(r"[^\W\d_]", m[0]):  # at least one digit is a word
            last = m.start()
            for s in _SPELLED_ONE.finditer(text, m.start(), m.end()):
                by = "+" if s["plus"] else _DIGIT_WORDS.get(s[0].lower(), s[0])
                if (last, s.end()) not in done:
                    found.append((last, s.end(), by))
                last = s.end()
    return [e for e in _kept(found) if e[1] - e[0] > 1 or text[e[0]] != e[2]]


def normalised(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text undisguised, and for each of its characters the source characters it
    stands for, from and to; None if there is nothing to undo.

    Strange characters, brackets, written-out signs and spelled digits are undone one
    after the other, each in what the one before made. What replaces several
    characters stands for them as a whole."""
    seen, starts, ends = text, None, None
    if not text.isascii() and _STRANGE.search(text):
        starts = [k for k, c in enumerate(text) if c not in _UNSEEN]
        seen = "".join([text[k] for k in starts]).translate(_ALIKE)
        ends = [k + 1 for k in starts]
    wide = lambda k: starts is not None and ends[k] - starts[k] > 1
    for step in (_brackets, _signs, _numbers):
        edits = step(seen, wide)
        if not edits:
            continue
        if starts is None:
            starts, ends = list(range(len(seen))), list(range(1, len(seen) + 1))
        out, starts_, ends_, done = [], [], [], 0
        for start, end, by in edits:
            out.append(seen[done:start] + by)
            starts_ += starts[done:start] + [starts[start]] * len(by)
            ends_ += ends[done:start] + [ends[end - 1]] * len(by)
            done = end
        seen, starts, ends = "".join(out) + seen[done:], starts_ + starts[done:], ends_ + ends[done:]
    return None if starts is None else (seen, starts, ends)


def disguised(text: str, known: list[Span]) -> list[Span]:
    """The identifiers that only the undisguised text shows, as source spans. One that
    touches a known span of its kind is that span again and left out."""
    seen = normalised(text)
    if seen is None:
        return []
    clear, starts, ends = seen
    found = plain(clear)
    for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", clear):
        # ten to fifteen digits in a row, some of them spelled: a number to call, if not of a card
        if (m.start(), m.end(), "card") not in found and any(e - s > 1 for s, e in zip(starts[m.start() : m.end()], ends[m.start() : m.end()], strict=True)):
            found.append((m.start(), m.end(), "phone"))
    out = []
    for a, b, kind in found:
        start, end = starts[a], ends[b - 1]
        while start < end and text[start].isspace():
            start += 1
        changed = text[start:end] != clear[a:b]
        if changed and not any(k == kind and s < end and start < e for s, e, k in known):
            out.append((start, end, kind))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The plain spans and all spans of a text, each sorted by start and kind."""
    text = text or ""
    base = plain(text)
    return base, sorted({*base, *disguised(text, base)}, key=_order)


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def scanned(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in ``keep`` with ``base`` and ``spans``: kind, start and end (code
    points, end exclusive) of plain identifiers, and of all.

    Null and empty texts have none; equal rows get equal spans. Columns of these names
    give way. Time is proportional to the length of a text.
    """
    docs = docs.drop("base", "spans")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        both = [find(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
        return [pa.array([rows(found[n]) for found in both], kind) for n in (0, 1)]

    return appended(docs, [T.StructField("base", _SPANS), T.StructField("spans", _SPANS)], run, keep)
