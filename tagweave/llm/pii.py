"""Format-preserving pseudonyms for personal data.

Found values are checked (Luhn, mod 97, octet and calendar ranges), numbered within the set of values
of their format, moved by a keyed Feistel permutation of exactly that set (cycle-walking) and written
back in the same format.  The permutation is a bijection under one key, so equal values get equal
pseudonyms in every document and different values stay different; without the key it can't be undone.

Scale: a map over documents, no shuffle, no state beside a small per-worker cache.

Defined results: null text stays null, text without personal data is returned unchanged, values that
fail their check (a number without Luhn digit, 30 February) are left, of a run of numbers or blocks that
fails as a whole the valid cards and IBANs inside are replaced, overlapping finds go to the
earlier start, then the kind listed first; repeated rows give the same pseudonyms; all input columns
are kept.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unchanged_schema

ROUNDS = 10
KEY = "tagweave-demo-key"  # a run sets its own: spark.tagweave.pii.key


class Feistel:
    """Keyed permutation of range(n): an unbalanced Feistel network over a x b >= n, walked back into range."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = max(1, isqrt(n - 1) + 1)
        self.b = max(1, -(-n // self.a))
        self.size = max(16, n.bit_length() // 16 + 9)
        self.seed = hashlib.blake2b(f"{kind}|{n}".encode(), key=hashlib.sha256(key).digest()).digest()

    def _f(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.shake_128(self.seed + b"%d|%d" % (r, x)).digest(self.size), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in range(0, ROUNDS, 2):
            left = (left + self._f(r, right)) % self.a
            right = (right + self._f(r + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in reversed(range(0, ROUNDS, 2)):
            right = (right - self._f(r + 1, left)) % self.b
            left = (left - self._f(r, right)) % self.a
        return left * self.b + right

    def move(self, x: int, step=None) -> int:
        step = step or self._once
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def undo(self, x: int) -> int:
        return self.move(x, self._back)


_feistel = lru_cache(4096)(Feistel)


def _radix(c: str) -> tuple[int, str]:
    for first, n in (("0", 10), ("a", 26), ("A", 26)):
        if 0 <= ord(c) - ord(first) < n:
            return n, first
    return 1, c


def _mixed(key: bytes, kind: str, text: str, alphabet: str = "", undo: bool = False) -> str:
    """Permute the digits and letters of ``text`` within their classes (or within ``alphabet``)."""
    parts = [(len(alphabet), alphabet) if c in alphabet else (1, c) for c in text] if alphabet else [_radix(c) for c in text]
    n = x = 0
    total = 1
    for c, (r, first) in zip(text, parts):
        if r > 1:
            x = x * r + (alphabet.index(c) if alphabet else ord(c) - ord(first))
            total *= r
    if total < 2:
        return text
    shape = "".join(f[0] if r > 1 and not alphabet else "x" if r > 1 else "." for r, f in parts)
    f = _feistel(key, f"{kind}|{shape}", total)
    x = f.undo(x) if undo else f.move(x)
    out = []
    for c, (r, first) in zip(reversed(text), reversed(parts)):
        if r > 1:
            x, n = divmod(x, r)
            c = alphabet[n] if alphabet else chr(ord(first) + n)
        out.append(c)
    return "".join(reversed(out))


def _into(pattern: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``pattern``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_ok(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _number(key, kind, text, n, x, write, undo):
    f = _feistel(key, kind, n)
    return write(f.undo(x) if undo else f.move(x))


def card(key: bytes, text: str, undo: bool = False) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn_ok(d) or len(set(d)) == 1:
        return None

    def write(x: int) -> str:
        body = d[0] + str(x).zfill(len(d) - 2)
        return _into(text, next(body + c for c in "0123456789" if luhn_ok(body + c)))
    return _number(key, f"card{len(d)}{d[0]}", text, 10 ** (len(d) - 2), int(d[1:-1]), write, undo)


def phone(key: bytes, text: str, undo: bool = False) -> str | None:
    d = _digits(text)
    if not 7 <= len(d) <= 15:
        return None
    head = len(_digits(re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", text)[0]))
    return _into(text, d[:head] + _mixed(key, f"phone{d[:head]}", d[head:], undo=undo))


def ssn(key: bytes, text: str, undo: bool = False) -> str | None:
    a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1

    def write(x: int) -> str:
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}{text[3]}{g + 1:02d}{text[6]}{s + 1:04d}"
    return _number(key, "ssn", text, 898 * 99 * 9999, x, write, undo)


def ip(key: bytes, text: str, undo: bool = False) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return _number(key, "ip", text, 1 << 32, x, lambda y: ".".join(map(str, y.to_bytes(4, "big"))), undo)


def iban(key: bytes, text: str, undo: bool = False) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _mixed(key, "iban" + flat[:2], flat[4:], undo=undo)
    full = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(full)
    return "".join(c if c == " " else next(it) for c in text)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(key: bytes, text: str, undo: bool = False) -> str | None:
    sep = text[4] if text[:4].isdigit() else re.search(r"\D", text)[0]
    p = text.split(sep)
    if len(p[0]) == 4:
        order = (0, 1, 2)
    elif sep == "." or int(p[0]) > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    try:
        day = datetime.date(*(int(p[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    # the two day/month orders must stay readable as what they were
    n = _LAST - _FIRST + 1
    f = _feistel(key, "date", n)
    x = day - _FIRST
    while True:
        x = f.undo(x) if undo else f.move(x)
        d = datetime.date.fromordinal(_FIRST + x)
        out = [""] * 3
        for i, v in zip(order, (d.year, d.month, d.day)):
            out[i] = str(v).zfill(4 if i == order[0] else 2)
        if order != (2, 1, 0) or sep == "." or d.day > 12:
            return sep.join(out)


def email(key: bytes, text: str, undo: bool = False) -> str | None:
    local, _, domain = text.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_mixed(key, 'email', local, undo=undo)}@{_mixed(key, 'host', host, undo=undo)}.{top}"


def secret(key: bytes, text: str, undo: bool = False) -> str | None:
    if not any(c.isdigit() for c in text):
        return None
    head = re.match(r"AKIA|gh[pousr]_|", text)[0]  # a key type's fixed prefix is part of its format
    if head:
        return head + _mixed(key, head, text[len(head):], undo=undo)
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(text) <= set(alphabet):
            return _mixed(key, "hex", text, alphabet, undo)
    return _mixed(key, "secret", text, undo=undo)


# kind -> (what it looks like, what permutes it); the first listed wins at one start
KINDS = {
    "email": (r"(?<![\w.+%-])\w[\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    "secret": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"
               r"|(?i:token|secret|password|api[_-]?key)[\"']?[ \t]*[:=][ \t]*(?P<quote>[\"'])(?P<value>(?:(?!(?P=quote))\S){8,})(?=(?P=quote))",
               secret),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?!\w|[./-]\d)", date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "card": (r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)", card),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
              r"|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", phone),
}
_PATTERNS = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_HINT = re.compile(r"[0-9@]")


_RUN = re.compile(r"(?<!\w)\d+(?:[ -]\d+)*(?!\w)")
# how cards are grouped; a part of a longer run of numbers must look like one of them
_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 4, 1),
           (4, 4, 4, 2), (4, 4, 4, 3), (6, 13), *((n,) for n in range(13, 20))}


def _is_card(text: str) -> bool:
    d = _digits(text)
    return luhn_ok(d) and len(set(d)) > 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """Valid cards: the pattern's matches and, in runs of numbers, the parts grouped like a card; of those that
    overlap the longest, then the first."""
    found = [m.span() for m in _PATTERNS["card"].finditer(text)]
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        parts = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\d+", run[0])]
        size = [b - a for a, b in parts]
        found += [(parts[i][0], parts[i + n - 1][1]) for i in range(len(parts)) for n in range(1, 6)
                  if tuple(size[i:i + n]) in _GROUPS and i + n <= len(parts)]
    taken: list[tuple[int, int]] = []
    for a, b in sorted((x for x in set(found) if _is_card(text[x[0]:x[1]])),
                       key=lambda x: (-len(_digits(text[x[0]:x[1]])), x)):
        at = bisect(taken, (a, b))
        if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
    return iter(taken)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest valid beginning of each match that ends at a blank; the search goes on after it (or, without
    one, after the match's first block)."""
    at = 0
    while m := _PATTERNS["iban"].search(text, at):
        a, b = m.span()
        ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")]
        end = next((e for e in ends if iban(b"", text[a:e]) is not None), None)
        if end is not None:
            yield a, end
        at = end if end is not None else ends[-1]


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _PATTERNS["secret"].finditer(text):
        yield m.span("value") if m["value"] else m.span()


_FINDERS = {"card": _cards, "iban": _ibans, "secret": _secrets}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that looks like a kind, by start and then by kind (values that
    overlap an earlier valid one are passed over when replacing)."""
    if not _HINT.search(text):
        return []
    every = sorted((a, rank, b, k) for rank, (k, p) in enumerate(_PATTERNS.items())
                   if k != "email" or "@" in text
                   for a, b in (_FINDERS[k](text) if k in _FINDERS else (m.span() for m in p.finditer(text))))
    return [(a, b, k) for a, _, b, k in every]


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with every valid value replaced, and the kinds replaced, in order."""
    out, kinds, last = [], [], 0
    for a, b, kind in find(text):
        if a < last:
            continue
        new = _value(key, kind, text[a:b])
        if new is not None:
            out += [text[last:a], new]
            last = b
            kinds.append(kind)
    return ("".join([*out, text[last:]]) if kinds else text), kinds


@lru_cache(1 << 14)
def _value(key: bytes, kind: str, value: str) -> str | None:
    return KINDS[kind][1](key, value)


def run_key(spark) -> bytes:
    return spark.conf.get("spark.tagweave.pii.key", KEY).encode()


def pseudonyms(docs: DataFrame, key: bytes, found: str = "pii_kinds") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and one more column: the kinds replaced, in text order."""
    found = unchanged_schema(docs, found)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = batch.column(at).to_pylist(), []
            for i, t in enumerate(texts):
                new, ks = pseudonymise(t, key) if t else (t, [])
                texts[i] = new
                kinds.append(ks)
            cols = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.list_(pa.string()))],
                                             names=[*batch.schema.names, found])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{found}` array<string>")


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, pseudonymised text, number and kinds of the values replaced."""
    out = pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, "pii_kinds")
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"),
                      F.concat_ws(",", F.array_sort(F.array_distinct("pii_kinds"))).alias("kinds"))
