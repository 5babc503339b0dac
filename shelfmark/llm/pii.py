"""Personal data replaced by format-preserving pseudonyms.

A value found by its shape is first validated (check digits, ranges, calendar). Its
significant characters are then a number below the size of its format's domain, which a
keyed Feistel network permutes; outputs beyond the domain walk the cycle until they fall
inside. The result has the same layout and passes the same validation, equal values get
equal pseudonyms in every document whatever their layout, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Stand-in for the secret that a deployment passes in.
KEY = b"shelfmark demonstration key"
#: An e-mail's local part of fewer values than this is permuted together with its domain's first label.
SMALL = 10**6
#: Characters of a value that are permuted as one number.
BLOCK = 64
#: Networks remembered by a task.
MOST_KNOWN = 10_000
KINDS = ("email", "phone", "card", "ipv4", "ssn", "iban", "date", "secret")


class Feistel:
    """A keyed permutation of 0 .. size - 1; ``tweak`` separates domains."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, -(-max(size - 1, 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.bytes = -(-self.half // 8)
        name = tweak.encode() + b"/" + size.to_bytes(size.bit_length() // 8 + 1, "little")
        self.base = hashlib.blake2b(name, key=hashlib.sha256(key).digest(), digest_size=32)

    def _round(self, number: int, half: int) -> int:
        h = self.base.copy()
        h.update(number.to_bytes(1, "little") + half.to_bytes(self.bytes, "little"))
        out, block = b"", h.digest()
        while len(out) < self.bytes:
            out += block
            block = hashlib.sha256(block).digest()
        return int.from_bytes(out[: self.bytes], "little") & self.mask

    def _once(self, x: int, order: range) -> int:
        left, right = x >> self.half, x & self.mask
        for r in order:
            left, right = right, left ^ self._round(r, right)
        return right << self.half | left

    def _walk(self, x: int, order: range) -> int:
        x = self._once(x, order)
        while x >= self.size:
            x = self._once(x, order)
        return x

    def permute(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def restore(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


def luhn_digit(body: str) -> int:
    """The check digit that makes body + digit pass the Luhn test."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, chars: str, which: Callable[[str], bool] = str.isdigit) -> str:
    """``shape`` with the characters that satisfy ``which`` replaced in order."""
    it = iter(chars)
    return "".join(next(it) if which(c) else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Pseudonyms:
    """Replacement of each kind of value. A method returns None for what isn't valid."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.known: dict[tuple[str, int], Feistel] = {}

    def number(self, kind: str, x: int, size: int, keep: bool = True) -> int:
        f = self.known.get((kind, size))
        if f is None:
            f = Feistel(self.key, kind, size)
            if keep and len(self.known) < MOST_KNOWN:
                self.known[kind, size] = f
        return f.restore(x) if self.undo else f.permute(x)

    def string(self, kind: str, text: str, alphabets: dict[str, str]) -> str:
        """Characters stay in their own alphabet (mixed radix); others stay as they are.

        A value longer than BLOCK is permuted block by block, each under a tweak of its
        number and of the value's length, so that the work grows with the length alone.
        """
        if len(text) <= BLOCK:
            return self._block(kind, text, alphabets)
        parts = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        return "".join(self._block(f"{kind}/{len(text)}/{k}", part, alphabets, keep=False) for k, part in enumerate(parts))

    def _block(self, kind: str, text: str, alphabets: dict[str, str], keep: bool = True) -> str:
        radix = [alphabets.get(c, "") for c in text]
        size, x = 1, 0
        for c, a in zip(text, radix):
            if a:
                x, size = x * len(a) + a.index(c), size * len(a)
        if size < 2:
            return text
        y = self.number(kind, x, size, keep)
        out = []
        for c, a in zip(reversed(text), reversed(radix)):
            if a:
                y, d = divmod(y, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))

    def email(self, m: re.Match) -> str | None:
        local, at, domain = m[0].partition("@")
        if local[0] == "." or local[-1] == "." or ".." in local or len(local) > 64:
            return None
        if math.prod(len(_CLASSES.get(c, "x")) for c in local) < SMALL:
            label, dot, rest = domain.partition(".")
            return self.string("email", f"{local}@{label}", _CLASSES) + dot + rest
        return self.string("email", local, _CLASSES) + at + domain

    def phone(self, m: re.Match) -> str | None:
        d = _digits(m[0])
        head = _COUNTRY.match(d)[0] if m[0][0] == "+" else ""
        body = d[len(head) :]
        national = not head and body[0] == "0"
        if not 7 <= len(body) <= 14 or len(d) > 15 or head in ("", "1") and len(body) != 10 and not (national and len(body) == 11):
            return None
        lead = 10 ** (len(body) - 1)  # a leading zero stays one, as it decides how the number is read
        new = self.number("phone", int(body), lead) if body[0] == "0" else lead + self.number("phone", int(body) - lead, 9 * lead)
        return _refill(m[0], head + f"{new:0{len(body)}d}")

    def card(self, m: re.Match) -> str | None:
        d = _digits(m[0])
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]):
            return None
        n = len(d) - 1
        body = f"{self.number('card', int(d[:-1]), 10**n):0{n}d}"
        return _refill(m[0], body + str(luhn_digit(body)))

    def ipv4(self, m: re.Match) -> str | None:
        octets = [int(x) for x in m[0].split(".")]
        if max(octets) > 255:
            return None
        y = self.number("ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32)
        return ".".join(map(str, y.to_bytes(4, "big")))

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = (int(x) for x in m[0].split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        rank = area - 1 - (area > 666)
        y = self.number("ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        y, serial = divmod(y, 9999)
        rank, group = divmod(y, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, m: re.Match) -> str | None:
        text = m[0].replace(" ", "")
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(text) <= 34 or value(text[4:] + text[:4]) % 97 != 1:
            return None
        body = self.string("iban", text[4:], _CLASSES)
        check = 98 - value(body + text[:2] + "00") % 97
        return _refill(m[0], f"{text[:2]}{check:02d}{body}", str.isalnum)

    def date(self, m: re.Match) -> str | None:
        for shape, order in _DATES:
            if found := re.fullmatch(shape, m[0]):
                part = dict(zip(order, found.groups()))
                try:
                    day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
                except ValueError:
                    continue
                if not _FIRST_DAY <= day < _FIRST_DAY + _DAYS:
                    return None
                narrow = [name for k, name in enumerate(order, 1) if len(found[k]) == 1]
                while True:  # walk until a field written with one digit is below ten again, and a month that came first still can't be a day's
                    day = _FIRST_DAY + self.number("date", day - _FIRST_DAY, _DAYS)
                    new = datetime.date.fromordinal(day)
                    if all({"m": new.month, "d": new.day}[name] < 10 for name in narrow) and (order != "mdy" or new.day > 12):
                        break
                filled = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
                out, last = [], 0
                for k, name in enumerate(order, 1):
                    out += [m[0][last : found.start(k)], filled[name] if len(found[k]) > 1 else str(int(filled[name]))]
                    last = found.end(k)
                return "".join(out) + m[0][last:]
        return None

    def secret(self, m: re.Match) -> str | None:
        return m[1] + self.string("secret", m[2], _CLASSES_HEX if re.fullmatch(r"[0-9a-f]+", m[2]) else _CLASSES)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CLASSES = {c: a for a in (_LOWER, _UPPER, _DIGIT) for c in a}
_CLASSES_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
#: Month first only where day first is no date.
_DATES = (
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),
    (r"(\d{1,2})[./](\d{1,2})[./](\d{4})", "dmy"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "mdy"),
)

#: Country calling codes: one digit, the assigned ones of two, and else three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
#: (kind, what a text must hold to be searched at all, shape); earlier kinds win where shapes overlap.
_SHAPES = (
    # Prefixes of keys that say by themselves what they are.
    ("secret", "", re.compile(r"(?<![A-Za-z0-9_+/.-])(AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-)([A-Za-z0-9_-]{16,})")),
    ("secret", "=:", re.compile(r"""((?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)([A-Za-z0-9_+/.-]{16,})""")),
    ("email", "@", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ipv4", ".", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")),
    ("date", "-/.", re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![\w/-]|\.\d)")),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", "", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[ -]\d)")),
    ("card", "", re.compile(r"(?<![\w.+])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}|(?<!-)\d{13,19})(?!\w|-\d)")),  # next to other numbers
    ("phone", "+-. (", re.compile(r"(?<![\w+])(?:\+[1-9](?:[ .()/-]{0,2}\d){7,14}|(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?!\w|[.-]\d)")),
)
#: Kinds of which a candidate that isn't valid can hold a valid one.
_NESTED = ("card", "phone")
_ANY_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d+")


def _values(kind: str, shape: re.Pattern, text: str, names: Pseudonyms, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the valid values of a shape outside ``taken`` (disjoint, in order).

    Where a candidate isn't valid, it is tried without its last groups, then from its next
    group on.
    """
    at, ends = 0, [b for _, b in taken]

    def free(s: int, e: int) -> bool:
        k = bisect_right(ends, s)  # the first that ends behind s
        return k == len(taken) or taken[k][0] >= e

    while m := shape.search(text, at):
        at, tries = m.end(), [m]
        if kind in _NESTED:
            at = m.start() + 1
            shorter = [m.start() + g.end() for g in _DIGITS.finditer(m[0])][-2::-1]
            tries += filter(None, (shape.fullmatch(text, m.start(), e) for e in shorter if text[e] not in ".-"))
        for c in tries:
            s, e = c.span()
            if free(s, e) and (new := getattr(names, kind)(c)) is not None:
                yield s, e, new
                at = e
                break


def redact(text: str | None, names: Pseudonyms) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(text with pseudonyms, [(kind, start, end)] of what was replaced, by place in the given text)."""
    if not text or not ("@" in text or _ANY_DIGIT.search(text) or "=" in text or ":" in text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, needs, shape in _SHAPES:
        if needs and not any(c in text for c in needs):
            continue
        found += [(s, e, kind, new) for s, e, new in _values(kind, shape, text, names, taken)]
        taken = sorted((s, e) for s, e, *_ in found)
    out, last = [], 0
    for s, e, _, new in sorted(found):
        out += [text[last:s], new]
        last = e
    return "".join(out) + text[last:], [(kind, s, e) for s, e, kind, _ in sorted(found)]


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """doc_id, text, n_replaced, spans (kind, start, end in the given text) of every row of ``docs``.

    Kinds: e-mail local parts, phone numbers, payment cards (Luhn), IPv4 addresses, US
    social security numbers, IBANs (mod 97), calendar dates of 1900 to 2099 (day first, or
    month first where that alone is a date), and secrets after token/password/key or with
    a known prefix (``AKIA``, ``ghp_`` and the like, which stays). Phone numbers are + and
    7 to 14 digits after a country code in any grouping (10 after +1), groups of 3, 3 and
    4 digits, or three groups of 10 or 11 digits that start with 0. Out of scope, as too
    many other numbers look like them: local numbers of seven digits (555-1234).

    What fails its validation stays. A null text stays null, an empty one empty; very long
    texts and values take time in proportion. Rows are independent: repeated rows give
    repeated rows, null ids are carried along, other columns are not read. No shuffle.
    """

    @F.pandas_udf("text string, n_replaced long, spans array<struct<kind:string,start:long,end:long>>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        names = Pseudonyms(key)
        rows = [redact(t, names) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in rows], "n_replaced": [len(s) for _, s in rows], "spans": [[dict(zip(("kind", "start", "end"), x)) for x in s] for _, s in rows]})

    out = docs.select(F.col(id_col).alias("doc_id"), udf(F.col(text_col).cast("string")).alias("r"))
    return out.select("doc_id", "r.text", "r.n_replaced", "r.spans")
