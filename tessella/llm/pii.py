"""Format-preserving pseudonyms for personal data.

Numbers, dates, addresses and secrets that pass their validity checks are permuted
by a keyed Feistel network within their own format. The permutation is a bijection
of the format, so equal values stay linked across documents and different values
stay different; it never maps a value to itself. Pseudonyms pass the same checks.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, named

ROUNDS = 8
#: Values of formats with at least so many members are permuted symbol by symbol: as numbers they outgrow the digest.
WIDE = 1 << 256


class Permutation:
    """A keyed permutation of range(n) without fixed points (n >= 2).

    Feistel rounds on a pair of residues (a, b) with ab >= n; results of n and above are
    walked on. Between the rounds and their inverse the value is moved by one, so
    that the whole is one cycle through all values.
    """

    def __init__(self, key: bytes, n: int):
        self.key, self.n = key, n
        self.a = 1 << max(1, (n - 1).bit_length() // 2)
        self.b = -(-n // self.a)

    def _round(self, k: int, right: int, m: int) -> int:
        data = k.to_bytes(1, "big") + self.n.to_bytes(32, "big") + right.to_bytes(32, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % m

    def _there(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.b)
            for k in range(0, ROUNDS, 2):
                a = (a + self._round(k, b, self.a)) % self.a
                b = (b + self._round(k + 1, a, self.b)) % self.b
            x = a * self.b + b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.b)
            for k in reversed(range(0, ROUNDS, 2)):
                b = (b - self._round(k + 1, a, self.b)) % self.b
                a = (a - self._round(k, b, self.a)) % self.a
            x = a * self.b + b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._back((self._there(x) + 1) % self.n)

    def inverse(self, x: int) -> int:
        return self._back((self._there(x) - 1) % self.n)


class WidePermutation:
    """A keyed permutation without fixed points of lists of symbols, position k out of range(sizes[k]).

    The same Feistel rounds and the same step by one in between, but on the lists' halves: each
    half is moved, position by position, by a digest of the other as long as it needs.
    """

    def __init__(self, key: bytes, sizes: np.ndarray):
        self.key, self.sizes, self.half = key, sizes, len(sizes) // 2

    def _round(self, k: int, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        data = self.key + k.to_bytes(1, "big") + other.astype(np.uint8).tobytes()
        return (np.frombuffer(hashlib.shake_256(data).digest(8 * len(sizes)), "<u8") % sizes.astype(np.uint64)).astype(np.int64)

    def _rounds(self, x: np.ndarray, order: Iterator[int], sign: int) -> np.ndarray:
        a, b, m, n = x[: self.half], x[self.half :], self.sizes[: self.half], self.sizes[self.half :]
        for k in order:
            if k % 2:
                b = (b + sign * self._round(k, a, n)) % n
            else:
                a = (a + sign * self._round(k, b, m)) % m
        return np.concatenate([a, b])

    def _moved(self, x: np.ndarray, step: int) -> np.ndarray:
        x = self._rounds(x, iter(range(ROUNDS)), 1)
        for k in reversed(range(len(x))):
            carry, x[k] = divmod(int(x[k]) + step, int(self.sizes[k]))
            if not carry:
                break
        return self._rounds(x, reversed(range(ROUNDS)), -1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._moved(x, 1)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._moved(x, -1)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = re.sub(r"\s", "", text)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def in_hex(text: str) -> bool:
    """Whether a secret is hex: digits alone, or letters alone, are not."""
    return len(text) >= 8 and not set(text) - set(HEX) and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


#: Symbols of which a character in a string without checks stays a member.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"
#: Days on which pseudonymous dates fall: 1900-01-01 up to 2099-12-31.
DAYS = range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() + 1)
#: Octets written with one, two or three digits.
OCTETS = {1: range(0, 10), 2: range(10, 100), 3: range(100, 256)}


@cache
def days_written(month_first: bool, day_digits: int, month_digits: int) -> tuple[list[int], dict[int, int]]:
    """The days that a format can write, and the place of each: days 1 to 9 alone fit one digit, and so on.

    In slashes a second number above 12 is what tells that the month comes first.
    """
    fits = [
        n for n in DAYS for d in (datetime.date.fromordinal(n),)
        if (day_digits == 2 or d.day <= 9) and (month_digits == 2 or d.month <= 9) and (not month_first or d.day > 12)
    ]
    return fits, {n: k for k, n in enumerate(fits)}

#: What each kind looks like before its check.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9_+/-]{8,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w]|[./-]\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
}
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
#: A text without a digit or an @ sign holds nothing of the above but secrets in letters alone.
HINT = re.compile(r"[0-9@=:]")
KINDS = tuple(PATTERNS)


class Pseudonyms:
    """Replaces what is valid of each kind in a text."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permutations: dict[tuple[str, int], Permutation] = {}

    def key_of(self, kind: str) -> bytes:
        return hashlib.blake2b(kind.encode(), key=self.key, digest_size=32).digest()

    def permuted(self, kind: str, n: int, x: int) -> int:
        if (kind, n) not in self.permutations:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            self.permutations[kind, n] = Permutation(self.key_of(kind), n)
        return self.permutations[kind, n](x)

    def digits(self, kind: str, text: str, skip: int = 0) -> str:
        """text with its digits after the first skip characters permuted, all else in place."""
        own = [c for c in text[skip:] if c.isdigit()]
        new = iter(str(self.permuted(kind, 10 ** len(own), int("".join(own)))).zfill(len(own)))
        return text[:skip] + "".join(next(new) if c.isdigit() else c for c in text[skip:])

    def symbols(self, kind: str, text: str) -> str:
        """text with every letter and digit permuted within its class (secrets in hex: all of hex)."""
        if kind != "secret":
            return self.in_classes(kind, text)
        # Both formats are walked on until the result is in the same one: no two secrets get the same pseudonym.
        new, own = text, in_hex(text)
        while True:
            new = self.in_classes(kind, new, own)
            if in_hex(new) == own:
                return new

    def in_classes(self, kind: str, text: str, as_hex: bool = False) -> str:
        sets = [HEX] * len(text) if as_hex else [next((s for s in CLASSES if c in s), "") for c in text]
        n, x = 1, 0
        for c, s in zip(text, sets):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
                if n >= WIDE:
                    break
        if n == 1:
            return text
        # Lengths and places of classes are part of the format.
        shape = "".join(str(len(s)) + "," for s in sets)
        if n >= WIDE:
            own = [(s, s.index(c)) for c, s in zip(text, sets) if s]
            wide = WidePermutation(self.key_of(f"{kind}:{shape}"), np.array([len(s) for s, _ in own]))
            new = iter([s[k] for (s, _), k in zip(own, wide(np.array([k for _, k in own])).tolist())])
            return "".join(next(new) if s else c for c, s in zip(text, sets))
        x, out = self.permuted(f"{kind}:{shape}", n, x), []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                x, at = divmod(x, len(s))
                c = s[at]
            out.append(c)
        return "".join(reversed(out))

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        return f"{self.symbols('email', local)}@{domain}"

    def access_key(self, text: str) -> str:
        return text[:4] + self.symbols("access_key", text[4:])

    def iban(self, text: str) -> str | None:
        if not 15 <= len(text.replace(" ", "")) <= 34 or not iban_valid(text):
            return None
        body = self.symbols("iban", re.sub(r"\s", "", text)[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + text[:2] + "00")) % 97
        new = iter(f"{text[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # Each octet keeps its number of digits.
        ranges, x, n = [OCTETS[len(p)] for p in parts], 0, 1
        for p, r in zip(parts, ranges):
            x, n = x * len(r) + int(p) - r.start, n * len(r)
        x, out = self.permuted("ip:" + ".".join(str(len(p)) for p in parts), n, x), []
        for r in reversed(ranges):
            x, at = divmod(x, len(r))
            out.append(str(r[at]))
        return ".".join(reversed(out))

    def date(self, text: str) -> str | None:
        parts = re.split(r"([./-])", text)
        # Where year, month and day stand; 12/31/1999 can only be month first.
        month_first = len(parts[0]) < 4 and parts[1] == "/" and int(parts[2]) > 12
        at = (0, 2, 4) if len(parts[0]) == 4 else (4, 0, 2) if month_first else (4, 2, 0)
        try:
            day = datetime.date(*(int(parts[k]) for k in at)).toordinal()
        except ValueError:
            return None
        form = month_first, len(parts[at[2]]), len(parts[at[1]])
        days, places = days_written(*form)
        if day not in places:
            return None
        new = datetime.date.fromordinal(days[self.permuted(f"date:{form}", len(days), places[day])])
        for k, value in zip(at, (new.year, new.month, new.day)):
            parts[k] = str(value).zfill(len(parts[k]))
        return "".join(parts)

    def phone(self, text: str) -> str | None:
        n = sum(c.isdigit() for c in text)
        if not 9 <= n <= 15:
            return None
        code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        return self.digits("phone", text, code.end() if code else 0)

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        # Areas 001-899 without 666, groups 01-99, serials 0001-9999.
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permuted("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, text: str) -> str | None:
        own = re.sub(r"\D", "", text)
        if len(set(own)) < 2 or not luhn(own):
            return None
        n = len(own) - 1
        body = str(self.permuted("card", 10**n, int(own[:-1]))).zfill(n)
        new = iter(body + next(str(d) for d in range(10) if luhn(f"{body}{d}")))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def replace(self, match: re.Match, counts: dict[str, int]) -> str:
        kind, text = match.lastgroup, match.group()
        if kind == "secret_value" or match.group("secret"):
            kind, value = "secret", match.group("secret_value")
            if not re.search(r"\d", value):
                return text  # an ordinary word after a colon
            new = text[: len(text) - len(value)] + self.symbols("secret", value)
        else:
            new = getattr(self, kind)(text)
        if new is None:
            return text
        counts[kind] = counts.get(kind, 0) + 1
        return new

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind it holds."""
        if not HINT.search(text):
            return text, {}
        counts: dict[str, int] = {}
        return ANY.sub(lambda m: self.replace(m, counts), text), counts


class _Replace:
    """at: the place of the text. Counts follow the columns if asked for."""

    def __init__(self, key: bytes, at: int, counts: bool):
        self.key, self.at, self.counts = key, at, counts

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        names = Pseudonyms(self.key)
        for batch in batches:
            found = [(None, {}) if t is None else names(t) for t in batch.column(self.at).to_pylist()]
            columns = [pa.array([x for x, _ in found], pa.string()) if k == self.at else batch.column(k) for k in range(batch.num_columns)]
            if self.counts:
                columns += [pa.array([c.get(kind, 0) for _, c in found], pa.int32()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])


def pseudonymise(docs: DataFrame, *, key: str = "public-test-key", text_col="text", counts=True) -> DataFrame:
    """docs with the personal data in text_col replaced, and (with counts) pii_<kind>, how many of each kind.

    Kinds: email, access_key, secret, iban, ip, date, phone, ssn, card. Only values
    that pass their kind's check are replaced (Luhn, IBAN's remainder, octets up to
    255, days of the calendar from 1900 to 2099, and so on); their pseudonyms pass it
    too and keep separators, the length of each number, and places of letters and digits:
    1.2.1999 becomes another day with one digit for day and month, 10.2.3.4 another address
    of octets as long. Dates and addresses written with other lengths are other formats, and
    are linked within their format only. In production
    the key comes from a secret store: whoever holds it can undo the pseudonyms.

    A null text stays null with zero counts, an empty one empty; all other columns
    come through. With counts, columns of docs named like a count are replaced by it; without,
    the columns are those of docs. Every row is worked on alone; an empty table gives an empty result.
    """
    names = [f"pii_{kind}" for kind in KINDS] if counts else []
    rest = [c for c in docs.columns if c == text_col or c.lower() not in names]
    rows = docs.select(*[named(c).cast("string").alias(c) if c == text_col else named(c) for c in rest])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.IntegerType()) for n in names]])
    return mapped(rows, _Replace(key.encode(), rest.index(text_col), counts), schema)
