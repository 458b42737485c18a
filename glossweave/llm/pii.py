"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated (check digits, calendar, number plans) and
replaced by a keyed permutation of the values of their format: a Feistel network over the
integers below the number of such values, walked along its cycle until it meets a value
that is valid again (Black and Rogaway 2002).  Equal values get equal pseudonyms in every
document and no two values the same one, so links survive; without the key they do not lead
back.  A check digit is computed anew, so a valid card stays valid.

Forms: mail addresses; IBANs, plain or spaced; cards of 13 to 19 digits, plain or in groups of 4-4-4-1
to 4-4-4-7, 4-4-4-4-1 to 4-4-4-4-3 or 4-6-5; phones with + and country code, (555) 123-4567, 555-123-4567,
555.123.4567, 555 123 4567 and ten bare digits; 123-45-6789; IPv4; IPv6 of eight groups or with ::;
2024-12-31, 2024/12/31, 2024.12.31, 31.12.2024, 31-12-2024, 12/31/2024, 31/12/2024, December 31, 2024 and
31 December 2024, in full or by three letters.  Phones without + must have an area and an exchange that North
America's plan uses, and bare or spaced digits are no phone otherwise.  Other forms stay in clear, such as
two-digit years and months in other languages; a mail address keeps its host.

All forms of a value share one permutation, so a date or a number is linked however it is written.
A slashed date that could be either has the month first.  Days after the twelfth are permuted among themselves,
so that a slashed date with the day first can be told from the others before and after.

What is not valid is no personal datum here and stays.  Null texts stay null.  Rows are kept
as they are (repeated rows, null ids, extra columns); nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from ipaddress import IPv6Address
from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")

#: Names of months, which may stand by their first three letters.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTHS = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    rf"|(?P<iban>{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}{_END})"
    r"|(?P<phone>(?<![A-Za-z0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![A-Za-z0-9+])\+[2-9][0-9]{0,2}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}(?![0-9]*\.[0-9])){2,4}(?![0-9])"
    r"|(?<![A-Za-z0-9(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9(.,/+-])(?<![0-9]\x20)[2-9][0-9]{2}(?P<_s>\x20?)[2-9][0-9]{2}(?P=_s)[0-9]{4}(?![A-Za-z0-9]|[.,/-][0-9]|\x20[0-9]))"
    rf"|(?P<date>{_EDGE}(?:[0-9]{{4}}(?P<_d>[-./])[0-9]{{2}}(?P=_d)[0-9]{{2}}|[0-9]{{1,2}}(?P<_e>[-./])[0-9]{{1,2}}(?P=_e)[0-9]{{4}}"
    rf"|(?:{_MONTHS})\.?\x20[0-9]{{1,2}},?\x20[0-9]{{4}}|[0-9]{{1,2}}\.?\x20(?:{_MONTHS})\.?,?\x20[0-9]{{4}}){_END})"
    rf"|(?P<ssn>{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}(?!-))"
    r"|(?P<ip>(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"
    r"|(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![A-Za-z0-9:]|\.[0-9]))"
    rf"|(?P<card>{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?P<_a>[ -])[0-9]{{4}}(?P=_a)[0-9]{{4}}(?P=_a)"
    rf"(?:[0-9]{{4}}(?P=_a)[0-9]{{1,3}}|[0-9]{{1,7}})"
    rf"|[0-9]{{4}}(?P<_b>[ -])[0-9]{{6}}(?P=_b)[0-9]{{5}}){_END})"
)
_SOME = re.compile("[0-9@]")


class Permutation:
    """Keyed permutations of the integers below any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        data = tweak + bytes([k]) + half.to_bytes((bits + 7) // 8 or 1, "big")
        out = hashlib.blake2b(data, key=self.key, digest_size=32).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def apply(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Image of ``x``; the valid values below ``size`` are permuted among themselves."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mark = f"{tweak}:{size}".encode()
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(mark, k, right, bits)
            x = left << bits | right
            if x < size and valid(x):
                return x


def luhn(digits: str) -> int:
    """Check digit of a payload."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return -total % 10


def _fill(like: str, symbols: str) -> str:
    """``like`` with its letters and digits replaced in order."""
    own = iter(symbols)
    return "".join(next(own) if c.isalnum() else c for c in like)


def _mixed(p: Permutation, text: str, tweak: str) -> str:
    """Permutes letters and digits, each within its class; other characters stay."""
    sizes = [10 if c.isdigit() else 26 for c in text]
    value = 0
    for c, size in zip(text, sizes):
        value = value * size + (int(c) if size == 10 else ord(c.lower()) - 97)
    value = p.apply(value, prod(sizes), tweak + "".join("d" if s == 10 else "a" for s in sizes))
    out = []
    for c, size in zip(reversed(text), reversed(sizes)):
        value, d = divmod(value, size)
        out.append(str(d) if size == 10 else chr(d + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


def _email(p: Permutation, text: str) -> str | None:
    local, _, host = text.partition("@")
    own = "".join(c for c in local if c.isalnum())
    return f"{_fill(local, _mixed(p, own, 'email'))}@{host}" if own else None


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(p: Permutation, text: str) -> str | None:
    plain = text.replace(" ", "")
    if len(plain) < 15:
        return None
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if _iban_check(country, rest) != check:
        return None
    rest = _mixed(p, rest, "iban" + country)
    return _fill(text, country + _iban_check(country, rest) + rest)


def _card(p: Permutation, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if len(digits) < 13 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    width = len(digits) - 2  # the first digit names the kind of card and stays
    one = lambda x: len(set(digits[0] + f"{x:0{width}d}")) > 1
    payload = digits[0] + f"{p.apply(int(digits[1:-1]), 10**width, 'card' + digits[0], one):0{width}d}"
    return _fill(text, payload + str(luhn(payload)))


def _phone(p: Permutation, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not text.startswith("+"):
        code, own = "1", digits
    else:
        code = re.match(r"\+([0-9]+)[ .(-]", text)[1] if re.match(r"\+[0-9]{1,3}[ .(-]", text) else digits[:2]
        own = digits[len(code) :]
    if not 7 <= len(code + own) <= 15:
        return None
    width = len(own)
    if code == "1":
        if width != 10:
            return None
        # Areas and exchanges that the plan uses stay such; numbers with others are personal all the same.
        used = lambda x: (x[0] not in "01", x[3] not in "01")
        if not text.startswith("+") and used(own) != (True, True) and not re.search(r"[().-]", text):
            return None
        plan = lambda x: used(f"{x:010d}") == used(own)
    else:
        plan = lambda x: f"{x:0{width}d}"[0] == "0" if own[0] == "0" else f"{x:0{width}d}"[0] != "0"
    value = f"{p.apply(int(own), 10**width, 'phone' + code, plan):0{width}d}"
    return _fill(text, (code if text.startswith("+") else "") + value)


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(p: Permutation, text: str) -> str | None:
    value = int(text.replace("-", ""))
    return _fill(text, f"{p.apply(value, 10**9, 'ssn', _ssn_valid):09d}") if _ssn_valid(value) else None


def _ip(p: Permutation, text: str) -> str | None:
    if ":" in text:
        try:
            value = int(IPv6Address(text))
        except ValueError:
            return None
        # Short forms without a digit are names of code, as in abc::def.
        if "::" in text and (text.count(":") < 3 or not any(c.isdigit() for c in text)):
            return None
        new = IPv6Address(p.apply(value, 1 << 128, "ip6"))
        return str(new).upper() if text.isupper() else str(new)
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, p.apply(value, 1 << 32, "ip").to_bytes(4, "big")))


def _date(p: Permutation, text: str) -> str | None:
    # The parts of the date and what stands between; which part is the year, month and day.
    parts = re.findall("[0-9]+|[A-Za-z]+", text)
    if parts[0].isalpha():
        orders = ((2, 0, 1),)
    elif parts[1].isalpha() or text[len(parts[0])] in ".-" and len(parts[2]) == 4:
        orders = ((2, 1, 0),)
    elif len(parts[0]) == 4:
        orders = ((0, 1, 2),)
    else:
        orders = ((2, 0, 1), (2, 1, 0))
    names = {m[:3]: k for k, m in enumerate(MONTHS, 1)}
    for year, month, day in orders:
        try:
            old = date(int(parts[year]), names.get(parts[month][:3]) or int(parts[month]), int(parts[day]))
        except ValueError:
            continue
        break
    else:
        return None
    # Dates stay in their century, on the same side of the twelfth.
    first = date(max(1, old.year // 100 * 100), 1, 1).toordinal()
    size = date(old.year // 100 * 100 + 99, 12, 31).toordinal() - first + 1
    side = lambda x: (date.fromordinal(first + x).day > 12) == (old.day > 12)
    new = date.fromordinal(first + p.apply(old.toordinal() - first, size, "date", side))
    number = lambda x, like: f"{x:02d}" if len(like) == 2 and (like[0] == "0" or x > 9) else str(x)
    if parts[month].isalpha():
        name = MONTHS[new.month - 1]
        shown = name[:3] if len(parts[month]) == 3 and parts[month] != "May" else name
        own = {year: f"{new.year:04d}", month: shown, day: number(new.day, parts[day])}
    else:
        fixed = lambda x, like: f"{x:02d}" if len(like) == 2 else str(x)
        own = {year: f"{new.year:04d}", month: fixed(new.month, parts[month]), day: fixed(new.day, parts[day])}
    place = iter(range(3))
    return re.sub("[0-9]+|[A-Za-z]+", lambda _: own[next(place)], text)


_MAKE = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


class Pseudonyms:
    """Replaces the personal data of texts under one key."""

    def __init__(self, key: bytes):
        permutation = Permutation(key)
        self.of = lru_cache(1 << 16)(lambda kind, value: _MAKE[kind](permutation, value))

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, int, int]]]:
        """The new text, and ``(kind, start, end, new start, new end)`` of every datum."""
        out, spans, at, shift, begin = [], [], 0, 0, 0
        while m := PATTERN.search(text, begin):
            kind = next(k for k in KINDS if m[k] is not None)
            value, new = m[0], self.of(kind, m[0])
            while new is None and kind in ("iban", "phone", "card") and " " in value:
                # Words after the number may look like more of it.
                value = value[: value.rindex(" ")]
                new = self.of(kind, value)
            if new is None:
                begin = m.start() + 1
                continue
            begin = m.start() + len(value)
            out += [text[at : m.start()], new]
            spans.append((kind, m.start(), begin, m.start() + shift, m.start() + shift + len(new)))
            shift += len(new) - len(value)
            at = begin
        return "".join([*out, text[at:]]), spans


SPANS = "array<struct<kind: string, start: int, end: int, new_start: int, new_end: int>>"


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", new: str = "new_text", spans: str = "pii") -> DataFrame:
    """``docs`` with the text under pseudonyms and the spans of every datum, in code points.

    Columns of ``docs`` named like ``new`` or ``spans``, or ``_pii``, are replaced.
    """

    @F.pandas_udf(f"text: string, spans: {SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Pseudonyms(key)
        for batch in batches:
            rows = [
                (x, []) if x is None or not _SOME.search(x) else own.replace(x) for x in batch
            ]
            yield pd.DataFrame(
                {
                    "text": [t for t, _ in rows],
                    "spans": [
                        [dict(zip(("kind", "start", "end", "new_start", "new_end"), s)) for s in found]
                        for _, found in rows
                    ],
                }
            )

    return (
        docs.withColumn("_pii", run(F.col(text)))
        .withColumns({new: F.col("_pii.text"), spans: F.col("_pii.spans")})
        .drop("_pii")
    )
