"""7. PII: format-preserving pseudonyms from a keyed Feistel permutation.

Found values are validated (card check digits, IPv4 octets, phone formats, real
calendar days, IBAN and social security rules, mail addresses); each is
mapped by a permutation of its own kind's numbers that depends on a secret
key.  The result has the same format and passes the same validation, equal
values get equal pseudonyms everywhere, and different values stay different.
Nothing is looked up or exchanged between documents.
"""

from __future__ import annotations

import datetime as dt
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of

RUN_BYTES = 4 << 20
KINDS = ["email", "card", "ipv4", "phone", "ssn", "iban", "date"]
#: Rounds of the Feistel network; pseudonyms a worker remembers.
ROUNDS, MEMORY = 8, 100_000

# Patterns of candidates. A candidate is a run that no letter or digit touches.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}",
    "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
# A card may follow other digits and a hyphen: its run is tried from each of its groups on.
_BEFORE = {"card": r"(?<!\d\.)"}
_END = r"(?![^\W_])(?!\.\d)"
# The date of a time stamp is followed by T and the hour.
_AFTER = {"date": rf"(?:(?=T\d\d)|{_END})"}
_CANDIDATE = re.compile(
    r"(?<![^\W_])(?:" + "|".join(_BEFORE.get(k, r"(?<!\d[.-])") + f"(?P<{k}>{p})" + _AFTER.get(k, _END) for k, p in PATTERNS.items()) + ")"
)
_GROUP = re.compile(r"[^\W_]+")
# The groups in which cards are printed; these come before any other reading of the same digits.
_PRINTED = re.compile(r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})" + _END)
# What every candidate needs near it, for a fast first look.
_LOOK = re.compile(r"\d|@")
_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0..size-1: an alternating Feistel network over
    two halves of a mixed radix; results outside the range walk on along
    their cycle until they are inside."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.low = max(1, int(size**0.5))
        while self.low * self.low < size:
            self.low += 1
        self.mac = hmac.new(key, f"{kind}/{size}".encode(), "sha256")

    def _round(self, i: int, value: int) -> int:
        mac = self.mac.copy()
        mac.update(i.to_bytes(1, "big") + value.to_bytes(16, "big"))
        return int.from_bytes(mac.digest()[:16], "big")

    def __call__(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.low)
            for i in range(0, ROUNDS, 2):
                a = (a + self._round(i, b)) % self.low
                b = (b + self._round(i + 1, a)) % self.low
            value = a * self.low + b
            if value < self.size:
                return value


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _fill(shape: str, characters: str) -> str:
    """Put characters into the places of ``shape`` that hold letters or digits."""
    left = iter(characters)
    return "".join(next(left) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """``value(kind, text)``: the pseudonym, or None where validation fails."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutations: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def permute(self, kind: str, size: int, number: int) -> int:
        if (kind, size) not in self.permutations:
            self.permutations[kind, size] = Feistel(self.key, kind, size)
        return self.permutations[kind, size](number)

    def value(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[at] = getattr(self, "_" + kind)(text)
        return self.known[at]

    def _walk(self, kind: str, size: int, number: int, fits: Callable[[int], bool]) -> int:
        """Permute on until the number fits; a fitting start always comes back."""
        number = self.permute(kind, size, number)
        while not fits(number):
            number = self.permute(kind, size, number)
        return number

    def _card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1 or digits[0] == "0":
            return None
        n = len(digits) - 2  # the first digit (network) stays, the check digit is made anew
        own = int(digits[1:-1])
        same = digits[0] * n
        new = self._walk("card", 10**n, own, lambda v: f"{v:0{n}d}" != same)
        payload = digits[0] + f"{new:0{n}d}"
        return _fill(text, payload + str(luhn_digit(payload)))

    def _ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        number = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.permute("ipv4", 1 << 32, number).to_bytes(4, "big")))

    def _phone(self, text: str) -> str | None:
        """Any ten digits; without +1, not both area code and exchange begin with 0 or 1.
        The others are permuted among themselves, so a number has one pseudonym with and without +1."""
        head = "+1" if text.startswith("+1") else ""
        digits = re.sub(r"\D", "", text[len(head) :])

        def plain(v: int) -> bool:
            return v >= 2 * 10**9 or f"{v:010d}"[3] >= "2"

        own = plain(int(digits))
        if not own and not head:
            return None
        new = self._walk("phone", 10**10, int(digits), lambda v: plain(v) == own)
        return head + _fill(text[len(head) :], f"{new:010d}")

    def _ssn(self, text: str) -> str | None:
        def fits(v: int) -> bool:
            area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        number = int(text.replace("-", ""))
        return _fill(text, f"{self._walk('ssn', 10**9, number, fits):09d}") if fits(number) else None

    def _iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in account + plain[:4])) % 97 != 1:
            return None
        size, number = 1, 0
        for c in account:
            base = 10 if c.isdigit() else 26
            size, number = size * base, number * base + (int(c) if c.isdigit() else ord(c) - 65)
        number = self.permute("iban" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", account)), size, number)
        new = []
        for c in reversed(account):
            base = 10 if c.isdigit() else 26
            number, d = divmod(number, base)
            new.append(str(d) if c.isdigit() else chr(65 + d))
        account = "".join(reversed(new))
        return _fill(text, f"{country}{_iban_check(country, account):02d}{account}")

    def _date(self, text: str) -> str | None:
        form = (
            "%Y-%m-%d" if "-" in text else "%Y/%m/%d" if text[4] == "/" else "%d.%m.%Y" if "." in text else "%m/%d/%Y"
        )
        for known in (form, "%d/%m/%Y") if form == "%m/%d/%Y" else (form,):
            try:
                day = dt.datetime.strptime(text, known).date().toordinal()
            except ValueError:
                continue
            if _FIRST <= day <= _LAST:
                new = dt.date.fromordinal(_FIRST + self.permute("date", _LAST - _FIRST + 1, day - _FIRST))
                return new.strftime(known)
        return None

    def _email(self, text: str) -> str | None:
        local, domain = text.rsplit("@", 1)
        size, number = 1, 0
        kinds = []
        for c in local:
            base, first = (10, 48) if c.isdigit() else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (1, ord(c))
            kinds.append((base, first))
            size, number = size * base, number * base + (ord(c) - first)
        shape = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", local)))
        if size < 2:
            return None
        number = self.permute(f"email/{shape}", size, number)
        new = []
        for base, first in reversed(kinds):
            number, d = divmod(number, base)
            new.append(chr(first + d))
        return "".join(reversed(new)) + "@" + domain


def _valid(text: str, m: re.Match, names: Pseudonyms) -> tuple[str, int, str | None]:
    """Kind, end and pseudonym of the value that begins where the run ``m`` does.

    A card or IBAN may be followed by other groups of digits or letters (an
    expiry date, a check value, a count), which the pattern takes in: the run
    is tried up to each of its group borders, the longest first.
    """
    kind, start, end = m.lastgroup or "", m.start(), m.end()
    if kind == "card" and (card := _PRINTED.match(text, start)) and (got := names.value(kind, card.group())) is not None:
        return kind, card.end(), got
    got = names.value(kind, m.group())
    if got is None:  # not valid as this kind: a value of another kind may hide in it
        for other in KINDS:
            if other != kind and re.fullmatch(PATTERNS[other], m.group()):
                got = names.value(other, m.group())
                if got is not None:
                    return other, end, got
    if got is None and kind in ("card", "iban"):
        for g in reversed([g.end() for g in _GROUP.finditer(text, start, end)][:-1]):
            if re.fullmatch(PATTERNS[kind], text[start:g]) and (got := names.value(kind, text[start:g])) is not None:
                end = g
                break
    if got is not None and kind == "card":  # by chance, where a card as printed begins inside and is valid
        for g in [g.end() for g in _GROUP.finditer(text, start, end)][:-1]:
            if (card := _PRINTED.match(text, g + 1)) and names.value(kind, card.group()) is not None:
                return kind, end, None
    return kind, end, got


def pseudonymised(text: str | None, names: Pseudonyms) -> tuple[str | None, dict[str, int]]:
    """The text with its valid values replaced, and their number by kind."""
    found: dict[str, int] = {}
    if not text or not _LOOK.search(text):
        return text, found

    out, done, at = [], 0, 0
    while m := _CANDIDATE.search(text, at):
        kind, end, got = _valid(text, m, names)
        if got is None:  # a value may begin at the run's next group
            at = _GROUP.search(text, m.start()).end()
            continue
        found[kind] = found.get(kind, 0) + 1
        out += [text[done : m.start()], got]
        done = at = end
    return "".join([*out, text[done:]]), found


def pseudonymise(docs: DataFrame, key: bytes, counts: str | None = "pii") -> DataFrame:
    """``docs`` with the valid values in ``text`` replaced by pseudonyms.

    All columns of ``docs`` stay, in order; with ``counts`` a column of
    that name (map of kind to replaced values) follows.  Numbers that fail
    validation, and all other text, stay as they are; where a run of groups of
    digits fails, the runs of its groups are tried from each group on.  Null texts stay null
    and empty ones empty.  Repeated rows give equal rows.  An empty table gives no
    rows.  A ``counts`` name that ``docs`` has already is an error.
    """
    if counts and counts.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {counts}; pass another name")
    typed = bounded_batches(docs).withColumn("text", F.col("text").cast("string"))
    at = [c.lower() for c in typed.columns].index("text")
    schema = typed.withColumn(counts, F.lit(None).cast("map<string,long>")).schema if counts else typed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for part in pieces_of(batch, batch.schema.names[at], RUN_BYTES):
                got = [pseudonymised(t, names) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in got], pa.string())
                if counts:
                    columns.append(pa.array([list(f.items()) for _, f in got], pa.map_(pa.string(), pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *([counts] if counts else [])])

    return typed.mapInArrow(run, schema)
