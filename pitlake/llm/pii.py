"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each format."""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, slices, small_batches

#: Key of the registered query. Give your own to `pseudonymise`; whoever has it can undo the pseudonyms.
DEMO_KEY = b"pitlake demonstration key"
#: Setting of a session that holds the key, in hexadecimal digits.
KEY_SETTING = "spark.pitlake.pseudonyms.key"
FEISTEL_ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """Keyed permutations of 0..size-1: a balanced Feistel network over the next even power of two, walked until it
    falls into the range. `tweak` names the format, so that formats are independent."""

    def __init__(self, key: bytes, backward: bool = False):
        self.key, self.backward = key[:64], backward

    def __call__(self, x: int, size: int, tweak: str) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, n = (1 << half) - 1, (half + 7) // 8
        salt = blake2b(f"{tweak}:{size}".encode(), key=self.key, digest_size=16).digest()
        order = range(FEISTEL_ROUNDS - 1, -1, -1) if self.backward else range(FEISTEL_ROUNDS)
        while True:
            left, right = x >> half, x & mask
            for r in order:
                if self.backward:
                    left, right = right ^ self._mix(r, left, n, salt) & mask, left
                else:
                    left, right = right, left ^ self._mix(r, right, n, salt) & mask
            x = left << half | right
            if x < size:
                return x

    def _mix(self, r: int, value: int, n: int, salt: bytes) -> int:
        out, block = b"", 0
        while len(out) < n:
            out += blake2b(bytes([r, block]) + value.to_bytes(n, "big"), key=self.key, salt=salt, digest_size=min(64, n)).digest()
            block += 1
        return int.from_bytes(out[:n], "big")


def luhn_digit(digits: str) -> str:
    """The check digit that completes the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _number(digits: str, permute: Permutation, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))


def card(s: str, permute: Permutation) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    new = d
    while True:  # with digits after it, it must be as valid or invalid as before, else undoing would read it otherwise
        body = _number(new[:-1], permute, "card")
        new = body + luhn_digit(body)
        if luhn_digit(new) == luhn_digit(d):
            return _fill(s, new)


#: What stays of a phone number: country codes, and the 1 or 0 that shapes with it begin with.
_HEAD = re.compile(
    r"\+\d{1,3}(?=[ .(-])|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
    r"|1(?=[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}\Z|[ .-]?\()|0(?!\d\d[ .-]\d{3}[ .-]\d{4}\Z)"
)


def phone(s: str, permute: Permutation) -> str | None:
    m = _HEAD.match(s)
    head = m[0] if m else ""
    rest = s[len(head) :]
    d = _digits(rest)
    return head + _fill(rest, _number(d, permute, "phone")) if 7 <= len(d) <= 14 else None


def ipv4(s: str, permute: Permutation) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    span = {1: (0, 10), 2: (10, 90), 3: (100, 156)}  # each number keeps its width
    x, size = 0, 1
    for p in parts:
        first, n = span[len(p)]
        x, size = x * n + int(p) - first, size * n
    x, out = permute(x, size, "ipv4" + "".join(str(len(p)) for p in parts)), []
    for p in reversed(parts):
        first, n = span[len(p)]
        x, d = divmod(x, n)
        out.append(str(first + d))
    return ".".join(reversed(out))


def ssn(s: str, permute: Permutation) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x = permute((areas.index(a) * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, "ssn")
    return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _mixed(text: str, permute: Permutation, tweak: str) -> str:
    """ASCII letters and digits permuted together, each staying what it is; letters keep their case."""
    low = text.lower()
    radix = [10 if c in "0123456789" else 26 if "a" <= c <= "z" else 1 for c in low]
    x, size = 0, 1
    for c, r in zip(low, radix, strict=True):
        x, size = x * r + (int(c) if r == 10 else ord(c) - 97 if r == 26 else 0), size * r
    x = permute(x, size, tweak + "".join({10: "9", 26: "a", 1: "-"}[r] for r in radix))
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        x, d = divmod(x, r)
        out.append(c if r == 1 else str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def iban(s: str, permute: Permutation) -> str | None:
    bare = s.replace(" ", "").upper()
    if not 15 <= len(bare) <= 34 or _mod97(bare) != 1:
        return None
    body = _mixed(bare[4:], permute, "iban" + bare[:2])
    check = 98 - _mod97(bare[:2] + "00" + body)
    it = iter(bare[:2] + f"{check:02d}" + body)
    return "".join(" " if c == " " else next(it) for c in s)


#: Months by name, in English, German, French and Spanish: the first language that has a name is taken to be its own.
_MONTHS: dict[str, tuple[int, int]] = {}
for _lang, _names in enumerate((
    "january february march april may june july august september october november december",
    "jan feb mar apr _ jun jul aug sep oct nov dec",
    "januar februar märz _ mai juni juli _ _ oktober _ dezember",
    "janvier février mars avril _ juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)):
    for _i, _name in enumerate(_names.split(), 1):
        if _name != "_":
            _MONTHS.setdefault(_name, (_lang, _i))
_NAME = "(?:" + "|".join(sorted({f(n) for n in _MONTHS for f in (str.lower, str.upper, str.title)}, key=lambda n: (-len(n), n))) + ")"
_YEAR = r"(?:19|20)\d\d"
_ORDINAL = {"": range(1, 32), "er": (1,), "st": (1, 21, 31), "nd": (2, 22), "rd": (3, 23), "th": (*range(4, 21), *range(24, 31))}


def _days(fits: Callable[[datetime.date], bool]) -> list[int]:
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if fits(datetime.date.fromordinal(d))]


@cache
def _named_days(months: tuple[int, ...], ordinal: str, width: int) -> list[int]:
    return _days(lambda x: x.month in months and x.day in _ORDINAL[ordinal] and (width == 1) == (x.day < 10))


@cache
def _like_days(day: int, month: int) -> list[int]:
    """Days whose day and month are as wide and as readable in another order: day 1-9, 10-12 or later, month 1-9 or later."""
    return _days(lambda x: (x.day > 9) + (x.day > 12) == day and (x.month > 9) == month)


def named_date(s: str, permute: Permutation) -> str | None:
    """A date with its month's name: another of the same language and length, the day as wide and its ordinal as it was."""
    name = re.search(r"[^\W\d_]{3,}", s)
    lang, month = _MONTHS[name[0].lower()]
    near = {i: n for n, (k, i) in _MONTHS.items() if k == lang and len(n) == len(name[0])}
    m = re.search(r"(?<!\d)(\d{1,2})(st|nd|rd|th|er|)(?![\dA-Za-z])", s)
    if m is None or m[1][0] == "0" and m[2]:
        return None
    try:
        day = datetime.date(int(s[-4:]), month, int(m[1])).toordinal()
    except ValueError:
        return None
    days = _named_days(tuple(sorted(near)), m[2], 0 if m[1][0] != "0" and len(m[1]) == 2 else 1)
    at = bisect_left(days, day)
    if at == len(days) or days[at] != day:
        return None
    got = datetime.date.fromordinal(days[permute(at, len(days), f"date {lang} {len(name[0])} {m[2]} {len(m[1])}")])
    new = near[got.month]
    new = new.upper() if name[0].isupper() else new.title() if name[0][0].isupper() else new
    out = s[:-4] + f"{got.year:04d}"
    out = out[: m.start(1)] + f"{got.day:0{len(m[1])}d}" + out[m.end(1) :]
    return out[: name.start()] + new + out[name.end() :]


def date(s: str, permute: Permutation) -> str | None:
    if any(c.isalpha() for c in s):
        return named_date(s, permute)
    sep = next(c for c in s if not c.isdigit())
    parts = s.split(sep)
    year_first = len(parts[0]) == 4
    order = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]  # day first, else month first
    for y, m, d in order:
        try:
            day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # one rule for all ways to write it, which keeps the width of its numbers and whether both orders can read them
        was = datetime.date.fromordinal(day)
        like = ((was.day > 9) + (was.day > 12), was.month > 9)
        days = _like_days(*like)
        got = datetime.date.fromordinal(days[permute(bisect_left(days, day), len(days), f"date {like[0]}{int(like[1])}")])
        out = {y: f"{got.year:04d}", m: f"{got.month:0{len(parts[m])}d}", d: f"{got.day:0{len(parts[d])}d}"}
        return sep.join(out[i] for i in range(3))
    return None


def secret(s: str, permute: Permutation) -> str | None:
    low = s.lower()
    if low.isdigit() or low.isalpha():
        return None
    new = f"{permute(int(low, 16), 16 ** len(low), 'hex'):0{len(low)}x}"
    return new.upper() if s == s.upper() else new if s == low else None


def email(s: str, permute: Permutation) -> str | None:
    """Name and host change, each by itself, so that one host's addresses stay linked; the top-level domain stays."""
    local, _, host = s.rpartition("@")
    site, _, top = host.rpartition(".")
    return f"{_mixed(local, permute, 'email')}@{_mixed(site, permute, 'host')}.{top}"


#: What is looked for, in order of preference where two begin at one place.
FORMATS: tuple[tuple[str, str, Callable[[str, Permutation], str | None]], ...] = (
    ("email", r"[^\W_][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", email),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("secret", r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", secret),
    ("ipv4", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", ipv4),
    (
        "date",
        rf"(?:{_YEAR}(?:-\d\d?-|/\d\d?/|\.\d\d?\.)\d\d?|\d\d?(?:/\d\d?/|\.\d\d?\.|-\d\d?-){_YEAR}"
        rf"|\d\d?(?:st|nd|rd|th|er|\.)?(?: |-| de | of ){_NAME}(?:\.?,? | de |-){_YEAR}|{_NAME}\.? \d\d?(?:st|nd|rd|th)?,? {_YEAR})(?!\d)",
        date,
    ),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    (
        "phone",
        r"(?:\+\d{1,3}[ .-]?|1[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|\+\d{1,3}[ .-](?:\d{1,4}[ .-]){0,5}\d{2,12}(?!\d)|\+[1-9]\d{7,14}(?!\d)"
        r"|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|0\d(?:[ .-]\d\d){4}(?![ -]?\d)|0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?!\d|[ -]\d{3})",
        phone,
    ),
    ("card", r"\d(?:[ -]?\d){12,18}(?!\d)", card),
)
_ANY = re.compile(r"(?<![\w])(?<!\d[.-])(?:" + "|".join(f"(?P<{k}>{p})" for k, p, _ in FORMATS) + ")")
_EACH = {k: (re.compile(p), f) for k, p, f in FORMATS}
_SOME = re.compile(r"[0-9@]")
#: What may part a value from digits or words behind it that its pattern takes up.
_BREAKS = {"iban": " ", "phone": " .-", "card": " -"}
_REGULAR = re.compile(r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)")
_TAIL = re.compile(r"[./]\d")


def _places(kind: str, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where a value may lie in what its pattern found, the whole of it first. A card that only part of the found digits
    make up is looked for in the usual groups first, from the start on or further on."""
    breaks = [k for k in range(start + 1, end - 1) if text[k] in _BREAKS.get(kind, "")]
    if kind != "card":
        yield start, end
        yield from ((start, k) for k in reversed(breaks))
        return
    ends = [k for k in (*breaks, end) if sum(map(str.isdigit, text[start:k])) >= 13]
    if len(ends) > 1 and _TAIL.match(text, end):  # the last digits begin an address or a date
        ends.pop()
    yield start, ends[-1]
    regular = [(k, m.end()) for k in (start, *(b + 1 for b in breaks)) if (m := _REGULAR.match(text, k))]
    yield from regular
    yield from ((start, k) for k in reversed(ends[:-1]))


def replace(text: str, permute: Permutation) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each; what does not pass its format's check stays."""
    if not _SOME.search(text):
        return text, []
    out, found, at, pos = [], [], 0, 0
    while m := _ANY.search(text, pos):
        pos = m.start() + 1
        for kind, (pattern, change) in _EACH.items():
            own = pattern.match(text, m.start())
            for begin, end in _places(kind, text, *own.span()) if own else ():
                new = change(text[begin:end], permute)
                if new is not None:
                    break
            else:
                continue
            out += [text[at:begin], new]
            found.append((kind, begin, end))
            at = pos = end
            break
    return "".join([*out, text[at:]]), found


_FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting KEY_SETTING; DEMO_KEY, which is no secret, where it is unset."""
    found = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(found) if found else DEMO_KEY


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text", spans: str = "found", undo: bool = False) -> DataFrame:
    """docs with `column` pseudonymised and `spans`, an array of (kind, start, end) in code points.

    Card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, dates, phone numbers, e-mail
    names and hexadecimal secrets that are valid in their format become others that are as well; equal values
    become equal ones in all documents, and with `undo` the same key gives them back. All else stays, and so
    does the length. A null text stays null with no spans. Columns of docs stay, but for a former `spans`.

    Dates are three numbers or have the month's name in English, German, French or Spanish. A date becomes the same
    other date however its three numbers are written; one with a month's name, whose length must stay, is linked to those
    with a name of the same language and length only. 03/04/2001 is the third of April in all texts. Phone numbers begin with +, (,
    1 or 0, or are 3-3-4 digits; the country code and a leading 0 stay, and the same number with and without them is linked.
    Digits behind a card number are part of it if the check digit holds with them as well. Of two readings that begin at
    one place the first of FORMATS is taken. Long texts are read whole; repeated rows come out alike.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(spans)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, _FOUND)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    place = docs.columns.index(column)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key, undo)
        for part in slices(batches, column):
            texts, found = [], []
            for text in part.column(place).to_pylist():
                new, own = replace(text, permute) if text is not None else (None, [])
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*part.schema.names, spans])

    return docs.mapInArrow(run, schema)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms in all documents. A null text stays null, with none found; long texts are read whole; repeated rows come
    out alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark)).select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")
