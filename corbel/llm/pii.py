"""Format-preserving pseudonyms for personal data.

Validated values (cards by their Luhn digit, bank accounts by ISO 7064,
telephone numbers, social security numbers, addresses, dates by the calendar,
mail names, access keys) are permuted within the set of values of the same
kind and format by a keyed Feistel network with cycle walking. Each permutation
is a bijection, so equal values become equal pseudonyms in all documents and
different values stay different, and no table of values is kept or joined.
"""

import datetime
import hashlib
import re
import secrets
import unicodedata
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_rows

#: The session's setting with the key of the queries and the pipeline.
KEY_SETTING = "spark.corbel.pii.key"
ROUNDS = 8
_OWN_KEY = secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING. Where it is unset, one made at random for this driver process: its pseudonyms are
    linked across all documents and tables of the process, but not with those of another one."""
    return spark.conf.get(KEY_SETTING, None) or _OWN_KEY


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:  # walk the cycle until the value is in range again
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            data = b"%d:%s:%d:" % (i, tweak.encode(), size) + right.to_bytes(width, "big")
            f = hashlib.blake2b(data, key=key, digest_size=min(64, width + 8)).digest()
            while len(f) < width + 8:
                f += hashlib.blake2b(f, key=key).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def _luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _refill(value: str, digits: str) -> str:
    """value with its digits replaced in order; everything else stays."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), value)


def _digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def card(value: str, key: bytes) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or d[0] == "0" or int(d[-1]) != _luhn(d[:-1]):
        return None
    n = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10**n, key, f"card{d[0]}")).zfill(n)
    return _refill(value, body + str(_luhn(body)))


def ssn(value: str, key: bytes) -> str | None:
    a, g, s = map(int, value.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not g or not s:
        return None
    x = permute((areas.index(a) * 99 + g - 1) * 9999 + s - 1, len(areas) * 99 * 9999, key, "ssn")
    return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def phone(value: str, key: bytes) -> str | None:
    d = _digits(value)
    lead = "1" if len(d) == 11 and d[0] == "1" else ""
    if len(d) - len(lead) == 10 and (lead or not value.startswith("+")):
        d = d[len(lead) :]
        if d[0] in "01" and not lead and "(" not in value:
            return None  # no such area, and nothing else that makes it a telephone number
        # Areas and exchanges from 200 stay so, and lower ones stay low.
        (least, areas), (low, n) = ((200, 800) if c >= "2" else (0, 200) for c in (d[0], d[3]))
        x = ((int(d[:3]) - least) * n + int(d[3:6]) - low) * 10**4 + int(d[6:])
        x = permute(x, areas * n * 10**4, key, f"nanp{least}-{low}")
        return _refill(value, f"{lead}{x // 10**4 // n + least:03d}{x // 10**4 % n + low:03d}{x % 10**4:04d}")
    if value.startswith("+") and 8 <= len(d) <= 15:
        code = len(re.match(r"\+([0-9]*)", value)[1])
        code = code if code < 4 else 2
        n = len(d) - code
        return _refill(value, d[:code] + str(permute(int(d[code:]), 10**n, key, f"phone{d[:code]}")).zfill(n))
    return None


def ipv4(value: str, key: bytes) -> str | None:
    o = value.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in o) or o[0] == "0":
        return None
    low, high = (1, 224) if int(o[0]) < 224 else (224, 256)
    n = (((int(o[0]) - low) * 256 + int(o[1])) * 256 + int(o[2])) * 256 + int(o[3])
    n = permute(n, (high - low) << 24, key, f"ip{low}")
    return f"{low + (n >> 24)}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"


def iban(value: str, key: bytes) -> str | None:
    s = re.sub(r"\s", "", value)
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = by_class(s[4:], key, f"iban{s[:2]}")
    s = s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02d}" + body
    it = iter(s)
    return re.sub(r"\S", lambda _: next(it), value)


@lru_cache(maxsize=4096)
def _members(block: int, category: str) -> str:
    """The characters beyond ASCII of one general category among the 256 of a block."""
    return "".join(c for c in map(chr, range(max(128, block << 8), (block + 1) << 8)) if unicodedata.category(c) == category)


def _class(c: str) -> str:
    """The characters that may stand for c; c alone if it is no letter or digit. They take as many bytes as c."""
    for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in own:
            return own
    return _members(ord(c) >> 8, unicodedata.category(c)) if ord(c) > 127 and c.isalnum() else c


def by_class(value: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted together, each within its class of _class(); the rest stays."""
    classes = [_class(c) for c in value]
    x = 0
    for c, own in zip(value, classes):
        x = x * len(own) + own.index(c)
    x, out = permute(x, prod(map(len, classes)), key, tweak + "".join(own[0] for own in classes)), []
    for own in reversed(classes):
        x, r = divmod(x, len(own))
        out.append(own[r])
    return "".join(reversed(out))


def mail(value: str, key: bytes) -> str | None:
    name, domain = value.rsplit("@", 1)
    if all(len(_class(c)) < 2 for c in name):
        return None  # nothing in it could be another
    return by_class(name, key, "mail@" + domain.lower()) + "@" + domain


def access_key(value: str, key: bytes) -> str | None:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    if not set(value[4:]) <= set(letters):
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    n, x, rest = len(letters), 0, value[4:]
    for c in rest:
        x = x * n + letters.index(c)
    x, out = permute(x, n ** len(rest), key, f"key{n}"), ""
    for _ in rest:
        x, r = divmod(x, n)
        out = letters[r] + out
    return value[:4] + out


def secret(value: str, key: bytes) -> str | None:
    if not re.search(r"[0-9]", value):
        return None
    if re.fullmatch(r"[0-9a-f]+", value):
        return f"{permute(int(value, 16), 16 ** len(value), key, f'hex{len(value)}'):0{len(value)}x}"
    return by_class(value, key, "secret")


MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
}
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(y: int, m: int, d: int, key: bytes) -> datetime.date | None:
    """The pseudonym of a calendar day from 1900 to 2099; None if there is no such day."""
    try:
        n = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST <= n <= LAST:
        return None
    return datetime.date.fromordinal(FIRST + permute(n - FIRST, LAST - FIRST + 1, key, "date"))


def date(value: str, key: bytes) -> str | None:
    """Year first, or day first and else month first; zero padding follows the value's own."""
    parts = re.split(r"([-/.])", value)
    a, b, c = parts[0], parts[2], parts[4]
    pad = 2 if a.startswith("0") or b.startswith("0") or (len(a) == 4 and len(b) == len(c) == 2) or len(a) == len(b) == 2 else 1
    if len(a) == 4:
        if not (t := _day(int(a), int(b), int(c), key)):
            return None
        return f"{t.year}{parts[1]}{t.month:0{pad}d}{parts[3]}{t.day:0{pad}d}"
    if t := _day(int(c), int(b), int(a), key):
        return f"{t.day:0{pad}d}{parts[1]}{t.month:0{pad}d}{parts[3]}{t.year}"
    if t := _day(int(c), int(a), int(b), key):
        return f"{t.month:0{pad}d}{parts[1]}{t.day:0{pad}d}{parts[3]}{t.year}"
    return None


def written_date(value: str, key: bytes) -> str | None:
    """A date with the month's name, in English, German, French or Spanish; the name stays in its language."""
    word = re.search(r"[^\W\d_]{3,}", value.replace(" de ", " "))[0]
    for names in sorted(MONTHS.values(), key=lambda names: word not in names):  # "mai" is French, "Mai" German
        at = [x.lower() for x in names]
        if word.lower() in at:
            day, year = re.search(r"(?<!\d)\d{1,2}(?!\d)", value), re.search(r"\d{4}", value)
            t = _day(int(year[0]), at.index(word.lower()) + 1, int(day[0]), key)
            if not t:
                return None
            name = names[t.month - 1]
            name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name.lower()
            d = f"{t.day:02d}" if day[0].startswith("0") else str(t.day)
            swap = {word: name, day[0]: d, year[0]: str(t.year)}
            return re.sub(r"[^\W\d_]+|\d+", lambda m: swap.get(m[0], m[0]), value)
    return None


_NAMES = "|".join(sorted({x for names in MONTHS.values() for x in names}, key=lambda x: (-len(x), x)))
#: (kind, text or class that must be there, pattern, pseudonym). Earlier rules win where matches overlap.
RULES = [
    ("mail", "@", re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), mail),
    ("access_key", "A", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])"), access_key),
    ("secret", "=:", re.compile(r"(?i)(?<![a-z])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_-]{8,})"), secret),
    ("iban", "0", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\w])"), iban),
    ("phone", "0", re.compile(r"(?<![\w+.])(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w])"), phone),
    ("phone", "+", re.compile(r"(?<![\w+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![\w])"), phone),
    ("card", "0", re.compile(r"(?<![\w.+-])[1-9][0-9]{3}(?:[ -]?[0-9]){9,15}(?![\w]|[.-][0-9])"), card),
    ("ssn", "0", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), ssn),
    ("date", "0", re.compile(r"(?<![\w./-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?!\w|[./-][0-9])"), date),
    ("date", "0", re.compile(r"(?<![\w./-])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?!\w|[./-][0-9])"), date),
    ("date", "0", re.compile(rf"(?i)(?<!\w)[0-9]{{1,2}}\.? (?:de )?(?:{_NAMES})\.?,? (?:de )?[0-9]{{4}}(?!\w)|(?<!\w)(?:{_NAMES})\.? [0-9]{{1,2}},? [0-9]{{4}}(?!\w)"), written_date),
    ("ip", "0", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), ipv4),
]
_DIGIT = re.compile(r"[0-9]")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """(text with pseudonyms, kinds of the values replaced in order)."""
    digit = _DIGIT.search(text) is not None
    found = []
    for order, (kind, needs, pattern, swap) in enumerate(RULES):
        if digit if needs == "0" else any(c in text for c in needs):
            for m in pattern.finditer(text):
                span = m.span(1) if kind == "secret" else m.span()
                found.append((order, *span, kind, swap))
    taken: list[tuple[int, int, str, str]] = []
    if not found:
        return text, []
    covered = []
    for _, a, b, kind, swap in sorted(found, key=lambda x: x[:3]):
        if any(a < y and x < b for x, y in covered):
            continue
        new = swap(text[a:b], key)
        if new is not None:
            covered.append((a, b))
            taken.append((a, b, kind, new))
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [x[2] for x in taken]


def _apply(col: pa.Array, key: bytes) -> tuple[pa.Array, np.ndarray]:
    """(column with pseudonyms, number of values replaced in each row); nulls stay null."""
    n = np.zeros(len(col), dtype=np.int64)
    look = pc.fill_null(pc.match_substring_regex(col, r"[0-9@]|(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z]{16}|[:=]\s*[\"']?[A-Za-z0-9+/_-]{8}"), False)
    at = np.flatnonzero(look.to_numpy(zero_copy_only=False))
    changed, new = np.zeros(len(col), dtype=bool), []
    for i, text in zip(at.tolist(), col.take(pa.array(at)).to_pylist()):
        done, kinds = pseudonymise(text, key)
        if kinds:
            n[i], changed[i] = len(kinds), True
            new.append(done)
    if not new:
        return col, n
    return pc.replace_with_mask(col, pa.array(changed), pa.array(new, col.type)), n


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_replaced) of every row; a null text stays null with 0 replaced.

    Rows without doc_id and repeated rows are treated like others. A value that
    fails its validation stays. Texts of any length are read whole. An empty
    table gives no rows. Other columns aren't read.
    """
    secret_key = hashlib.blake2b(key.encode()).digest()

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                col, n = _apply(part.column(1), secret_key)
                yield pa.RecordBatch.from_arrays([part.column(0), col, pa.array(n)], ["doc_id", "text", "n_replaced"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n_replaced long")


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text and, where there is a column n_chars, its new length; the other columns stay.

    Every row stays, also those without doc_id, repeated ones and those whose
    text is null or empty; n_chars changes only where a value was replaced.
    Texts of any length are read whole. An empty table gives no rows. Columns
    besides text and n_chars may have any names.
    """
    secret_key = hashlib.blake2b(key.encode()).digest()
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, f"c{at}"):
                cols = list(part.columns)
                cols[at], n = _apply(cols[at], secret_key)
                if chars is not None:
                    cols[chars] = pc.if_else(pa.array(n > 0), pc.utf8_length(cols[at]).cast(cols[chars].type), cols[chars])
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return map_rows(docs, run)
