"""Text functions as Spark expressions, and the few that need Python."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White_Space of Unicode; str.split() would also take the separators U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_STOP_MARK = re.compile(rf"[.!?](?=[{SPACE}]|\Z)")
_VISIBLE = re.compile(f"[^{SPACE}]")

STOP_WORDS = sorted(
    set(
        """a about an and are as at be been being but by can could did do does for from had has have if in into
        is it its may might no not of on or shall should than that the then this through to was were will with would""".split()
    )
)
ABBREVIATIONS = frozenset(
    """approx apr aug ave blvd capt co col corp cpl dec dept dr eq est etc feb fig gen gov inc jan jr jul jun ltd maj
    mar mr mrs ms no nov oct prof pvt ref sep sgt sr st univ vol vs""".split()
)
DOTTED = ("a.m", "e.g", "i.e", "p.m", "u.k", "u.s")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}']"), lambda t: F.octet_length(t) > 1)


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def trim_symbols(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")


def keywords(text: Column) -> Column:
    """Words in order, lower-case and without outer symbols, of more than two bytes and not a stop word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.transform(words(text), lambda w: trim_symbols(F.lower(w))), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stop, w))


def sentences(text: Column) -> Column:
    """Sentences that end with a stop before white space and a capital or a quotation mark."""
    marked = F.regexp_replace(text, "([.!?])(?U:\\s+)(?=[\\p{IsUppercase}\"'])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def strip_html(html: Column) -> Column:
    """Text without tags and without the content of script and style; entities stay."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1[^>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"(?U)\s+", " "))


def sanitize(text: Column) -> Column:
    """Text without control characters other than line feed and tab."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")


def normal_extension(ext: Column) -> Column:
    """Lower-case, with one leading dot."""
    return F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lower(ext), r"^\.", "")))


def split_words(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if w]


def split_sentences(text: str, abbreviations: bool = True) -> list[str]:
    """sentences() on a string; with abbreviations a dot after one, or after a single letter, ends nothing."""
    out, start = [], 0
    for m in _STOP_MARK.finditer(text):
        at = m.start()
        if at == start:
            continue
        follow = _VISIBLE.search(text, at + 1)
        if follow and not (follow[0].isupper() or follow[0] in "\"'"):
            continue
        if abbreviations and m[0] == ".":
            word = (split_words(text[start:at]) or [""])[-1].lower() if text[at - 1] not in SPACE else ""
            if word in ABBREVIATIONS or word.endswith(DOTTED) or (len(word.encode()) == 1 and word.isalpha()):
                continue
        out.append(text[start : at + 1].strip(SPACE))
        start = at + 1
    if rest := text[start:].strip(SPACE):
        out.append(rest)
    return out
