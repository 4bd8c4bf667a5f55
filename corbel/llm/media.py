"""Media types by signature, and media embedded in other content.

An Aho-Corasick automaton finds all magic bytes in one pass. Each hit is given
to the format's validator, which follows the format's own structure (chunk
lengths, checksums, directories, trailers) and returns the length, or nothing
if the structure doesn't hold. The value's type is that of the valid signature
at its start; valid signatures elsewhere are embedded media and are carved
with their exact bytes, also out of base64 data URIs.
"""

import base64
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache


def _u16(b, at, end="<"):
    return struct.unpack_from(end + "H", b, at)[0]


def _u32(b, at, end="<"):
    return struct.unpack_from(end + "I", b, at)[0]


def png(b: bytes, at: int) -> int | None:
    i, seen = at + 8, []
    while i + 12 <= len(b):
        n, kind = _u32(b, i, ">"), b[i + 4 : i + 8]
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != _u32(b, i + 8 + n, ">"):
            return None
        seen.append(kind)
        i += 12 + n
        if kind == b"IEND":
            return i - at if seen[0] == b"IHDR" and b"IDAT" in seen else None
    return None


def jpeg(b: bytes, at: int) -> int | None:
    i, frame = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        kind = b[i + 1]
        if kind == 0xFF:
            i += 1
        elif kind == 0xD9:
            return i + 2 - at if frame else None
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            i += 2
        else:
            n = _u16(b, i + 2, ">")
            if n < 2 or i + 2 + n > len(b):
                return None
            frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
            i += 2 + n
            if kind == 0xDA:  # entropy-coded data up to the next real marker
                while True:
                    i = b.find(b"\xff", i)
                    if i < 0 or i + 1 >= len(b):
                        return None
                    if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                        break
                    i += 2
    return i + 2 - at if frame and b[i : i + 2] == b"\xff\xd9" else None


def gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    image = False

    def blocks(i):
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at if image else None
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            image = True
            own = b[i + 9]
            i = blocks(i + 10 + (3 << (own & 7) + 1 if own & 0x80 else 0) + 1)
        else:
            return None
    return None


_RIFF = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}


def riff(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 12 > len(b) or (kind := _RIFF.get(b[at + 8 : at + 12])) is None:
        return None
    end = at + 8 + _u32(b, at + 4)
    if end > len(b):
        return None
    i = at + 12
    while i + 8 <= end:
        n = _u32(b, i + 4)
        i += 8 + n + n % 2
    return (end + (end - at) % 2 * (end < len(b)) - at, kind) if end <= i <= end + 1 and i > at + 12 else None


def bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    n, zero, pixels, header = _u32(b, at + 2), _u32(b, at + 6), _u32(b, at + 10), _u32(b, at + 14)
    known = header in (12, 40, 52, 56, 64, 108, 124)
    return n if known and not zero and 14 + header <= pixels < n <= len(b) - at and _u16(b, at + 26 if header > 12 else at + 22) == 1 else None


def tiff(b: bytes, at: int) -> int | None:
    end = "<" if b[at : at + 2] == b"II" else ">"
    size = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
    if at + 8 > len(b):
        return None
    place, last, seen = _u32(b, at + 4, end), 8, set()
    while place:
        if place in seen or at + place + 2 > len(b):
            return None
        seen.add(place)
        n = _u16(b, at + place, end)
        stop = place + 2 + 12 * n
        if not n or at + stop + 4 > len(b):
            return None
        strips: dict[int, list[int]] = {}
        for j in range(n):
            e = at + place + 2 + 12 * j
            tag, kind, count = _u16(b, e, end), _u16(b, e + 2, end), _u32(b, e + 4, end)
            if not 1 <= kind <= 12:
                return None
            total = size[kind] * count
            where = e + 8 if total <= 4 else at + _u32(b, e + 8, end)
            if where + total > len(b):
                return None
            if total > 4:
                last = max(last, where - at + total)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                strips[tag] = [(_u16 if kind == 3 else _u32)(b, where + size[kind] * k, end) for k in range(count)]
        for a, c in ((273, 279), (324, 325)):
            last = max([last, *(x + y for x, y in zip(strips.get(a, []), strips.get(c, [])))])
        last = max(last, stop + 4)
        place = _u32(b, at + stop, end)
    return last if seen and at + last <= len(b) else None


def pdf(b: bytes, at: int) -> int | None:
    if not re.match(rb"%PDF-[12]\.\d", b[at : at + 8]):
        return None
    stop = b.find(b"%PDF-", at + 5)  # the next file's own end isn't this one's
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    end += 5
    while end < len(b) and b[end] in b"\r\n" and end - at < len(b):
        end += 1
        if b[end - 1] == 10:
            break
    return end - at


def zipped(b: bytes, at: int) -> tuple[int, str] | None:
    end = at
    while True:
        end = b.find(b"PK\x05\x06", end + 1)
        if end < 0 or end + 22 > len(b):
            return None
        n, size, place = _u16(b, end + 10), _u32(b, end + 12), _u32(b, end + 16)
        if at + place + size != end:
            continue
        i, names = at + place, []
        for _ in range(n):
            if i + 46 > end or b[i : i + 4] != b"PK\x01\x02" or b[at + _u32(b, i + 42) : at + _u32(b, i + 42) + 4] != b"PK\x03\x04":
                return None
            names.append(b[i + 46 : i + 46 + _u16(b, i + 28)])
            i += 46 + _u16(b, i + 28) + _u16(b, i + 30) + _u16(b, i + 32)
        length = end + 22 + _u16(b, end + 20) - at
        if i != end or at + length > len(b):
            return None
        kind = "application/zip"
        for part, name in ((b"word/", "wordprocessingml.document"), (b"xl/", "spreadsheetml.sheet"), (b"ppt/", "presentationml.presentation")):
            if b"[Content_Types].xml" in names and any(x.startswith(part) for x in names):
                kind = "application/vnd.openxmlformats-officedocument." + name
        if names and names[0] == b"mimetype" and b"application/epub+zip" in b[at : at + 120]:
            kind = "application/epub+zip"
        return length, kind


def _stream(make):
    def run(b: bytes, at: int) -> int | None:
        try:
            d, rest = make(), b[at:]
            while not d.eof:  # in parts, so that a small stream can't fill the memory
                out = d.decompress(rest, 1 << 20)
                rest = getattr(d, "unconsumed_tail", b"")
                if not out and not rest and not d.eof:
                    return None
            return len(b) - at - len(d.unused_data)
        except Exception as e:  # each codec has errors of its own; all of them say that the stream isn't valid
            if isinstance(e, MemoryError):
                raise
            return None

    return run


def _gzip():
    return zlib.decompressobj(31)


def _bz2():
    import bz2

    return bz2.BZ2Decompressor()


def _xz():
    import lzma

    return lzma.LZMADecompressor(lzma.FORMAT_XZ)


def flac(b: bytes, at: int) -> int | None:
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind or n != 34) or i + 4 + n > len(b):
            return None
        last, first = b[i] >> 7, False
        i += 4 + n
        if last:
            ok = i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xFC == 0xF8
            return len(b) - at if ok else None  # frames have no total length: to the end of the value
    return None


def ogg(b: bytes, at: int) -> tuple[int, str] | None:
    i, serial, first = at, None, b""
    while i + 27 <= len(b) and b[i : i + 4] == b"OggS" and b[i + 4] == 0:
        own, n = _u32(b, i + 14), b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + size > len(b):
            return None
        if serial is None:
            if not b[i + 5] & 2:
                return None
            serial, first = own, b[i + 27 + n : i + 35 + n]
        last = b[i + 5] & 4 and own == serial
        i += size
        if last:
            return i - at, "video/ogg" if first[1:7] == b"theora" else "audio/ogg"
    return None


def _mp3_frame(b: bytes, i: int) -> int:
    if i + 4 > len(b) or b[i] != 0xFF or b[i + 1] & 0xE6 != 0xE2:
        return 0
    version, rate, speed, pad = b[i + 1] >> 3 & 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3, b[i + 2] >> 1 & 1
    if version == 1 or not 0 < rate < 15 or speed == 3:
        return 0
    table = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if version == 3 else (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
    hz = (44100, 48000, 32000)[speed] >> {3: 0, 2: 1, 0: 2}[version]
    return (144 if version == 3 else 72) * table[rate - 1] * 1000 // hz + pad


def mp3(b: bytes, at: int) -> int | None:
    if at + 10 > len(b) or any(x > 127 for x in b[at + 6 : at + 10]) or b[at + 3] not in (2, 3, 4):
        return None
    i = at + 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    frames = 0
    while (n := _mp3_frame(b, i)) and i + n <= len(b):
        i, frames = i + n, frames + 1
    return i - at if frames else None


_BRANDS = {b"qt  ": "video/quicktime", b"M4A ": "audio/mp4", b"heic": "image/heic", b"heix": "image/heic", b"avif": "image/avif"}
_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"meta", b"sidx", b"styp", b"pdin", b"emsg"}


def mp4(b: bytes, at: int) -> tuple[int, str] | None:
    """at is that of the type; the box's length comes before it."""
    start = at - 4
    i, kinds = start, set()
    if start < 0 or at + 8 > len(b):
        return None
    brand = b[at + 4 : at + 8]
    while i + 8 <= len(b) and b[i + 4 : i + 8] in _BOXES and not (kinds and b[i + 4 : i + 8] == b"ftyp"):
        n = _u32(b, i, ">")
        if n == 1 and i + 16 <= len(b):
            n = int.from_bytes(b[i + 8 : i + 16], "big")
        elif n == 0:
            n = len(b) - i
        if n < 8 or i + n > len(b):
            return None
        kinds.add(b[i + 4 : i + 8])
        i += n
    ok = b"ftyp" in kinds and kinds & {b"moov", b"meta", b"moof"}
    return (i - start, _BRANDS.get(brand, "video/mp4")) if ok else None


def matroska(b: bytes, at: int) -> tuple[int, str] | None:
    def number(i, keep):
        if i >= len(b) or not b[i]:
            return 0, 0
        n = 9 - b[i].bit_length()
        v = int.from_bytes(b[i : i + n], "big")
        return (v if keep else v & (1 << 7 * n) - 1), n

    size, n = number(at + 4, False)
    head = at + 4 + n
    if not n or head + size + 5 > len(b) or b[head + size : head + size + 4] != b"\x18\x53\x80\x67":
        return None
    body, m = number(head + size + 4, False)
    end = head + size + 4 + m + body
    if body == (1 << 7 * m) - 1:
        end = len(b)
    return (end - at, "video/webm" if b"webm" in b[head : head + size] else "video/x-matroska") if m and end <= len(b) else None


def ico(b: bytes, at: int) -> int | None:
    n = _u16(b, at + 4) if at + 6 <= len(b) else 0
    if not 0 < n <= 64 or at + 6 + 16 * n > len(b):
        return None
    end = 6 + 16 * n
    for j in range(n):
        e = at + 6 + 16 * j
        size, place = _u32(b, e + 8), _u32(b, e + 12)
        if b[e + 3] or not size or place < 6 + 16 * n or at + place + size > len(b):
            return None
        if b[at + place : at + place + 4] not in (b"\x89PNG", b"\x28\0\0\0"):
            return None
        end = max(end, place + size)
    return end


_HTML = re.compile(rb"(?i)\s*<(?:!doctype\s+html|html|head|body)\b")


def html(b: bytes, at: int) -> int | None:
    end = b.lower().rfind(b"</html>", at)
    return (end + 7 if end >= 0 else len(b)) - at if _HTML.match(b[at : at + 64]) else None


def svg(b: bytes, at: int) -> int | None:
    end = b.find(b"</svg>", at)
    close = b.find(b">", at)
    return end + 6 - at if end >= 0 and 0 <= close < end and re.match(rb"<svg[\s>]", b[at : at + 5]) else None


#: (magic bytes, type, validator, bytes from the magic's start back to the file's). A validator may name the type itself.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png, 0),
    (b"\xff\xd8\xff", "image/jpeg", jpeg, 0),
    (b"GIF87a", "image/gif", gif, 0),
    (b"GIF89a", "image/gif", gif, 0),
    (b"RIFF", "", riff, 0),
    (b"BM", "image/bmp", bmp, 0),
    (b"II*\0", "image/tiff", tiff, 0),
    (b"MM\0*", "image/tiff", tiff, 0),
    (b"\0\0\1\0", "image/x-icon", ico, 0),
    (b"%PDF-", "application/pdf", pdf, 0),
    (b"PK\3\4", "", zipped, 0),
    (b"\x1f\x8b\x08", "application/gzip", _stream(_gzip), 0),
    (b"BZh91AY&SY", "application/x-bzip2", _stream(_bz2), 0),
    (b"\xfd7zXZ\0", "application/x-xz", _stream(_xz), 0),
    (b"fLaC", "audio/flac", flac, 0),
    (b"OggS", "", ogg, 0),
    (b"ID3", "audio/mpeg", mp3, 0),
    (b"ftyp", "", mp4, 4),
    (b"\x1aE\xdf\xa3", "", matroska, 0),
    *[(x, "text/html", html, 0) for x in (b"<!DOCTYPE", b"<!doctype", b"<!Doctype", b"<html", b"<HTML")],
    (b"<svg", "image/svg+xml", svg, 0),
]
DATA_URI = re.compile(rb"""(["'(]?)data:(?:[a-zA-Z0-9.+-]+/[a-zA-Z0-9.+-]+)?(?:;[a-zA-Z0-9=._-]+)*;base64,""")
_CLOSE = {b'"': b'"', b"'": b"'", b"(": b")"}
_CODED, _SPACED = re.compile(rb"[A-Za-z0-9+/]+={0,2}"), re.compile(rb"[A-Za-z0-9+/\s]+(?:=\s*){0,2}")
#: Bytes of carved media after which a batch is handed on.
MOST_CARVED = 16 << 20
TEXT = {"text/html", "image/svg+xml"}


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, *_) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), i)
    a.add_word("base64,", -1)
    a.make_automaton()
    return a


def leading(content: bytes) -> tuple[str, int] | None:
    """(type, length) by the signature that is valid at the very start."""
    for magic, name, check, back in SIGNATURES:
        if content[back : back + len(magic)] == magic and (got := check(content, back)) is not None:
            size, name = got if isinstance(got, tuple) else (got, name)
            return name, size
    return None


def data_uris(content: bytes):
    """(start, end, bytes) of the base64 data URIs.

    Between quotation marks or brackets the data may have white space and goes
    up to the closing one; anywhere else, and where there is none or other
    characters before it, they end at the first character that isn't base64's.
    """
    for m in DATA_URI.finditer(content):
        begin, close = m.end(), content.find(_CLOSE[m[1]], m.end()) if m[1] else -1
        if close >= 0 and _SPACED.fullmatch(content, begin, close):
            end = close
        elif coded := _CODED.match(content, begin):
            end = coded.end()
        else:
            continue
        data = re.sub(rb"[\s=]", b"", content[begin:end])
        data = data[: len(data) - (len(data) % 4 == 1)]
        yield m.start() + len(m[1]), end, base64.b64decode(data + b"=" * (-len(data) % 4))


def sniff(content: bytes, automaton) -> tuple[str, list[tuple[int, int, str, bytes]]]:
    """(type of the content, embedded media as (offset, length there, type, bytes)).

    A valid signature at the start, after white space for text formats, gives
    the type; without one it is text/plain if the bytes are UTF-8 text without
    control characters, else application/octet-stream. Media inside other
    valid media aren't carved, except those inside HTML, which is text. Of a
    data URI the medium's own bytes are taken, by its validator's length.
    """
    kind, until, found, uri = "", 0, [], False
    lead = len(content) - len(content.lstrip(b" \t\r\n"))
    for last, i in automaton.iter(content.decode("latin-1")):
        if i < 0:
            uri = True
            continue
        magic, name, check, back = SIGNATURES[i]
        at = last + 1 - len(magic) - back
        if at < until:
            continue
        if name in TEXT and name == "text/html" and at > lead:
            continue
        got = check(content, at + back)
        if got is None:
            continue
        size, name = got if isinstance(got, tuple) else (got, name)
        if at == 0 or (name in TEXT and at == lead):
            kind = name
            until = 0 if name == "text/html" else at + size
        else:
            found.append((at, size, name, content[at : at + size]))
            until = at + size
    if uri:
        for at, end, inner in data_uris(content):
            if own := leading(inner):
                found.append((at, end - at, own[0], inner[: own[1]]))
    if not kind:
        try:
            kind = "application/octet-stream" if re.search(r"[\0-\x08\x0b\x0e-\x1f]", content.decode()) or not content else "text/plain"
        except UnicodeDecodeError:
            kind = "application/octet-stream"
    return kind, sorted(found)


def media(values: DataFrame, id_col: str, content: str, declared: str) -> DataFrame:
    """(id, offset, length, declared, type, corrected, bytes): a row with offset 0 for each value, with null
    bytes, and one for each embedded medium with its bytes; `corrected` says that the type isn't the declared one.

    content may be binary or a string. A null content gives a row with null
    type and length; an empty one is application/octet-stream. A declared type
    is compared without case and parameters; where it is null, nothing is
    corrected. Rows without id and repeated rows are treated like others. Values
    of any length are searched whole. An empty table gives no rows; other
    columns aren't read. No shuffle is made.
    """
    schema = pa.schema([("id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("corrected", pa.bool_()), ("bytes", pa.binary())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        automaton = worker_cache("media", _automaton)
        for batch in batches:
            rows, carved = [], 0
            for i, (key, said) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                data = batch.column(1)[i].as_py()
                if data is None:
                    rows.append((key, 0, None, said, None, False, None))
                    continue
                kind, found = sniff(data, automaton)
                plain = said.split(";")[0].strip().lower() if said is not None else None
                rows.append((key, 0, len(data), said, kind, plain is not None and plain != kind, None))
                for at, n, name, inner in found:
                    rows.append((key, at, n, None, name, False, inner))
                    carved += len(inner)
                if carved >= MOST_CARVED:
                    yield table(rows)
                    rows, carved = [], 0
            if rows:
                yield table(rows)

    rows = values.select(F.col(id_col).cast("long").alias("id"), F.col(content).cast("binary").alias("content"), F.col(declared).cast("string").alias("declared"))
    return rows.mapInArrow(run, "id long, offset long, length long, declared string, type string, corrected boolean, bytes binary")


_EXTENSIONS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "zip": "application/zip", "txt": "text/plain", "svg": "image/svg+xml", "mp3": "audio/mpeg", "mp4": "video/mp4"}


def page_media(pages: DataFrame) -> DataFrame:
    """media() of crawled pages: the declared type is that of the address's extension, or text/html without a known one.

    A null url declares nothing; a null html gives a row with null type and
    length, an empty one is application/octet-stream. Rows without page_id and
    repeated rows are treated like others, pages of any length are searched
    whole, an empty table gives no rows, and other columns aren't read.
    """
    extension = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/[^?#]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    kinds = F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])
    declared = F.when(F.col("url").isNotNull(), F.coalesce(kinds[extension], F.lit("text/html")))
    return media(pages.select("page_id", "html", declared.alias("__declared")), "page_id", "html", "__declared")
