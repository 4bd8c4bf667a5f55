"""Files to documents. One binaryFile scan serves all formats; built-in expressions do what they can.

Every loader gives (id, text, metadata). Files that can't be read as their
format are left out of the documents and listed by failures().
"""

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_extension, strip_html

FORMATS = {
    ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl",
    ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx",
}
_LOADERS: dict = {}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def register_loader(extension: str, read) -> None:
    """read(bytes, path) -> str or None for files of the extension, instead of a built-in loader."""
    _LOADERS["." + extension.lower().lstrip(".")] = read


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """binaryFile rows below root with `extension`; those of the given extensions only. A file that goes between the
    listing and the reading is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    files = files.withColumn("extension", normal_extension(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    if extensions is not None:
        files = files.filter(F.col("extension").isin(["." + e.lower().lstrip(".") for e in extensions]))
    return files


def _lines(text: Column) -> Column:
    """Lines by line feed, with or without carriage return; no empty one after the last line feed."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(body, map) of a Markdown text that starts with three dashes; the next three end the front part."""
    pattern = r"(?s)\A---(.*?)---(.*)\z"
    has = text.rlike(pattern)
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(text, pattern, 1), r"\r?\n"), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(_trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.regexp_replace(_trim(F.substr(x, F.instr(x, ":") + 1)), '^"+|"+$', ""), "^'+|'+$", "").alias("v")),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    body = F.when(has, F.regexp_replace(F.regexp_extract(text, pattern, 2), r"(?U)^\s+", "")).otherwise(text)
    return body, F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def csv_text(text: Column) -> tuple[Column, Column]:
    """(rows as `header: value, ...` lines, number of rows). Fields are cut at every comma; a text of one line stays."""
    lines = _lines(text)
    head = F.transform(F.split(lines[0], ","), _trim)

    def row(line):
        values = F.transform(F.split(line, ","), _trim)
        n = F.least(F.size(head), F.size(values))
        return F.array_join(F.zip_with(F.slice(head, 1, n), F.slice(values, 1, n), lambda h, v: F.concat(h, F.lit(": "), v)), ", ")

    more = F.size(lines) > 1
    return F.when(more, F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), row), "\n")).otherwise(text), F.greatest(F.size(lines) - 1, F.lit(0))


def pretty(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def json_text(s: pd.Series) -> pd.Series:
    """The value with sorted keys and two blanks of indentation; what doesn't parse stays."""
    return s.map(lambda t: None if t is None else pretty(t) if pretty(t) is not None else t)


@F.pandas_udf(T.ArrayType(T.StringType()))
def jsonl_records(s: pd.Series) -> pd.Series:
    def records(text):
        kept = [x for x in (line.strip() for line in re.split(r"\r?\n", text)) if x]
        return [pretty(x) if pretty(x) is not None else x for x in kept]

    return s.map(lambda t: [] if t is None else records(t))


def read_docx(content: bytes, path: str) -> str | None:
    """Paragraphs of the document's body, one to a line; None if there is no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    text = "\n".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p")).strip()
    return text or None


def read_pdf(content: bytes, path: str) -> str | None:
    """The text by pypdf, where that is installed; None without it or without text."""
    try:
        from pypdf import PdfReader
        from pypdf.errors import PyPdfError
    except ImportError:
        return None
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages).strip() or None
    except (PyPdfError, ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError):  # what broken files raise
        return None


def _reader(read):
    @F.pandas_udf("string")
    def run(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else read(bytes(c), p) for c, p in zip(content, path)], dtype=object)

    return run


def load(files: DataFrame) -> DataFrame:
    """Documents (id, text, metadata) of scan()'s files; the id is the SHA-256 of the path.

    Formats go by extension: registered loaders first, then the built-in ones,
    anything else as text. Each format is a branch of its own over the scan, so
    that Python sees only the files that need it.
    """
    own = {e: read for e, read in _LOADERS.items()}
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    files = files.withColumn("format", F.when(F.col("extension").isin(list(own)) if own else F.lit(False), F.col("extension")).otherwise(F.coalesce(known[F.col("extension")], F.lit("text"))))
    raw = F.try_validate_utf8(F.col("content").cast("string"))
    none = F.create_map().cast("map<string,string>")
    body, front = frontmatter(raw)
    rows, count = csv_text(raw)
    records = jsonl_records(raw)
    more = lambda name, n: F.create_map(F.lit(name), n.cast("string"))
    ways = {
        "text": (raw, none), "markdown": (body, front), "csv": (rows, more("rows", count)), "json": (json_text(raw), none),
        "html": (strip_html(raw), none), "docx": (_reader(read_docx)("content", "path"), none), "pdf": (_reader(read_pdf)("content", "path"), none),
        **{e: (_reader(read)("content", "path"), none) for e, read in own.items()},
    }
    parts = [files.filter(F.col("format") == name).select("path", "format", text.alias("text"), extra.alias("extra")) for name, (text, extra) in ways.items()]
    lines = files.filter("format = 'jsonl'").select("path", "format", raw.alias("raw"), records.alias("r")).filter("raw is not null")
    parts.append(lines.select("path", "format", F.array_join("r", "\n---\n").alias("text"), more("records", F.size("r")).alias("extra")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = F.create_map(F.lit("source"), F.col("path"), F.lit("filename"), F.regexp_extract("path", r"([^/]*)$", 1), F.lit("format"), F.col("format"))
    metadata = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("extra"), k)), F.col("extra"))
    return out.filter("text is not null").select(F.sha2("path", 256).alias("id"), "text", metadata.alias("metadata"))


def failures(files: DataFrame) -> DataFrame:
    """(path) of the files that load() leaves out."""
    return files.select("path").join(load(files).select(F.col("metadata")["source"].alias("path")), "path", "left_anti")


def write_jsonl(docs: DataFrame, path: str) -> None:
    """One {"id", "text", "metadata"} object a line."""
    docs.select(F.to_json(F.struct("id", "text", "metadata")).alias("value")).write.mode("overwrite").text(path)


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Documents of lines (value); lines that don't parse, lack a field or have no text are skipped."""
    fields = "id string, text string, metadata map<string,string>, _bad string"
    got = lines.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("d")).select("d.*")
    return got.filter("_bad is null and id is not null and text is not null and text <> '' and metadata is not null").drop("_bad")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsonl(spark.read.text(path))
