"""Splitters: documents to chunks.

Sizes are in UTF-8 bytes unless said otherwise. A text within the limit is one
chunk, unchanged, also when it is empty; a longer one of white space alone
gives none.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, sentences, split_sentences, split_words
from ..functions.vectors import embed_dummy
from ..schema import SplitError


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    """The same for the same content, unlike a random id."""
    return F.sha2(F.concat_ws("\0", doc.cast("string"), index.cast("string"), text), 256)


def byte_windows(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Windows of about `size` bytes; ends and starts move on to the next character's border."""
    data = text.encode()
    if len(data) <= size:
        return [text]
    border = lambda i: i if i >= len(data) or data[i] & 0xC0 != 0x80 else border(i + 1)
    out, at = [], 0
    while at < len(data):
        end = border(min(at + size, len(data)))
        at = border(at)
        if at >= end:
            break
        part = data[at:end].decode()
        if part.strip(SPACE):
            out.append(part)
            if end == len(data):
                break
        at += size - overlap
    return out


def token_chunks(text: str, most: int = 256, overlap: int = 20, per_token: float = 4.0) -> list[str]:
    """Words packed up to `most` tokens, a word of b bytes having ceil(b / per_token)."""
    size: dict[int, int] = {}

    def count(s: str) -> int:
        n = len(s.encode())
        if n not in size:
            size[n] = int(np.ceil(np.float32(n) / np.float32(per_token)))
        return size[n]

    if count(text) <= most:
        return [text]
    out, held, total = [], [], 0
    for word in split_words(text):
        n = count(word)
        if held and total + n > most:
            out.append(" ".join(held))
            keep, left = [], overlap
            for w in reversed(held):
                if count(w) > left:
                    break
                keep.append(w)
                left -= count(w)
            held = keep[::-1]
            total = count(" ".join(held))
        held.append(word)
        total += n
    return out + [" ".join(held)] if held else out


def sentence_chunks(text: str, size: int = 1000, overlap: int = 1) -> list[str]:
    """Sentences packed up to `size` bytes; the last `overlap` ones begin the next chunk."""
    if len(text.encode()) <= size:
        return [text]
    out, held, total = [], [], 0
    for s in split_sentences(text):
        n = len(s.encode())
        if held and total + n > size:
            out.append(" ".join(held))
            held = held[len(held) - min(overlap, len(held)) :]
            total = sum(len(x.encode()) for x in held)
        held.append(s)
        total += n
    return out + [" ".join(held)] if held else out


def semantic_chunks(text: str, embed, threshold: float = 0.5, most: int = 2000) -> list[str]:
    """Sentences joined while neighbours are similar and the chunk stays within `most` bytes; none for no sentence."""
    parts = split_sentences(text, abbreviations=False)
    if len(parts) <= 1:
        return [text] if parts else []
    v = np.asarray(embed(parts), dtype=np.float64)
    norm = np.linalg.norm(v, axis=1)
    scale = norm[1:] * norm[:-1]
    near = np.divide((v[1:] * v[:-1]).sum(axis=1), scale, out=np.zeros(len(scale)), where=scale > 0)
    out, held, total = [], [parts[0]], len(parts[0].encode())
    for s, sim in zip(parts[1:], near):
        n = len(s.encode()) + 1
        if sim < threshold or total + n > most:
            out.append(" ".join(held))
            held, total = [], 0
        held.append(s)
        total += n
    return [*out, " ".join(held)]


def split_with(docs: DataFrame, splitter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns with chunk_index, source_id, chunk_id and the chunk's text; splitter maps a string to strings."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else splitter(t))

    rest = [c for c in docs.columns if c not in (text_col, "chunk_index", "source_id", "chunk_id")]
    rows = docs.select(*rest, F.posexplode(run(text_col)).alias("chunk_index", text_col)).withColumn("source_id", F.col(id_col))
    return rows.withColumn("chunk_id", chunk_id(F.col(id_col), F.col("chunk_index"), F.col(text_col)))


def split_bytes(docs, size=512, overlap=50):
    if not 0 <= overlap < size:
        raise SplitError("overlap must be less than size")
    return split_with(docs, lambda t: byte_windows(t, size, overlap))


def split_tokens(docs, most=256, overlap=20, per_token=4.0):
    if not 0 <= overlap < most:
        raise SplitError("overlap must be less than the most tokens")
    return split_with(docs, lambda t: token_chunks(t, most, overlap, per_token))


def split_sentence_groups(docs, size=1000, overlap=1):
    return split_with(docs, lambda t: sentence_chunks(t, size, overlap))


def split_semantic(docs, embed=None, threshold=0.5, most=2000):
    embed = embed or (lambda texts: embed_dummy(texts, 64))
    return split_with(docs, lambda t: semantic_chunks(t, embed, threshold, most))


def split_chars(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters in built-in expressions alone; columns doc_id, chunk_index, text."""
    if not 0 <= overlap < size:
        raise SplitError("overlap must be less than size")
    step = size - overlap
    n = F.length("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(step)))).cast("int")
    rows = docs.filter("text is not null").select("doc_id", n.alias("n"), "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    rows = rows.select("doc_id", "n", "i", F.substring(F.col("text"), F.col("i") * step + 1, F.lit(size)).alias("text"))
    rows = rows.filter((F.col("n") <= size) | F.col("text").rlike(r"(?U)\S"))
    order = Window.partitionBy("doc_id").orderBy("i")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text")


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)"""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
