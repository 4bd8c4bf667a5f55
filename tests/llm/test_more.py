import base64
import bz2
import gzip
import io
import lzma
import random
import struct
import wave
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward, prose, row, rows, table
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from corbel.llm import media, mixing, packing, queries, toxicity
from corbel.llm import textkernel as K

SMALL = "/root/testdata/sf0.001"

# Media


def png(n=3):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((n + 1) * n))) + chunk(b"IEND", b"")


def samples():
    w, z = io.BytesIO(), io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(bytes(64))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello" * 20)
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x05abc\xff\xda\0\x04ab\x12\xff\x00\x34\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n9\n%%EOF\n"
    chunk = lambda k, d: k + struct.pack("<I", len(d)) + d + bytes(len(d) % 2)
    container = lambda kind, *parts: b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + kind + b"".join(parts)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 273, 4, 1, 38) + struct.pack("<HHII", 279, 4, 1, 6) + struct.pack("<I", 0) + b"pixels"
    icon = struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 3, 3, 0, 0, 1, 32, len(png()), 22) + png()
    flac = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes(34) + b"\xff\xf8" + bytes(20)
    page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<III", 7, 0, 0) + bytes([1, len(body)]) + body
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    mp3 = b"ID3\x03\0\0\0\0\0\x05" + bytes(5) + frame * 2
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    mp4 = box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", bytes(12)) + box(b"mdat", bytes(9))
    head = b"\x42\x82\x84webm"
    webm = b"\x1aE\xdf\xa3" + bytes([0x80 | len(head)]) + head + b"\x18\x53\x80\x67" + bytes([0x80 | 5]) + b"hello"
    more = {
        "image/webp": container(b"WEBP", chunk(b"VP8 ", b"1234567")), "video/x-msvideo": container(b"AVI ", chunk(b"LIST", b"12345678")), "image/tiff": tiff, "image/x-icon": icon, "application/x-bzip2": bz2.compress(b"x" * 99),
        "application/x-xz": lzma.compress(b"x" * 99), "audio/flac": flac, "audio/ogg": page(2, b"\x01vorbis") + page(4, b"end"), "audio/mpeg": mp3, "video/mp4": mp4, "video/webm": webm, "image/svg+xml": b"<svg xmlns='x'><path d='M0'/></svg>",
    }
    return more | {"image/png": png(), "audio/wav": w.getvalue(), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf}


@pytest.mark.parametrize("kind", samples())
def test_whole_and_carved(kind):
    a, data = media._automaton(), samples()[kind]
    assert media.sniff(data, a) == (kind, [])
    lead = b"\x01junk" * 3
    if kind == "audio/flac":  # its frames have no total length
        assert media.sniff(lead + data, a)[1] == [(len(lead), len(data), kind, data)]
    elif kind not in ("application/pdf",):
        assert media.sniff(lead + data + b"tail", a)[1] == [(len(lead), len(data), kind, data)]
    assert media.sniff(data[: len(data) // 2], a)[0] != kind


def every_signature(content):
    """(start, length, type) of the valid signatures at all places of the content, one place after the other."""
    out = []
    for at in range(len(content)):
        for magic, name, check, back in media.SIGNATURES:
            if at >= back and content[at : at + len(magic)] == magic and (got := check(content, at)) is not None:
                size, kind = got if isinstance(got, tuple) else (got, name)
                out.append((at - back, size, kind))
    return out


def test_carving_equals_a_scan_of_every_place():
    r, a = random.Random(6), media._automaton()
    kinds = sorted(set(samples()) - {"application/pdf", "audio/flac", "application/zip"})
    for _ in range(60):
        chosen, content, want = r.sample(kinds, 3), b"\x01", []
        for kind in chosen:
            content += bytes(r.choices(range(97, 123), k=r.randrange(40)))
            want.append((len(content), len(samples()[kind]), kind, samples()[kind]))
            content += samples()[kind]
        content += b" tail"
        whole = every_signature(content)
        outer = [x for x in whole if not any(y[0] <= x[0] and x[0] + x[1] <= y[0] + y[1] and x != y for y in whole)]
        got = media.sniff(content, a)[1]
        assert got == want and [x[:3] for x in got] == sorted(outer)


@pytest.mark.parametrize("kind", sorted(samples()))
def test_truncated_media_are_not_taken_whole(kind):
    if kind in ("audio/mpeg", "audio/flac", "application/pdf"):  # fewer frames are a whole file too
        return
    data = samples()[kind]
    for n in range(len(data) // 3, len(data) - 1):
        got = media.leading(data[:n])
        assert got is None or got[0] != kind or got[1] <= n


@pytest.mark.parametrize("rest", ["", " alt=cat", "\nabcd", " abc defgh", " width=", "\nplain words", ">", "'"])
@pytest.mark.parametrize("form", ["plain", "quoted", "unpadded", "folded"])
def test_data_uris_are_carved_exactly(rest, form):
    coded = base64.b64encode(png()).decode()
    coded = coded.rstrip("=") if form == "unpadded" else "\n ".join(coded[i : i + 20] for i in range(0, len(coded), 20)) if form == "folded" else coded
    mark = '"' if form in ("quoted", "folded") else ""
    content = f"<html><img src={mark}data:image/png;base64,{coded}{mark}{rest}".encode()
    got = media.sniff(content, media._automaton())[1]
    assert [(x[2], x[3]) for x in got] == [("image/png", png())]
    assert content[got[0][0] : got[0][0] + got[0][1]].decode() == f"data:image/png;base64,{coded}"


def test_media_awkward(spark):
    long = "<html>" + "x" * 3_000_000 + f'<img src="data:image/png;base64,{base64.b64encode(png()).decode()}"></html>'
    pages = spark.createDataFrame([(1, None, "<html></html>", "a", "b", "c"), (2, "http://a.b/c.png", None, None, None, None), (3, "http://a.b/c.png?x", long, "a", "b", "c"), (None, None, "", "a", "b", "c")], "page_id long, url string, html string, declared string, bytes string, __declared string")
    got = rows(media.page_media(pages))
    assert (1, 0, 13, None, "text/html", False, None) in got and (2, 0, None, "image/png", None, False, None) in got
    assert (3, 0, len(long), "image/png", "text/html", True, None) in got and (None, 0, 0, None, "application/octet-stream", False, None) in got
    assert [bytes(r[6]) for r in got if r[6] is not None] == [png()] and media.page_media(pages.limit(0)).count() == 0


def test_media_rows(spark):
    uri = f'<html><img src="data:image/gif;base64,{base64.b64encode(png()).decode()}"></html>'
    values = [(1, bytearray(png()), "image/jpeg; q=1"), (2, None, "text/html"), (3, bytearray(b""), None), (4, bytearray(uri.encode()), "text/html"), (None, bytearray(b"plain"), "TEXT/PLAIN"), (1, bytearray(png()), "image/jpeg; q=1")]
    got = rows(media.media(spark.createDataFrame(values, "key long, body binary, said string"), "key", "body", "said"))
    assert got.count((1, 0, len(png()), "image/jpeg; q=1", "image/png", True, None)) == 2
    assert (2, 0, None, "text/html", None, False, None) in got and (3, 0, 0, None, "application/octet-stream", False, None) in got
    assert (4, 0, len(uri), "text/html", "text/html", False, None) in got and (None, 0, 5, "TEXT/PLAIN", "text/plain", False, None) in got
    carved = [r for r in got if r[6] is not None]
    assert len(carved) == 1 and carved[0][4] == "image/png" and bytes(carved[0][6]) == png()
    assert media.media(spark.createDataFrame([], "key long, body binary, said string"), "key", "body", "said").count() == 0


# Mixing


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    docs = table(spark, awkward() + [row(100 + i, prose(20 + i, i), source=f"s{i % 3}") for i in range(60)])
    con.register("documents", docs.select("doc_id", "text", "source", "n_chars").toArrow())
    want = con.execute(f"SELECT doc_id, source, epoch, tokens, position FROM ({mixing.SQL})").fetchall()
    got = rows(mixing.mix(docs))
    assert sorted(got) == sorted(want) and [r[4] for r in got] == sorted(r[4] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shares_follow_the_schedule(spark):
    docs = [row(i, "x" * 400, source="large" if i < 3000 else "small") for i in range(3600)]
    got = rows(mixing.mix(table(spark, docs)))
    assert {r[0] for r in got if r[2] == 0} == set(range(3600))
    for low in (0.0, 0.45, 0.9):
        part = [r for r in got if low <= r[4] < low + 0.1]
        t = low + 0.05
        a0, a1, left = (1.0, 0.75, t / 0.5) if t < 0.5 else (0.75, 0.5, (t - 0.5) / 0.5)
        w = lambda a: 60_000**a / (60_000**a + 300_000**a)
        want = w(a0) * (1 - left) + w(a1) * left
        assert abs(sum(r[1] == "small" for r in part) / len(part) - want) < 0.02


def test_curriculum_keeps_rows(spark):
    docs = table(spark, awkward())
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and set(map(repr, rows(out))) == set(map(repr, rows(docs)))
    assert [r.doc_id for r in out.collect()][-2:] == [None, None] and mixing.curriculum(docs.limit(0)).count() == 0


def test_curriculum_repeats_sources_up_to_their_weight(spark):
    docs = [row(i, "x" * 400, source="large" if i < 300 else "small") for i in range(330)]
    got = [r.doc_id for r in mixing.curriculum(table(spark, docs)).collect()]
    want = [r[0] for r in rows(mixing.mix(table(spark, docs)))]
    assert got == want and len(got) > 345 and {i for i in got if got.count(i) > 1} <= set(range(300, 330))


# Packing


def pack_docs():
    r, out = random.Random(8), []
    for g in range(25):
        base = prose(120, 300 + g).split()
        for _ in range(1 + g % 5):
            w = list(base)
            a = r.randrange(100)
            w[a : a + r.randrange(20)] = r.choices(WORDS, k=r.randrange(20))
            out.append(" ".join(w))
    return out


def nodes_of(spark, texts):
    h, at, *_ = K.words(pa.array(texts))
    s, codes = packing.sketches(*K.shingles(h, at, packing.SHINGLE))
    rows = [(i, bytearray(x.tobytes()), bytearray(y.tobytes())) for i, (x, y) in enumerate(zip(s, packing.packed(codes)))]
    return s, codes, spark.createDataFrame(rows, "node long, slots binary, signature binary")


def test_neighbours_equal_brute_force(spark):
    texts = pack_docs()
    s, codes, nodes = nodes_of(spark, texts)
    want = set()
    for i in range(len(texts)):
        like = packing.alike(np.broadcast_to(codes[i], codes.shape), codes)
        meet = ((s[i] == s) & (s[i] != packing.NONE)).any(axis=1)
        near = sorted((j for j in range(len(texts)) if j != i and meet[j] and like[j] >= packing.LEAST * packing.SCALE), key=lambda j: (-like[j], j))
        want |= {(i, j, int(like[j])) for j in near[: packing.NEIGHBOURS]}
    assert set(rows(packing.neighbours(nodes))) == want and len(want) > 50


def test_codes_are_packed_and_compared(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 64, (40, packing.BINS)).astype(np.uint8)
    codes[20:] = np.where(rng.random((20, packing.BINS)) < 0.3, codes[20:], codes[:20])
    assert (packing.unpacked(packing.packed(codes)) == codes).all()
    got = packing.all_alike(codes)
    for i in range(40):
        assert got[i].tolist() == packing.alike(np.broadcast_to(codes[i], codes.shape), codes).tolist()
    nearest = {}
    for a, b, n in packing.nearest_in_buckets(np.zeros(40, dtype=np.int64), np.arange(40), codes, 3):
        for x, y, z in zip(a.tolist(), b.tolist(), n.tolist()):
            nearest.setdefault(x, {})[y] = z
    for i in range(40):
        want = sorted((j for j in range(40) if j != i), key=lambda j: (-got[i, j], j))[:3]
        assert sorted(nearest[i], key=lambda j: (-nearest[i][j], j))[:3] == want


def test_no_bucket_is_larger_than_the_limit(spark):
    """A shingle that all documents share: its bucket is divided, and copies are still found."""
    r, texts = random.Random(1), []
    for g in range(60):
        body = prose(40, 9000 + g).split()
        for _ in range(2):
            body[r.randrange(40)] = r.choice(WORDS)
            texts.append("all rights reserved by " + " ".join(body))
    s, codes, nodes = nodes_of(spark, texts)
    done, hubs = packing.buckets(nodes, 8)
    held = {}
    for k, n in rows(done):
        held.setdefault(k, []).append(n)
    assert max(map(len, held.values())) <= 8 and hubs is not None and hubs.count() > 60
    near = {}
    for a, b, like in rows(packing.neighbours(nodes, 4, 8)):
        near.setdefault(a, set()).add(b)
    assert np.mean([i ^ 1 in near.get(i, ()) for i in range(len(texts))]) > 0.95


def test_large_buckets_are_compared_in_full(spark):
    """Documents that share one frequent shingle and nothing else that is frequent: no limit drops a partner, at any size of the blocks."""
    texts = ["all rights reserved " + prose(8 + i % 9, 7000 + i) for i in range(150)]
    s, codes, nodes = nodes_of(spark, texts)
    want = set()
    for i in range(len(texts)):
        like = packing.alike(np.broadcast_to(codes[i], codes.shape), codes)
        meet = ((s[i] == s) & (s[i] != packing.NONE)).any(axis=1)
        near = sorted((j for j in range(len(texts)) if j != i and meet[j] and like[j] >= packing.LEAST * packing.SCALE), key=lambda j: (-like[j], j))
        want |= {(i, j, int(like[j])) for j in near[: packing.NEIGHBOURS]}
    assert len(want) > 100
    assert set(rows(packing.neighbours(nodes, full=8))) == want
    assert set(rows(packing.neighbours(nodes, full=8, block=20))) == want


def linked_nodes(spark, n=20_000):
    """(group of each node, nodes): nodes 0 to 39 and each four after them share one slot's value and most of their signature."""
    rng, group = np.random.default_rng(5), np.maximum(np.arange(n) // 4, 9)
    s = rng.permutation(n * packing.SLOTS).reshape(n, packing.SLOTS).astype(np.uint64) | np.arange(packing.SLOTS, dtype=np.uint64) << np.uint64(60)
    s[:, 3] = s[group, 3]
    codes = rng.integers(1, 64, (n, packing.BINS)).astype(np.uint8)[group]
    codes[:, ::4] = rng.integers(1, 64, (n, packing.BINS // 4))
    at = rng.permutation(n)
    held = [(int(i), bytearray(s[i].tobytes()), bytearray(x.tobytes())) for i, x in zip(at, packing.packed(codes[at]))]
    return group, packing.checkpoint(spark.createDataFrame(held, "node long, slots binary, signature binary"))


def test_no_bucket_is_split_between_tasks(spark):
    """Of a size at which joins by a bucket's key become broadcast joins: all nodes of a bucket still meet."""
    group, nodes = linked_nodes(spark)
    got = {(a, b) for a, b, _ in rows(packing.neighbours(nodes)) if a >= 40}
    assert got == {(a, b) for a in range(40, len(group)) for b in range(a // 4 * 4, a // 4 * 4 + 4) if a != b}


def test_packing_stage_follows_all_links(spark):
    """The pipeline's last stage on more documents with one frequent shingle than a bucket has: its paths are those of brute force."""
    docs = table(spark, [row(i, "all rights reserved " + prose(8 + i % 9, 7000 + i)) for i in range(packing.FULL + 90)])
    held = sorted(packing.sketch_table(docs).collect(), key=lambda r: r.node)
    node = [r.node for r in held]
    s, codes = (np.stack([np.frombuffer(r[c], dtype=kind) for r in held]) for c, kind in (("slots", np.uint64), ("signature", np.uint8)))
    codes, edges = packing.unpacked(codes), set()
    for i in range(len(held)):
        like = packing.alike(np.broadcast_to(codes[i], codes.shape), codes)
        meet = ((s[i] == s) & (s[i] != packing.NONE)).any(axis=1)
        near = sorted((j for j in range(len(held)) if j != i and meet[j] and like[j] >= packing.LEAST * packing.SCALE), key=lambda j: (-like[j], j))
        edges |= {(node[min(i, j)], node[max(i, j)], int(like[j])) for j in near[: packing.NEIGHBOURS]}
    ties = spark.createDataFrame(sorted(edges), "a long, b long, like int").withColumn("tie", F.xxhash64("a", "b"))
    windows = corpus_pipeline.packing(spark, docs, None).collect()
    got = list(dict.fromkeys(p.doc_id for w in sorted(windows, key=lambda w: w.window_id) for p in w.segments))
    doc, at = {r.node: r.id for r in held}, {d: i for i, d in enumerate(got)}
    paths = packing.chains(sorted({n for e in edges for n in e[:2]}), rows(ties))
    for path in paths:
        places = [at[doc[n]] for n in path]
        assert places == list(range(places[0], places[0] + len(path)))
    assert len(got) == len(held) and max(map(len, paths)) > 5


def test_recall_against_true_similarity(spark):
    """Of each document's true four nearest by Jaccard similarity of at least 0.1, at least 0.9 are found, ties counted."""
    docs = {r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()}
    texts = sorted(t for t in docs if t and t.strip())
    h, at, *_ = K.words(pa.array(texts))
    sh, cut = K.shingles(h, at, packing.SHINGLE)
    sets = [set(sh[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:])]
    where, got = {}, {}
    for i, x in enumerate(sets):
        for v in x:
            where.setdefault(v, []).append(i)
    _, _, nodes = nodes_of(spark, texts)
    for a, b, _ in rows(packing.neighbours(nodes)):
        got.setdefault(a, []).append(b)
    hit = total = 0
    for i, x in enumerate(sets):
        shared = {}
        for v in x:
            for j in where[v]:
                shared[j] = shared.get(j, 0) + 1
        true = {j: n / (len(x) + len(sets[j]) - n) for j, n in shared.items() if j != i}
        best = [v for v in sorted(true.values(), reverse=True)[:4] if v >= 0.1]
        found = sorted((true.get(j, 0) for j in got.get(i, [])), reverse=True)[: len(best)]
        total += len(best)
        hit += sum(v >= best[-1] - 1e-12 for v in found) if best else 0
    assert total > 100 and hit / total >= 0.9, (hit, total)


def test_walk():
    assert packing.walk([1, 2, 3, 4, 9], [(1, 2, 5), (2, 3, 9), (3, 4, 1), (2, 4, 2)]) == [9, 1, 2, 3, 4]


def covered(windows, docs, window):
    at, out = {}, sorted(windows, key=lambda r: r.window_id)
    for w in out[:-1]:
        assert w.n_tokens == window
    for w in out:
        assert w.n_tokens == sum(s.tokens for s in w.segments)
        for s in w.segments:
            at.setdefault(s.doc_id, []).append((s.start, s.tokens))
    for i, text in docs.items():
        n, pos = int(np.diff(K.words(pa.array([text or ""]))[1])[0]), 0
        for start, k in sorted(at.get(i, [])):
            assert start == pos
            pos += k
        assert pos == n


def test_every_word_is_packed_once(spark):
    docs = dict(enumerate([*pack_docs(), "", None, prose(5000, 1)]))
    windows = packing.pack(table(spark, [row(i, t) for i, t in docs.items()]), 256).collect()
    covered(windows, docs, 256)
    order = [s.doc_id for w in sorted(windows, key=lambda r: r.window_id) for s in w.segments]
    place = {d: i for i, d in reversed(list(enumerate(order)))}
    assert np.mean([abs(place[i] - place[i + 1]) <= 8 for i in (10, 11, 12, 13)]) >= 0.5  # copies of one base


def test_parts_are_cut_beyond_the_limit(spark):
    docs = dict(enumerate(pack_docs()))
    covered(packing.pack(table(spark, [row(i, t) for i, t in docs.items()]), 256, most=2).collect(), docs, 256)


def test_paths_are_the_same_at_every_limit(spark):
    r = random.Random(4)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(150), r.randrange(150)) for _ in range(400)) if a != b})
    edges = [(a, b, r.randrange(2, 5), r.randrange(50)) for a, b in edges]
    want = [(n, p[0], i) for p in packing.chains(sorted({n for e in edges for n in e[:2]}), edges) for i, n in enumerate(p)]
    got = rows(packing.joined(spark.createDataFrame(edges, "a long, b long, like int, tie long")))
    assert sorted((n, p.node, i) for n, p, i in got) == sorted(want) and max(i for *_, i in want) > 5
    docs = table(spark, [row(i, t) for i, t in enumerate(pack_docs())])
    assert sorted(rows(packing.pack(docs, 256, most=2))) == sorted(rows(packing.pack(docs, 256)))


def test_packing_awkward(spark):
    docs = table(spark, awkward())
    got = packing.pack(docs).collect()
    total = sum(r.n_tokens for r in got)
    assert total == 80 + 60_000 * 2 + 90 + 70 * 2 + 1 + 1 + 60 + 4 and packing.pack(docs.limit(0)).count() == 0


# Toxicity


def toxic_docs(n=900):
    bad, r, out = ["vrxq", "zlokmun", "quarg"], random.Random(3), []
    for i in range(n):
        w, toxic = r.choices(WORDS, k=r.randrange(20, 200)), i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((row(i, " ".join(w), "en" if i % 3 else "de"), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    docs = toxic_docs()
    frame = table(spark, [d for d, _ in docs])
    labels = spark.createDataFrame([(i, None, t) for i, (_, t) in enumerate(docs) if i < 600] + [(None, 1, 1), (5, 1, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in toxicity.toxic_documents(frame, labels).collect()}
    want = {i for i, (_, t) in enumerate(docs) if t}
    held = set(range(600, 900))
    assert len(got & want & held) >= 0.9 * len(want & held) and len(got & held - want) <= 0.02 * len(held)
    kept = toxicity.drop_toxic(frame, labels)
    assert kept.schema == frame.schema and {r.doc_id for r in kept.collect()} == set(range(900)) - got


def test_maxima_equal_brute_force():
    m = toxicity.Model(3)
    texts = [prose(n, n) for n in (1, 2, 3, 40)] + [""]
    x, at = toxicity.features(pa.array(texts))
    got = m.maxima(x, at)
    top, _ = m._best(x, np.ones(len(x), dtype=np.float32), np.repeat(np.arange(5), np.diff(at)), 5)
    for i in range(5):
        v = m.embed[x[at[i] : at[i + 1]]].sum(axis=1)
        for k, w in enumerate(toxicity.WIDTHS):
            want = [sum(v[s + j] @ m.conv[k][j] for j in range(w)) for s in range(len(v) - w + 1)]
            cols = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
            want = np.max(want, axis=0) if want else np.full(toxicity.FILTERS, -np.inf)
            assert np.allclose(got[i, cols], want, atol=1e-4) and np.allclose(top[i, cols], want + m.bias[k], atol=1e-4)


def test_all_labelled_documents_are_learnt_from(spark):
    """Toxic documents past the first 700 by the hash of ids have a word of their own, which has to be known."""
    ids = spark.range(2400).select("id", F.rank().over(Window.partitionBy(F.col("id") % 2).orderBy(F.xxhash64("id"))).alias("r"))
    late = {r.id for r in ids.collect() if r.r > 700}
    docs = [row(i, prose(20, i) + (" vrxq" if i in late else " quarg") * (i % 2)) for i in range(2400)]
    docs += [row(i, prose(20, i) + " vrxq" * (i % 2)) for i in range(2400, 2500)]
    frame, labels = table(spark, docs), spark.createDataFrame([(i, None, i % 2) for i in range(2400)], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(frame, labels).collect()
    new = {r.doc_id for r in got if r.doc_id >= 2400}
    assert new == set(range(2401, 2500, 2))


def test_shards_are_averaged(spark):
    """The model is the same for the same rows in any order, and as good by several shards."""
    docs = toxic_docs()
    frame = table(spark, [d for d, _ in docs])
    labels = spark.createDataFrame([(i, None, t) for i, (_, t) in enumerate(docs)], "doc_id long, quality int, toxic int")
    a, b = toxicity.train(frame, labels, 150), toxicity.train(frame.repartition(3, "text"), labels, 150)
    assert (a.embed == b.embed).all() and a.thresholds == b.thresholds and a.out_bias == b.out_bias
    got = {r.doc_id for r in toxicity.score(frame, a).filter("toxic").collect()}
    want = {i for i, (_, t) in enumerate(docs) if t}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(docs)
    start = {"embed": np.zeros((3, 2), dtype=np.float32), "out": np.zeros(2, dtype=np.float32)}
    one, two = ({k: v.copy() for k, v in start.items()} for _ in range(2))
    one["embed"][0], two["embed"][0], two["embed"][1], one["out"][:], two["out"][0] = 1, 3, 5, 4, 2
    mean = toxicity.averaged(start, [toxicity.changed(start, x) for x in (one, two)])
    assert mean["embed"].tolist() == [[2, 2], [5, 5], [0, 0]] and mean["out"].tolist() == [3, 4]
    x, _ = toxicity.features(pa.array([prose(300, 1), "été ÉTÉ  漢字 🚀"]))
    assert (toxicity.unpacked(toxicity.packed(x).tobytes()) == x).all()
    assert rows(toxicity.labelled(frame, labels, 5).orderBy("id")) == rows(toxicity.labelled(frame, labels).orderBy("id"))


def test_gradients():
    rng = np.random.default_rng(0)
    docs = [(np.frombuffer(toxicity.features(pa.array([prose(9, i)]))[0].tobytes(), dtype=np.int32).reshape(-1, 3), i % 2) for i in range(4)]

    def loss(m):
        z = np.array([np.maximum(m.maxima(d, np.array([0, len(d)]))[0] + np.concatenate(m.bias), 0) @ m.out + m.out_bias for d, _ in docs])
        y = np.array([v for _, v in docs])
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    m = toxicity.Model(5)
    before, sums = loss(m), {k: np.full(v.shape, 1e-3, dtype=np.float32) for k, v in m._weights()}
    for _ in range(20):
        m._step(docs, sums, rng)
    assert loss(m) < before / 2


class Ones:
    """Keeps every word."""

    def random(self, n):
        return np.ones(n)


def test_gradients_equal_differences():
    docs = [(np.frombuffer(toxicity.features(pa.array([prose(12, 40 + i)]))[0].tobytes(), dtype=np.int32).reshape(-1, 3), i % 2) for i in range(5)]

    def loss(m):
        z = np.array([np.maximum(m.maxima(d, np.array([0, len(d)]))[0] + np.concatenate(m.bias), 0) @ m.out + m.out_bias for d, _ in docs], dtype=np.float64)
        y = np.array([v for _, v in docs])
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    m = toxicity.Model(5)
    sums = {k: np.full(v.shape, 1e-20) for k, v in m._weights()}
    m._step(docs, sums, Ones())
    for name in ("out", "conv0", "conv1", "conv2", "bias1", "embed"):
        want = np.sqrt(sums[name])
        for at in np.argsort(-want.ravel())[:5]:
            at, sides = np.unravel_index(at, want.shape), []
            for step in (1e-3, -1e-3):
                other = toxicity.Model(5)
                dict(other._weights())[name][at] += np.float32(step)
                sides.append(loss(other))
            assert abs(sides[0] - sides[1]) / 2e-3 == pytest.approx(float(want[at]), rel=0.05, abs=2e-4), name


def test_scores_equal_brute_force(spark):
    m, texts = toxicity.Model(2), [prose(n, 60 + n) for n in (1, 2, 5, 90)] + ["", None]
    m.trained, m.thresholds, m.default = True, {"de": 0.2}, 0.4
    got = {r.doc_id: r for r in toxicity.score(table(spark, [row(i, t, "de" if i % 2 else "en") for i, t in enumerate(texts)]), m).collect()}
    for i, t in enumerate(texts):
        v = m.embed[toxicity.features(pa.array([t or ""]))[0]].sum(axis=1)
        h = []
        for w, conv, bias in zip(toxicity.WIDTHS, m.conv, m.bias):
            places = [sum(v[s + j] @ conv[j] for j in range(w)) for s in range(len(v) - w + 1)]
            h.append(np.maximum(np.max(places, axis=0) + bias, 0) if places else np.zeros(toxicity.FILTERS))
        want = 1 / (1 + np.exp(-(np.concatenate(h) @ m.out + m.out_bias))) if len(v) else 0.0
        cut = 0.2 if i % 2 else 0.4
        assert got[i].score == pytest.approx(float(want), abs=1e-5) and got[i].threshold == cut and got[i].toxic == bool(len(v) and want >= cut)


def test_thresholds_equal_brute_force():
    r = np.random.default_rng(8)
    for _ in range(50):
        y = (r.random(30) < 0.4).astype(int)
        score = np.round(np.clip(0.3 * y + r.random(30) * 0.7, 0, 1), 1)  # with ties
        t = toxicity.best_threshold(score, y, 0.5)
        f1 = lambda c: 2 * y[score >= c].sum() / max((score >= c).sum() + y.sum(), 1)
        assert f1(t) == pytest.approx(max(f1(c) for c in np.linspace(0, 1, 201)))
    assert toxicity.best_threshold(np.array([0.2, 0.2, 0.8, 0.8]), np.array([0, 0, 1, 1]), 0.1) == pytest.approx(0.5)
    assert toxicity.best_threshold(np.array([0.2, 0.8]), np.array([1, 1]), 0.1) == 0.1


def test_toxicity_awkward(spark):
    docs, none = table(spark, awkward()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (None, None, None), (2, 0, 1), (3, 1, 0)], none.schema)
    for labels in (none, one):
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and {2, 3, 4, 10} <= {r.doc_id for r in kept.collect()}
        assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), one).count() == 0


# Pipeline


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        yield name, docs, out
        docs = out


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, before, after in stages(spark, docs, SMALL):
        if name != "packing":
            assert after.schema.names == docs.schema.names
            after.write.parquet(str(tmp_path / name))
        if name in ("toxicity", "near_duplicates"):
            assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0
        if name == "pii":
            assert after.count() == before.count()
        if name == "mixing":
            assert after.count() > before.count() and sorted(map(repr, after.distinct().collect())) == sorted(map(repr, before.collect()))
    held = before.collect()
    n = np.diff(K.words(pa.array([r.text or "" for r in held]))[1])
    packed, want = {}, {}
    for r, k in zip(held, n.tolist()):
        want[r.doc_id] = want.get(r.doc_id, 0) + k
    for w in after.collect():
        assert w.n_tokens == sum(s.tokens for s in w.segments) <= packing.WINDOW
        for s in w.segments:
            packed[s.doc_id] = packed.get(s.doc_id, 0) + s.tokens
    assert packed == {i: k for i, k in want.items() if k}


def test_windows_follow_the_schedule(spark, tmp_path, monkeypatch):
    docs = [row(i, prose(60, 5000 + i), source="large" if i % 4 else "small") for i in range(400)]
    table(spark, docs).drop("__drop").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def early():
        windows = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.window_id)
        third = len(windows) // 3
        parts = [[s.doc_id % 4 == 0 for w in part for s in w.segments] for part in (windows[:third], windows[-third:])]
        return [sum(x) / len(x) for x in parts]  # the small source's share at first and at last

    got = {}
    for last in (0.0, 2.0):  # the small source's share rises or falls in the course of the run
        monkeypatch.setattr(corpus_pipeline, "curriculum", lambda d: mixing.curriculum(d, ((0.0, 1.0), (1.0, last))))
        got[last] = early()
    assert got[0.0][0] < got[0.0][1] - 0.05 and got[2.0][0] > got[2.0][1] + 0.02


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_awkward(spark, tmp_path, empty):
    docs = table(spark, awkward()).drop("__drop")
    (docs.limit(0) if empty else docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() == 0) == empty


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
