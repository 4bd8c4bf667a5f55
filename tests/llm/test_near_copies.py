import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward, prose, row, rows, table

from corbel.llm import graphs, minhash, simhash
from corbel.llm import textkernel as K


def fp_of(texts):
    h, at, *_ = K.words(pa.array(texts))
    return simhash.fingerprints(h, at)


def brute_groups(ids, fp, most):
    near = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2) <= most
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for x, y in zip(*np.nonzero(near)):
            low = min(label[ids[x]], label[ids[y]])
            for i in (ids[x], ids[y]):
                if label[i] != low:
                    label[i], changed = low, True
    return {(i, c) for i, c in label.items() if i != c}


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def corpus():
    out = []
    for g in range(40):
        base = prose(150, 100 + g)
        out += [base] + [edited(base, 0.03, 1000 * g + i) for i in range(g % 4)]
    out += [prose(3, 900), prose(3, 900)] + [edited(prose(200, 901), 0.02, i) for i in range(80)]
    return out


def test_fingerprint_bits_are_majorities():
    text = "b a c b a"
    h, at, *_ = K.words(pa.array([text]))
    own = np.unique(h)
    for lane in range(simhash.LANES):
        x = K.mix(own ^ simhash.SEEDS[lane])
        want = sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(own))
        assert int(simhash.fingerprints(h, at)[0, lane]) == want


def test_long_text_equals_bit_count():
    h, at, *_ = K.words(pa.array([prose(2500, 9)]))
    own, x = np.unique(h), simhash.fingerprints(h, at)[0]
    votes = [(K.mix(own ^ simhash.SEEDS[0]) >> np.uint64(b) & np.uint64(1)).sum() for b in range(64)]
    assert [int(x[0]) >> b & 1 for b in range(64)] == [int(2 * v > len(own)) for v in votes]


def test_pivot_table_never_discards_a_near_pair():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, (300, simhash.LANES)).astype(np.uint64)
    for i in range(150, 300):
        fp[i] = fp[i - 150]
        for b in rng.integers(0, 256, 30):
            fp[i, b // 64] ^= np.uint64(1 << int(b % 64))
    a, b = np.triu_indices(300, 1)
    got = set(zip(*(x.tolist() for x in simhash.near(fp, simhash.pivot_table(fp), a, b, 40))))
    d = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1)
    assert got == {(x, y) for x, y, z in zip(a.tolist(), b.tolist(), d) if z <= 40} and len(got) >= 150


def test_groups_equal_brute_force(spark):
    texts = corpus()
    docs = table(spark, [row(10 + i, t) for i, t in enumerate(texts)])
    want = brute_groups([10 + i for i in range(len(texts))], fp_of(texts), simhash.MAX_BITS)
    got = set(rows(simhash.near_duplicates(docs)))
    assert len(got & want) >= 0.95 * len(want) and not {x for x, _ in got} - {x for x, _ in want}
    assert len(want) > 120


@pytest.mark.parametrize("n", [1000, 10**5, 10**8])
def test_recall_at_the_limit_at_every_size(n):
    """Pairs that differ in just max_bits bits share a band as often in a large table as in a small one."""
    bits, bands = simhash.bands_for(n, simhash.MAX_BITS)
    where, rng = simhash.band_positions(bits, bands), np.random.default_rng(n)
    differ = np.argsort(rng.random((2000, simhash.BITS)), axis=1) < simhash.MAX_BITS
    shared = ~differ[:, where].any(axis=2)
    assert simhash.RECALL - 0.015 < shared.any(axis=1).mean() < simhash.RECALL + 0.03  # by sampling; bands that don't overlap do better


def test_same_groups_in_a_larger_table(spark):
    texts = corpus()
    small = [row(10 + i, t) for i, t in enumerate(texts)]
    more = [row(10_000 + i, prose(60, 70_000 + i)) for i in range(6000)]
    both = set(rows(simhash.near_duplicates(table(spark, small + more))))
    want = brute_groups([10 + i for i in range(len(texts))], fp_of(texts), simhash.MAX_BITS)
    assert len(want & both) >= 0.95 * len(want) and len(set(rows(simhash.near_duplicates(table(spark, small)))) ^ {x for x in both if x[0] < 10_000}) <= 0.05 * len(want)


def test_forest_connects_the_same():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, (2, 300))
    x, y = graphs.forest(a, b)

    def parts(edges):
        label = {i: i for e in zip(a.tolist(), b.tolist()) for i in e}
        for _ in range(400):
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert parts(list(zip(x.tolist(), y.tolist()))) == parts(list(zip(a.tolist(), b.tolist()))) and len(x) < len(a)


def test_drop_keeps_texts_that_share_an_id(spark, tmp_path):
    docs = [row(1, prose(90, 1)), row(1, prose(90, 2)), row(1, prose(90, 2)), row(2, prose(90, 2)), row(3, prose(90, 1))]
    table(spark, docs).repartition(3).write.parquet(str(tmp_path / "d"))
    for frame in (table(spark, docs), spark.read.parquet(str(tmp_path / "d"))):
        assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame).collect()) == sorted([(1, prose(90, 1)), (1, prose(90, 2))])


def test_awkward_documents(spark):
    docs = table(spark, awkward())
    assert set(rows(simhash.near_duplicates(docs))) == {(6, 5), (9, 8)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == [1, 2, 3, 4, 5, 5, 7, 8, 10, 11, 12] and kept.filter("doc_id is null").count() == 2
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 50), (2, 50), (2, 3), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = dict(rows(graphs.components(frame)))
    assert dict(rows(graphs.components(frame, 5))) == got and graphs.components(frame.limit(0)).count() == 0
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, 50: 1}


def brute_signature(hashes, bins, bits):
    least = {}
    for h in map(int, set(hashes.tolist())):
        b, v = h >> 64 - bins.bit_length() + 1, (h << bins.bit_length() - 1) % 2**64 >> 1
        least[b] = min(least.get(b, v), v)
    order, out = minhash.probe_order(bins, 4000), []
    for j in range(bins):
        v = least[j] if j in least else next(least[int(p)] for p in order[:, j] if int(p) in least)
        out.append(int(K.mix(np.array([v], dtype=np.uint64))[0]) & (1 << bits) - 1)
    return out


def test_signatures_equal_brute_force():
    h, at, *_ = K.words(pa.array([prose(5, 1), prose(300, 2), "", "one"]))
    s, sh = K.shingles(h, at, 3)
    for bits in (8, 4):
        sig, full = minhash.signatures(s, sh, 128, bits)
        assert full.tolist() == [0, 1, 3]
        for x, i in zip(sig, full):
            planes = np.unpackbits(x, bitorder="little").reshape(128, bits)
            assert [int(p @ (1 << np.arange(bits))) for p in planes] == brute_signature(s[sh[i] : sh[i + 1]], 128, bits)


@pytest.mark.parametrize("bits", [8, 4, 16])
def test_jaccard_estimate(spark, bits):
    base = prose(2000, 5)
    texts = [base] + [edited(base, p, 7) for p in (0.02, 0.1, 0.3)] + [prose(2000, 6), None, "", base]
    sig = minhash.fingerprint(table(spark, [row(i, t) for i, t in enumerate(texts)]), bits=bits)
    pairs = sig.filter("doc_id = 0").selectExpr("signature as a").crossJoin(sig.selectExpr("doc_id", "signature as b"))
    got = {r[0]: r[1] for r in pairs.select("doc_id", minhash.jaccard(pairs["a"], pairs["b"], bits=bits)).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    for i in range(5):
        x, y = shingles(base), shingles(texts[i])
        assert abs(got[i] - len(x & y) / len(x | y)) < 0.15
    assert got[5] is None and got[6] is None and got[7] == 1.0


def test_minhash_awkward(spark):
    got = minhash.fingerprint(table(spark, awkward())).collect()
    assert len(got) == 14
    by = {r.doc_id: r for r in got}
    assert by[2].n_shingles == 0 and by[3].signature is None and by[10].signature is None
    assert by[8].signature == by[9].signature and len(by[1].signature) == minhash.BINS * minhash.BITS // 8
    assert minhash.fingerprint(table(spark, [])).count() == 0
