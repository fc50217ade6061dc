import random

import numpy as np
import pytest
import xxhash

from lexisweave.llm import simhash as S
from lexisweave.llm.components import connected_components


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, fps, radius=2):
    up = {i: i for i in range(len(ids))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d a b c d a b c", "É é ſ K x\x0by\x1fz w q", "w " * 5000])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()).tolist() == [plain_fingerprint(text)]
    assert S.fingerprint((text or "").encode(), words=4)[0] == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_kernel_counts_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (5, 1), dtype=np.uint64)
    fps = np.repeat(base, 64, axis=1)
    for _ in range(4):
        fps ^= (rng.integers(0, 2, fps.shape) * (1 << rng.integers(0, 63, fps.shape))).astype(np.uint64)
    masks = S.lanes_within(fps[:, :, None], S.bit_planes(fps[:, :, None]), radius)
    for b in range(5):
        for q in range(64):
            want = sum(1 << k for k in range(64) if (int(fps[b, q]) ^ int(fps[b, k])).bit_count() <= radius)
            assert int(masks[b, q]) == want


def test_links_connect_small_and_large_buckets():
    rnd = random.Random(3)
    fps, bucket = [], []
    for k, size in enumerate([1, 2, 3, 64, 65, 200, 700]):
        base = rnd.getrandbits(64)
        for _ in range(size):
            f = base
            for _ in range(rnd.randint(0, 5)):
                f ^= 1 << rnd.randint(0, 15)
            fps.append(f), bucket.append(k)
    found = list(S.links(np.array(bucket), np.zeros(len(fps), int), np.array(fps, dtype=np.uint64)[:, None], 2))
    assert len(found) < len(fps)
    for k in set(bucket):
        own = [i for i in range(len(fps)) if bucket[i] == k]
        want = plain_components(own, [fps[i] for i in own])
        up = {i: i for i in own}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in found:
            if bucket[i] == k:
                assert (fps[i] ^ fps[j]).bit_count() <= 2
                up[find(j)] = find(i)
        pairs = {(want[a], find(i)) for a, i in enumerate(own)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [1 << 14, 8])
def test_groups_against_brute_force(spark, chunk, monkeypatch):
    rnd = random.Random(5)
    # planted fingerprints: the text is the fingerprint in hex, so that links of all kinds occur
    monkeypatch.setattr(S, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id id", "cast(conv(text, 16, -10) as long) f0"))
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = [0, 0, 1]
    for c in centres:
        for _ in range(25):
            f = c
            for _ in range(rnd.randint(0, 4)):
                f ^= 1 << rnd.randint(0, 63)
            fps.append(f)
        c ^= (1 << 40) - 1
        fps += [c ^ (1 << b) for b in range(20)]
    ids = list(range(10, 10 + len(fps)))
    rnd.shuffle(ids)
    docs = spark.createDataFrame([(i, f"{f:016x}") for i, f in zip(ids, fps)], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_groups(docs, chunk=chunk).collect()}
    want = plain_components(ids, fps)
    assert got == {i: (f"{f:016x}", w) for i, f, w in zip(ids, fps, want)}


def test_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    texts = [(5, "a b c d"), (3, "A  b\nc d"), (9, None), (8, ""), (7, "\t"), (4, long), (2, long + " x"), (5, "a b c d"), (6, "q")]
    docs = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in texts], "doc_id long, text string, f0 string, node int, component_id int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(docs).collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    want = plain_components([i for i, _ in texts], fps)
    assert got == sorted((i, f"{f:016x}", w) for (i, _), f, w in zip(texts, fps, want))
    assert S.simhash_groups(docs.limit(0)).count() == 0


def test_wide_kernel():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (3, 1, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = np.packbits(rng.random((3, 64, 256)) < rng.choice([0.02, 0.08, 0.5], (3, 64, 1)), axis=2).view("<u8").astype(np.uint64)
    fps = np.repeat(base, 64, axis=1) ^ flips
    for radius in (39, 20, 64):
        masks = S.lanes_within(fps, S.bit_planes(fps), radius)
        for b in range(3):
            far = np.bitwise_count(fps[b][:, None, :] ^ fps[b][None, :, :]).sum(axis=2)
            want = (far <= radius)
            assert np.array_equal(np.unpackbits(masks[b].astype("<u8").view(np.uint8).reshape(64, 8), axis=1, bitorder="little").astype(bool), want)


def test_similar_texts_meet_and_others_do_not(spark):
    """Pairs by the exact Jaccard similarity of 5-word shingles: above 0.87 linked, below 0.7 apart."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for k in range(120):
        a = rnd.choices(vocab, k=rnd.randint(60, 400))
        b = list(a)
        for _ in range(rnd.randint(0, max(1, len(a) // 14))):
            b[rnd.randrange(len(b))] = rnd.choice(vocab)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        pairs.append(len(x & y) / len(x | y))
    got = {r.doc_id: r.component_id for r in S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=4, radius=39).collect()}
    for k, j in enumerate(pairs):
        assert got[2 * k] == 2 * k
        if j >= 0.87 or j <= 0.7:
            assert (got[2 * k + 1] == 2 * k) == (j >= 0.87), j
    assert sum(j >= 0.87 for j in pairs) > 20 and sum(j <= 0.7 for j in pairs) > 5


def test_null_and_repeated_ids_link_nothing(spark):
    a, b, c, d = "a b c d e", "p q r s t", "u v w x y z", "k l m n o"
    rows = [(None, a), (None, b), (7, a), (3, b), (3, c), (9, c), (None, d), (3, a)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    fp = {t: f"{plain_fingerprint(t):016x}" for t in (a, b, c, d)}
    assert got == sorted([(None, fp[a], 3), (None, fp[b], 3), (7, fp[a], 3), (3, fp[b], 3), (3, fp[c], 3), (9, fp[c], 3), (None, fp[d], None), (3, fp[a], 3)], key=str)
    got = {(r.doc_id, r.component_id) for r in S.simhash_groups(spark.createDataFrame([(None, a), (4, a), (None, b), (5, b)], "doc_id long, text string")).collect()}
    assert got == {(None, 4), (4, 4), (None, 5), (5, 5)}
