import random

import numpy as np

from lexisweave.llm import near_copies as N
from lexisweave.llm import pipeline_stages as S


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def changed(rnd, text, share):
    return " ".join(f"w{rnd.randrange(10**6)}" if rnd.random() < share else w for w in text.split())


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def fixture():
    """Pairs of many similarities about 0.8, and a chain in which only neighbours are similar."""
    rnd = random.Random(5)
    texts = []
    for k in range(240):
        base = words(rnd, rnd.choice((30, 60, 200, 500)))
        texts += [base, changed(rnd, base, rnd.uniform(0, 0.07))]
    short = words(rnd, 30).split()
    texts += [" ".join(short), " ".join([*short[:15], "other", *short[16:]])]  # one word in the middle of 30: 0.68
    chain = words(rnd, 100).split()
    texts += [" ".join(chain[8 * k :] + [f"c{x}" for x in range(8 * k)]) for k in range(4)]
    line = words(rnd, 5)
    texts += [f"{line} " * 60 + words(rnd, 40) for _ in range(2)]  # a repeated line makes no copies of different texts
    return texts


def brute_force(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if abs(i - j) < 5 and similarity(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


def test_near_dedup_is_exact(spark):
    texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    values = [similarity(texts[k], texts[k + 1]) for k in range(0, 480, 2)]
    assert sum(0.8 <= v < 0.85 for v in values) > 10 and sum(0.7 <= v < 0.8 for v in values) > 10
    assert sorted(r.doc_id for r in S.near_dedup(spark, docs, "").collect()) == brute_force(texts)


def test_large_buckets(spark):
    rnd = random.Random(6)
    base = words(rnd, 200)
    texts = [changed(rnd, base, 0.008) for _ in range(60)] + [changed(rnd, base, 0.05) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (N.near_copies(docs, chunk=c).select("id", "component").collect() for c in (4096, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_similar_links_at_the_bound():
    sets = [np.arange(0, 9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64), np.arange(50, 59, dtype=np.uint64)]
    assert list(N.similar_links(sets, np.arange(4), np.zeros(4))) == [(0, 1), (1, 2)]  # 8 of 10, and 7 of 11


def test_rows_of_one_id(spark):
    rnd = random.Random(7)
    a, b, c, d = (words(rnd, 60) for _ in range(4))
    docs = spark.createDataFrame([(1, a), (5, b), (5, a), (5, c), (5, c), (7, c), (8, b), (8, d), (9, None), (3, None)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in S.near_dedup(spark, docs, "").collect())
    assert kept == sorted([(1, a), (5, b), (5, c), (8, d), (3, "")])


def test_simhash_finds_close_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "PASSES", ())  # what SimHash finds by itself, at the parameters of the pipeline
    rnd = random.Random(8)
    texts = []
    for _ in range(150):
        base = words(rnd, rnd.choice((60, 200, 500)))
        texts += [base, changed(rnd, base, rnd.uniform(0, 0.06))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    groups = {r.id: r.component for r in N.near_copies(docs).collect()}
    values = [(similarity(texts[k], texts[k + 1]), groups[k] == groups[k + 1]) for k in range(0, 300, 2)]
    assert len(set(groups.values())) == 300 - sum(linked for _, linked in values)
    assert not any(linked for v, linked in values if v < 0.8)
    close = [linked for v, linked in values if v >= 0.9]
    assert len(close) > 20 and sum(close) > 0.8 * len(close)


def test_links_of_one_node_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "PASSES", ())
    rnd = random.Random(9)
    base = words(rnd, 400)
    docs = spark.createDataFrame(list(enumerate(changed(rnd, base, 0.003) for _ in range(60))), "doc_id long, text string")
    found = []
    for share in (256, 7):
        monkeypatch.setattr(N, "SHARE", share)
        found.append(sorted((r.id, r.component) for r in N.near_copies(docs).collect()))
    assert found[0] == found[1] and len({c for _, c in found[0]}) < 10
