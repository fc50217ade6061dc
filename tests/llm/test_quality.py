import random

import numpy as np

from lexisweave.llm import quality as Q


VOCABULARY = ["".join(random.Random(k).choices(["ba", "to", "ri", "lem", "son", "ka"], k=2 + k % 3)) for k in range(600)]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY if rnd.random() < 0.7 else ["the", "of", "and", "in"]) for _ in range(n)).capitalize() + "."


def junk(rnd, n, kind):
    words = prose(rnd, n).split()
    if kind == 0:
        return " ".join(w + rnd.choice(["***", "&&&", "###"]) for w in words)
    if kind == 1:
        return "!! ".join(words).upper()
    if kind == 2:
        return " | ".join(words) + " |"
    return " ".join(w for w in words for _ in range(9 + 20 * (n % 2)))


def corpus(seed, n=240):
    rnd = random.Random(seed)
    return [(prose(rnd, rnd.randint(2, 200)), 1) if k % 5 else (junk(rnd, rnd.randint(15, 120), k // 5 % 4), 0) for k in range(n)]


def test_separates_without_labels(spark):
    rows = corpus(1)
    odd = [None, "", " \n", "x" * 100000, "a", "1 2 3", "é ñ ü", rows[1][0]]
    texts = [t for t, _ in rows] + odd
    docs = spark.createDataFrame([(i, t, 0.1, 1) for i, t in enumerate(texts)], "doc_id long, text string, score double, code int")
    model = Q.train(docs)
    found = Q.classify(docs, model)
    assert found.columns == [*docs.columns, "quality"]
    got = {r.doc_id: r.quality for r in found.collect()}
    assert len(got) == len(texts)
    assert np.mean([got[i].keep for i, (_, y) in enumerate(rows) if y]) > 0.99
    assert np.mean([not got[i].keep for i, (_, y) in enumerate(rows) if not y]) > 0.9
    for k in range(3):
        assert tuple(got[len(rows) + k]) == (0.0, 0.0, False)
    assert got[len(texts) - 1] == got[1]
    assert Q.classify(docs.limit(0), model).count() == 0
    held = corpus(2)
    scores = [model.score(t.encode())[1] for t, _ in held]
    assert np.mean([(s >= Q.THRESHOLD) == bool(y) for s, (_, y) in zip(scores, held)]) > 0.95
    again = Q.train(docs.orderBy("text"))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.classify(docs, Q.train(docs)).count() == 0


def test_em_recovers_labeller_accuracy():
    rng = np.random.default_rng(3)
    n, recall, false = 20000, [0.7, 0.5, 0.8, 0.6], [0.02, 0.05, 0.1, 0.01]
    bad = rng.random(n) < 0.2
    rows = np.stack([np.where(rng.random(n) < np.where(bad, r, f), Q.BAD, Q.ABSTAIN) for r, f in zip(recall, false)], axis=1)
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts.astype(float), 500, false_alarms=1.0, recall=0.0)
    assert abs(model.prior - 0.8) < 0.03
    assert np.allclose(model.vote[Q.BAD, :, Q.BAD], recall, atol=0.06) and np.allclose(model.vote[Q.GOOD, :, Q.BAD], false, atol=0.03)


def test_patterns_have_codes():
    for v in ([0] * Q.LABELLERS, [2] * Q.LABELLERS, [k % 3 for k in range(Q.LABELLERS)]):
        assert Q.pattern(Q.code(v)) == v
    assert len(Q.votes(Q.statistics(b"a b"))) == Q.LABELLERS


def plain_em(rows, rounds=300):
    """Row by row, with dictionaries; the same start and smoothing."""
    n, k = len(rows), len(rows[0])
    good = []
    for r in rows:
        bad, cast = sum(v == Q.BAD for v in r), sum(v != Q.ABSTAIN for v in r)
        good.append(0.95 if bad == 0 else 0.3 * (1 - bad / max(1, cast)) + 0.02)
    for _ in range(rounds):
        weight = {Q.GOOD: good, Q.BAD: [1 - g for g in good]}
        table = {}
        for c, w in weight.items():
            for j in range(k):
                sums = {v: 1 / 3 + sum(x for x, r in zip(w, rows) if r[j] == v) for v in (Q.BAD, Q.GOOD, Q.ABSTAIN)}
                table[c, j] = {v: x / sum(sums.values()) for v, x in sums.items()}
        prior = min(0.98, max(0.02, sum(good) / n))
        new = []
        for r in rows:
            a, b = prior, 1 - prior
            for j, v in enumerate(r):
                a, b = a * table[Q.GOOD, j][v], b * table[Q.BAD, j][v]
            new.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(good, new)) < 1e-6:
            break
        good = new
    return prior, table, new


def test_em_at_the_production_setting():
    """All labellers vote both ways and overlap; accuracies come out, and what a plain loop gives."""
    rng = np.random.default_rng(4)
    n, k = 3000, Q.LABELLERS
    recall, false = rng.uniform(0.15, 0.7, k), rng.uniform(0.0, 0.04, k)
    bad = rng.random(n) < 0.15
    hit = rng.random((n, k)) < np.where(bad[:, None], recall, false)
    rows = np.where(hit, Q.BAD, np.where(rng.random((n, k)) < 0.1, Q.ABSTAIN, Q.GOOD))
    patterns, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.03 and np.allclose(model.vote[Q.BAD, :, Q.BAD], recall, atol=0.08) and np.allclose(model.vote[Q.GOOD, :, Q.BAD], false, atol=0.02)
    prior, table, posterior = plain_em(rows.tolist())
    assert abs(prior - model.prior) < 1e-6 and all(abs(table[c, j][v] - model.vote[c, j, v]) < 1e-6 for c in (0, 1) for j in range(k) for v in range(3))
    own = model.posterior(patterns)[inverse.reshape(-1)]
    assert np.allclose(own, posterior, atol=1e-4)
    # better than rejecting whatever any labeller calls bad
    assert ((own < 0.5) == bad).mean() > 0.97 > 0.85 > (hit.any(axis=1) == bad).mean()


def test_votes_go_both_ways():
    texts = [prose(random.Random(k), 80).encode() for k in range(20)] + [junk(random.Random(k), 80, k % 4).encode() for k in range(20)]
    seen = np.array([Q.votes(Q.statistics(t)) for t in texts])
    assert (seen[:20] == Q.GOOD).mean() > 0.9 and (seen[20:] == Q.BAD).any(axis=1).all() and ((seen[20:] == Q.GOOD).any(axis=1)).all()
