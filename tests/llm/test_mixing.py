import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexisweave.llm.mixing import leaf_budgets, mix


def fill(children, budget):
    """Children {name: (weight, cap)}: share by weight, take out the full ones, share again."""
    got, left, open_ = {}, min(budget, sum(c for _, c in children.values())), dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c <= left * w / total + 1e-12}
        if not full:
            return got | {n: left * w / total for n, (w, _) in open_.items()}
        got |= full
        left -= sum(full.values())
        open_ = {n: x for n, x in open_.items() if n not in full}
    return got


def plain_budgets(leaves, weights, budget, most):
    def down(depth, group, given):
        if depth == len(weights):
            return {k: given for k in group}
        by = {}
        for k, t in group.items():
            by.setdefault(k[depth], {})[k] = t
        shares = fill({n: (weights[depth].get(n, 1.0), most * sum(g.values())) for n, g in by.items()}, given)
        return {k: v for n, g in by.items() for k, v in down(depth + 1, g, shares[n]).items()}

    return down(0, leaves, min(budget, most * sum(leaves.values())))


WEIGHTS = ({"a": 0.7, "b": 0.2}, {"en": 3.0}, {})


@pytest.mark.parametrize("budget", [0, 1, 500, 3000, 10000, 10**6])
def test_budgets_against_plain_filling(spark, budget):
    rnd = random.Random(budget)
    leaves = {(a, lang, s): rnd.choice([0, 1, 10, 100, 900]) for a in "abc" for lang in ("en", "de") for s in "xyz"}
    rows = leaf_budgets(spark.createDataFrame([(*k, t) for k, t in leaves.items()], "p string, q string, r string, tokens long"), ["p", "q", "r"], WEIGHTS, budget, 3).collect()
    got = {(r.p, r.q, r.r): r.budget for r in rows}
    want = plain_budgets(leaves, WEIGHTS, budget, 3)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - v) <= 1.0
    assert sum(got.values()) <= min(budget, 3 * sum(leaves.values()))


def plain_mix(rows, budgets, seed="mix"):
    out, by = [], {}
    for i, key, n in rows:
        by.setdefault(key, []).append((i, n))
    for key, own in by.items():
        total = sum(n for _, n in own)
        epochs, rest = divmod(budgets[key], total) if total else (0, 0)
        out += [(i, *key, e, n, n) for e in range(epochs) for i, n in own]
        used = 0
        for i, n in sorted(own, key=lambda x: (hashlib.md5(f"{seed}:{epochs}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])):
            if used < rest:
                out.append((i, *key, epochs, n, min(n, rest - used)))
            used += n
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [4096, 5])
@pytest.mark.parametrize("share", [0.05, 0.8, 2.5, 100.0])
def test_selection(spark, share, slice_rows):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("aabc"), rnd.choice(["en", "en", "de", None]), "xxxxxyz"[rnd.randrange(7)], rnd.choice([None, "", "one", "two words", "a b  c\nd " * 9])) for i in range(300)]
    rows += [(5, "a", "en", "x", "two words"), (None, "b", "en", "x", "one"), (1000, "z", "q", "only", "w " * 40000)]
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id long, d string, lang string, source string, text string, epoch int, n_tokens int, __n string")
    path = {"d": F.col("d"), "lang": F.col("lang"), "source": F.col("source")}
    found = mix(docs, path, WEIGHTS, budget_share=share, max_epochs=3, slice_rows=slice_rows)
    assert found.columns == ["doc_id", "d", "lang", "source", "epoch", "n_tokens", "take_tokens"]
    counted = [(i, (d, lang or "", s), len((t or "").split())) for i, d, lang, s, t in rows]
    leaves = {}
    for _, key, n in counted:
        leaves[key] = leaves.get(key, 0) + n
    table = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "p string, q string, r string, tokens long")
    budgets = {(r.p, r.q, r.r): r.budget for r in leaf_budgets(table, ["p", "q", "r"], WEIGHTS, share * sum(leaves.values()), 3).collect()}
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == plain_mix(counted, budgets)
    for key, b in budgets.items():
        assert sum(r[6] for r in got if r[1:4] == key) == min(b, 3 * leaves[key])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert mix(docs, {"lang": F.col("lang")}, ({},), budget_share=0.5).count() == 0


def test_names_that_clash(spark):
    import pytest
    from pyspark.sql import functions as F

    from lexisweave.llm.mixing import mix

    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, lang string")
    for name in ("epoch", "n_tokens", "take_tokens", "doc_id"):
        with pytest.raises(ValueError):
            mix(docs, {name: F.col("lang")}, [{}], budget=1)
