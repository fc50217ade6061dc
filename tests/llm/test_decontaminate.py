import re

import pytest

from lexisweave.llm import decontaminate as D
from lexisweave.llm.decontaminate import Matcher, find_benchmark_text, merge


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        m = min(window, len(v))
        if name is None or not m:
            continue
        for k in range(len(v) - m + 1):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


ALPHABET = "the of a b c d e f g h"
ITEMS = [
    (1, "the of a b c d e f g h the of a"), (2, "q"), (3, "the of"), (4, "x y x y x y x y x y x y"), (5, None), (6, "!!"),
    (7, "The OF a B c d e f g h"), (8, "É é ß 42 K x"), (11, "c d e"), (None, "zz zz"), (1, "p q r s"), (8, "É é ß 42 K x"),
]
TEXTS = [
    None, "", " .,;", "q", "Q! q-q", "the of a b c d e f g h the of a", "a the, of. A b c d e f g h x", "x y " * 40, "y x y x y x y x y x y x", "é É é ß 42 K x É é ß 42 k x",
    "zz zz", "p q r s", "the of " * 2000 + "the of a b c d e f g h", "c d c d e c d e e", "the of a b c d e f g", "\x00q\x7fq q",
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(3, "q", "s", 1)], "doc_id long, text string, spans string, n_hit int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    docs, items = frames(spark)
    found = find_benchmark_text(docs, items, block_bytes=block_bytes)
    assert found.columns == [*docs.columns, "hits"]
    got = sorted((r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits["items"], sum(s.end - s.start for s in r.hits.spans)) for r in found.collect())
    want = sorted((i, *(p := plain(t, ITEMS)), p[1]) for i, t in [*enumerate(TEXTS), (3, "q")])
    assert got == want


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert find_benchmark_text(docs.limit(0), items).count() == 0
    assert {r.hits.n_hit for r in find_benchmark_text(docs, items.limit(0)).collect()} == {0}


def test_random_patterns():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        make = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
        items = [(k, make(rnd.randint(0, 9))) for k in range(rnd.randint(1, 6))]
        text = make(rnd.randint(0, 40))
        h = Matcher([(str(k), t.encode()) for k, t in items], 5).hits(text.encode())
        assert (h["n_words"], h["n_hit"], h["items"]) == plain(text, items, 5)


def test_merge():
    assert merge([(5, 7), (0, 2), (2, 3), (6, 6), (9, 10)]) == [(0, 3), (5, 7), (9, 10)]


def test_large_benchmark_equals_brute_force(spark):
    """Items of all lengths, texts hit by many windows with different numbers of spans, and tables so small that slots are shared."""
    import random

    rnd = random.Random(7)
    make = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    items = [(k, make(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 14, 25, 25, 60])]
    texts = [make(rnd.randint(0, 30)) for _ in range(30)] + [" z ".join([items[11][1], items[13][1], items[9][1], items[11][1], make(40)]), make(3) + " " + items[12][1], None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: (*plain(t, items), i) for i, t in enumerate(texts)}
    assert len({n for _, n, *_ in want.values()}) > 5
    for bits in (22, 6):
        found = find_benchmark_text(docs, bench, block_bytes=10, shift_bits=bits).collect()
        assert {r.doc_id: (r.hits.n_words, r.hits.n_hit, r.hits["items"], r.doc_id) for r in found} == want
        assert all(sum(s.end - s.start for s in r.hits.spans) == r.hits.n_hit and [tuple(s) for s in r.hits.spans] == merge(map(tuple, r.hits.spans)) for r in found)


def test_sieve_lets_every_window_through():
    import random

    rnd = random.Random(3)
    for trial in range(200):
        make = lambda n: [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)]
        items, window = [make(rnd.randint(1, 9)) for _ in range(rnd.randint(1, 5))], rnd.randint(1, 6)
        sieve, text = D.Sieve(8 + trial % 8, 10), make(rnd.randint(0, 40))
        for w in items:
            sieve.add(D._word_hashes(w), min(window, len(w)))
        found = {(m, s) for m, starts in sieve.candidates(D._word_hashes(text)) for s in starts.tolist()}
        windows = {tuple(w[i : i + m]) for w in items for m in [min(window, len(w))] for i in range(len(w) - m + 1)}
        assert found >= {(len(w), i) for w in windows for i in range(len(text) - len(w) + 1) if tuple(text[i : i + len(w)]) == w}
