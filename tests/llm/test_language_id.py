import random

import numpy as np
from pyspark.sql import functions as F

from lexisweave.llm import language_id as L
from lexisweave.llm.hashed import hashed_ngrams, spherical_kmeans, unit_rows

WORDS = {"en": "the and of that with from this thing", "fr": "le la les des une avec être où", "de": "der die das und nicht über für", "el": "και το είναι από στην"}


def corpus(seed, n=40):
    rnd = random.Random(seed)
    return [(lang, " ".join(rnd.choices(w.split(), k=rnd.randint(3, 30)))) for lang, w in WORDS.items() for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, score double, id string")


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(1) + [("en", None), (None, "the thing"), ("xx", "12 34 !?"), ("fr", "")]
    docs = frame(spark, rows)
    model = L.train(docs, F.col("doc_id") % 5 == 0)
    assert set(model.languages) == set(WORDS)
    odd = [(None, None), (None, ""), (None, " 12 .\n"), (None, "x" * 200000), (None, "THE THING, of that!"), (None, "日本語"), (None, "1a")]
    found = L.identify(frame(spark, rows + odd), model)
    assert found.columns[-1] == "language"
    got = {r.doc_id: r.language for r in found.collect()}
    n = len(corpus(1))
    assert all(got[i].lang == rows[i][0] for i in range(0, n, 5))
    assert [tuple(got[i]) for i in (n, n + 2, n + 3, len(rows), len(rows) + 1, len(rows) + 2)] == [("und", 0.0, True)] * 6
    assert got[len(rows) + 4].lang == "en" and all(got[len(rows) + k].lang in WORDS for k in (3, 4, 5, 6))
    assert got[len(rows) + 5].rejected and sum(got[i].rejected for i in range(n)) < n / 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(docs.limit(0), model).count() == 0


def test_only_text_decides_and_held_out_rows_teach_nothing(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    first = L.train(docs, F.col("doc_id") % 5 == 0)
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    second = L.train(other.orderBy("doc_id"), F.col("doc_id") % 5 == 0)
    assert first.languages == second.languages and np.array_equal(first.centroids, second.centroids)


def test_no_labels(spark):
    docs = frame(spark, [(None, "the"), (None, None)])
    model = L.train(docs, F.lit(False))
    assert {r.language.lang for r in L.identify(docs, model).collect()} == {"und"}


def test_hashed_ngrams_count_each_ngram():
    codes = np.frombuffer(b"abcabcab", dtype=np.uint8)
    for n in (1, 2, 3, 4):
        counts = hashed_ngrams(codes, (n,), 16)
        grams = [bytes(codes[i : i + n]) for i in range(9 - n)]
        assert counts.sum() == len(grams) and sorted(counts[counts > 0]) == sorted(grams.count(g) for g in set(grams))
    assert hashed_ngrams(codes[:1], (2, 3), 8).sum() == 0


def test_kmeans_finds_separate_directions():
    rng = np.random.default_rng(0)
    base = np.eye(8)[:3]
    rows = unit_rows(np.repeat(base, 20, axis=0) + 0.05 * rng.random((60, 8)))
    found = spherical_kmeans(rows, 3)
    assert sorted(np.argmax(found, axis=1)) == [0, 1, 2]
    assert len(spherical_kmeans(rows[:2], 5)) == 2


def test_many_languages_are_all_learned(spark):
    """Two hundred and sixty languages with a word of their own each; a text that a third of all rows share is sampled once."""
    rnd = random.Random(9)
    names = [f"l{k:03d}" for k in range(260)]
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in names]
    rows = [(n, f"{w} " * (2 + k)) for n, w in zip(names, words) for k in range(3)] + [("l000", f"{words[0]} ")] * 400
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.train(docs, F.lit(False))
    assert sorted(set(model.languages)) == names and model.languages.count("l000") <= L.CENTROIDS
    assert [p[0] for p in model.predict([f"{w} {w}" for w in words])] == names
