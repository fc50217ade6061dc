import math

import pytest
from pyspark.sql import functions as F

from lexisweave.operators import analytics as A
from lexisweave.operators import evaluate as E
from lexisweave.operators import index as I
from lexisweave.plans.catalogue import judgments

#: Means over the 30 judged queries: P, DCG, NDCG and ERR at 1, 3 and 5.
WANT = {
    "ours": [1.000, 0.978, 0.740, 5.733, 8.829, 9.261, 1.000, 1.000, 1.000, 0.829, 0.877, 0.878],
    "wiki": [1.000, 1.000, 0.893, 6.400, 11.021, 12.021, 1.000, 1.000, 1.000, 0.850, 0.904, 0.905],
    "google": [1.000, 1.000, 0.960, 6.733, 12.435, 13.871, 1.000, 1.000, 1.000, 0.867, 0.920, 0.921],
}


def test_golden_metrics(spark):
    rows = judgments(spark)
    assert rows.count() == 90
    for r in E.quality_metrics(rows).collect():
        assert [round(r[f"{m}_{k}"], 3) for m in E.METRICS for k in (1, 3, 5)] == WANT[r.system]


@pytest.mark.parametrize("rels", [[0, 3, 1], [0, 0, 0], [], [1], [0, 2, 0, 3, 1, 2]])
def test_metrics_of_a_list(spark, rels):
    def dcg(x, k):
        return sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(x[:k]))

    def err(x, k):
        top, left, out = 2 ** (max(x, default=0) or 1), 1.0, 0.0
        for i, r in enumerate(x[:k], 1):
            stop = (2**r - 1) / top
            out, left = out + left * stop / i, left * (1 - stop)
        return out

    row = spark.createDataFrame([(rels,)], "rels array<int>").select(*[E.at(m, F.col("rels"), k).alias(f"{m}_{k}") for m in E.METRICS for k in (1, 3, 5)]).first()
    for k in (1, 3, 5):
        best = dcg(sorted(rels, reverse=True), k)
        assert math.isclose(row[f"p_{k}"], sum(r > 0 for r in rels[:k]) / k)
        assert math.isclose(row[f"dcg_{k}"], dcg(rels, k)) and math.isclose(row[f"ndcg_{k}"], dcg(rels, k) / best if best else 0)
        assert math.isclose(row[f"err_{k}"], err(rels, k))


def test_frequencies_and_ranks(spark):
    corpus = spark.createDataFrame([(1, "u", "t", "cats cat dog"), (2, "u", "t", "dog dog Bird 1"), (3, "u", "t", "")], "doc_id int, url string, title string, text string")
    vocab = I.vocabulary(I.postings(corpus)).cache()
    assert sorted(map(tuple, vocab.collect())) == [("1", 1, 1), ("bird", 1, 1), ("cat", 1, 2), ("dog", 2, 3)]
    assert [tuple(r) for r in A.top_terms(vocab, 3).collect()] == [("dog", 3), ("cat", 2), ("1", 1)]
    assert sorted((r["rank"], r.term, r.expected) for r in A.zipf(vocab).collect()) == [(1, "dog", 3.0), (2, "cat", 1.5), (3, "1", 1.0), (4, "bird", 0.75)]
    assert A.vocab_stats(vocab).first() == (4, 11)
    s = A.corpus_summary(corpus).first()
    assert (s.n_docs, s.raw_chars, s.n_tokens) == (3, 26, 7)
    gaps = {(r.term, r.doc_id): r.gaps for r in A.position_gaps(I.postings(corpus)).collect()}
    assert gaps["dog", 2] == [0, 1] and gaps["cat", 1] == [0, 1]


def test_rank_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("v"), F.format_string("%04d", "id").alias("k"))
    got = sorted((r["rank"], r.v, r.k) for r in A.ranked(rows, "v", "k", 7).collect())
    want = sorted(((i % 37, f"{i:04d}") for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert got == [(n, v, k) for n, (v, k) in enumerate(want, 1)]
