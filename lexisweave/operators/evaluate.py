"""Ranking quality of judged lists: precision, DCG, NDCG and ERR at k, from arrays of grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("p", "dcg", "ndcg", "err")


def precision_at(rels: Column, k: int) -> Column:
    """Share of the first k places (present or not) with a grade over 0."""
    return F.size(F.filter(F.slice(rels, 1, k), lambda r: r > 0)) / F.lit(float(k))


def dcg_at(rels: Column, k: int) -> Column:
    """Sum of (2^grade - 1) / log2(place + 1) over the first k places."""
    gains = F.transform(F.slice(rels, 1, k), lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def ndcg_at(rels: Column, k: int) -> Column:
    """DCG over that of the same list in its best order; 0 if that is 0."""
    ideal = dcg_at(F.sort_array(rels, asc=False), k)
    return F.when(ideal == 0, 0.0).otherwise(dcg_at(rels, k) / ideal)


def err_at(rels: Column, k: int) -> Column:
    """Expected reciprocal rank: a reader stops at a place with probability (2^grade - 1) / 2^max, max being the list's highest grade (at least 1)."""
    top = F.pow(F.lit(2.0), F.greatest(F.coalesce(F.array_max(rels), F.lit(0)), F.lit(0)))
    top = F.when(F.coalesce(F.array_max(rels), F.lit(0)) == 0, 2.0).otherwise(top)
    start = F.struct(F.lit(0.0).alias("err"), F.lit(1.0).alias("left"), F.lit(1.0).alias("place"))

    def step(acc: Column, r: Column) -> Column:
        stop = (F.pow(F.lit(2.0), r) - 1) / top
        return F.struct((acc["err"] + acc["left"] * stop / acc["place"]).alias("err"), (acc["left"] * (1 - stop)).alias("left"), (acc["place"] + 1).alias("place"))

    return F.aggregate(F.slice(rels, 1, k), start, step, lambda acc: acc["err"])


def at(metric: str, rels: Column, k: int) -> Column:
    return {"p": precision_at, "dcg": dcg_at, "ndcg": ndcg_at, "err": err_at}[metric](rels, k)


def per_query(judgments: DataFrame, metric: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query, system, <metric>_k...) of judgments (query, system, rels)."""
    return judgments.select("query", "system", *[at(metric, F.col("rels"), k).alias(f"{metric}_{k}") for k in ks])


def quality_metrics(judgments: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(system, metric_k...): all metrics averaged over the queries of each system."""
    return judgments.groupBy("system").agg(*[F.avg(at(m, F.col("rels"), k)).alias(f"{m}_{k}") for m in METRICS for k in ks])
