"""Corpus statistics: totals, frequencies, rank curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import raw_words
from .index import Index


def corpus_summary(corpus: DataFrame, raw_col: str = "text", text_col: str = "text") -> DataFrame:
    """Documents, characters of raw and parsed text with averages, words and their mean length, in one row."""
    w = raw_words(F.col(text_col))
    rows = corpus.select(F.length(raw_col).alias("raw"), F.length(text_col).alias("text"), F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("letters"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("n_docs"), total("raw").alias("raw_chars"), total("text").alias("text_chars"), F.avg("raw").alias("avg_raw"), F.avg("text").alias("avg_text"),
        total("n").alias("n_tokens"), (F.sum("letters") / F.sum("n")).alias("avg_token_len"),
    )


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """(n_terms, total_len) of the dictionary."""
    return vocab.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("total_len"))


def token_term_len(vocab: DataFrame) -> DataFrame:
    """Mean length of stemmed tokens (by occurrence) and of terms (each once), and their difference."""
    token = F.sum(F.length("term") * F.col("cf")) / F.sum("cf")
    term = F.avg(F.length("term"))
    return vocab.agg(token.alias("avg_token"), term.alias("avg_term"), (term - token).alias("difference"))


def top_terms(vocab: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent terms; ties by term."""
    return vocab.orderBy(F.desc("cf"), "term").limit(n).select("term", "cf")


def ranked(rows: DataFrame, value: str, tie: str, parts: int | None = None) -> DataFrame:
    """rows with their rank by descending value and then tie (neither null), without a window over all rows in one task.

    A bounded sample gives the bounds of `parts` ranges of the order (by default one for each million rows, 32 to 1024), as literals, so that every evaluation cuts alike. Rows are numbered
    within their range and shifted by the counts of the ranges before it: one small row for each range is summed up. A value that most rows
    share is cut by its ties.
    """
    total = rows.count()
    parts = parts or min(1024, max(32, total >> 20))
    sample = rows.select(value, tie).sample(min(1.0, 50 * parts / max(1, total)), seed=7).limit(200 * parts).collect()
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    order = sorted(sorted((tuple(r) for r in sample), key=lambda r: r[1]), key=lambda r: r[0], reverse=True)
    cuts = list(dict.fromkeys(order[len(order) * i // parts] for i in range(1, parts))) if order else []
    bounds = [F.struct(F.lit(v).cast(kinds[value]).alias("v"), F.lit(k).cast(kinds[tie]).alias("k")) for v, k in cuts]
    at = F.size(F.filter(F.array(*bounds), lambda b: (F.col(value) < b["v"]) | ((F.col(value) == b["v"]) & (F.col(tie) >= b["k"])))) if bounds else F.lit(0)
    cut = rows.withColumn("__part", at)
    counts = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # at most `parts` rows
    local = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(value), F.col(tie)))
    return cut.withColumn("__local", local).join(F.broadcast(before), "__part").withColumn("rank", (F.col("__local") + F.col("__before")).cast("long")).drop("__part", "__local", "__before")


def zipf(vocab: DataFrame) -> DataFrame:
    """(rank, term, cf, expected): the rank curve, and the highest frequency over the rank."""
    top = vocab.agg(F.max("cf").alias("top"))
    return ranked(vocab.select("term", "cf"), "cf", "term").crossJoin(F.broadcast(top)).select("rank", "term", "cf", (F.col("top") / F.col("rank")).alias("expected"))


def position_gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, gaps): positions as the first one and differences."""
    gaps = F.transform("positions", lambda p, i: F.when(i == 0, p).otherwise(p - F.element_at("positions", i)))
    return postings.select("term", "doc_id", gaps.alias("gaps"))


def summary(index: Index) -> dict:
    """Totals of an index as plain numbers."""
    return index.stats.first().asDict() | vocab_stats(index.vocab).first().asDict()
