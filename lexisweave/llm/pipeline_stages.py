"""Stages of the corpus pipeline: each takes documents and returns those that its operator keeps, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .decontaminate import find_benchmark_text
from .mixing import SPACED, mix
from .near_copies import near_copies, text_hash
from .quality import classify, train
from .shared import materialize
from .token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    It rejects null texts and those without words. Rows that repeat go or stay together; a very long text is judged whole; an empty table
    gives an empty one. Only the text decides; other columns can have any names and hold nulls.
    """
    column = _unused(docs, "quality")
    return classify(docs, train(docs), result_col=column).where(F.col(f"`{column}`.keep")).drop(column)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingle similarity 0.8 or more, and what such links connect), that with the smallest id.

    Rows are kept or dropped one by one, by id and text: of an id with several texts, each goes only with its own group. Of rows that are
    equal in id and text one stays. Texts that are null or without words are copies of each other. Rows with a null id stay. An empty table
    gives an empty one; other columns can have any names and hold nulls.
    """
    groups = materialize(near_copies(docs.where("doc_id is not null")).select("id", "hash", "component"), "near-groups")
    # a text is in one component, so a row stays if its id and text are the least of any; nothing is joined by component, which may be a hot one
    best = groups.groupBy("component").agg(F.min(F.struct("id", "hash")).alias("best")).select("best.id", "best.hash")
    own_id, own_hash = _unused(docs, "near_id"), _unused(docs, "near_hash")
    rows = groups.groupBy("id", "hash").agg(F.count("*").alias("n"))
    dropped = materialize(rows.join(best, ["id", "hash"], "left_anti").select(F.col("id").alias(own_id), F.col("hash").alias(own_hash)), "near-dropped")
    kept = docs.join(dropped, (docs["doc_id"] == F.col(own_id)) & (text_hash("text") == F.col(own_hash)), "left_anti")
    if not rows.where("n > 1").head(1):
        return kept
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window.

    Null and empty texts have none and stay; rows that repeat go or stay together; a very long text is searched whole; an empty table, or an
    empty benchmark, gives back what there is. Only the text decides; other columns can have any names and hold nulls.
    """
    column = _unused(docs, "hits")
    found = find_benchmark_text(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits_col=column)
    return found.where(F.col(f"`{column}`.n_hit") == 0).drop(column)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them; the last of a leaf's prefix ends with its last word in the budget, with its white space up to there.

    Rows that are equal in id and text share their place in the mix. Null languages and sources are branches of their own; null texts have no words, and an
    empty table gives an empty one. Other columns can have any names and hold nulls.
    """
    # a row is known by its id and text
    key, take, whole = (_unused(docs, n) for n in ("mix_key", "mix_take", "mix_all"))
    keyed = docs.withColumn(key, F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(F.col("text")).cast("string")))
    found = mix(keyed, Q.mix_path(), Q.MIX_WEIGHTS, budget_share=Q.MIX_SHARE, id_col=key)
    uses = found.groupBy(key, "epoch").agg(F.max("take_tokens").alias(take), F.max("n_tokens").alias(whole)).drop("epoch")
    joined = keyed.join(uses, key)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(SPACED), F.lit(0)), F.lit(1), F.col(take).cast("int")), "")
    is_cut = F.col(take) < F.col(whole)
    out = joined.withColumn("text", F.when(is_cut, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(is_cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: one row (doc_id, start, n_tokens, ids_crc32) a document and use.

    A null or empty text is its end id alone; rows that repeat each have a place; null ids come first; a very long text is one document; an
    empty table gives no rows. Other columns are left out.
    """
    return read_token_files(spark, write_token_files(docs, Q.tokenizer_path(), Q.END_ID)).withColumnRenamed("id", "doc_id")


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name
