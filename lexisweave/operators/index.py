"""The positional inverted index as tables: docs, postings, vocabulary and corpus statistics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..functions.text import WORD, words
from ..sources.scratch import scratch_dir


def postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions): occurrences of each stem in each document, positions ascending.

    Words are stemmed where they are cut, without a vocabulary and its join, and gathered by document and stem: a document's words are in one
    task, so the rows of the aggregate's map side are already whole, and a corpus that is partitioned by id (sources.corpus.spread)
    isn't shuffled here. A frequent word is one small row a document.
    """
    found = words(corpus, id_col, text_col).select(id_col, stem(F.col("word")).alias("term"), "pos")
    grouped = found.groupBy(id_col, "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", id_col, F.size("positions").alias("tf"), "positions")


def doc_lengths(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without their text, with their length in words (0 for an empty text)."""
    return corpus.withColumn("length", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0))).drop(text_col)


def vocabulary(found: DataFrame) -> DataFrame:
    """(term, df, cf) of postings: documents and occurrences of each term."""
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def statistics(docs: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, avg_len) in one row; an empty corpus has an average of 1."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("avg_len"))


@dataclass(frozen=True)
class Index:
    """Tables of an index; each can be a file or a plan."""

    docs: DataFrame  # doc_id, url, title, length
    postings: DataFrame  # term, doc_id, tf, positions
    vocab: DataFrame  # term, df, cf
    stats: DataFrame  # n_docs, n_tokens, avg_len

    @classmethod
    def build(cls, corpus: DataFrame) -> Index:
        """Lazy index of corpus (doc_id, url, title, text)."""
        found = postings(corpus)
        docs = doc_lengths(corpus)
        return cls(docs, found, vocabulary(found), statistics(docs))

    def save(self, path: str, partitions: int | None = None) -> Index:
        """Write the tables under path and return them as read back.

        Postings are ranged by term, and by document within very frequent ones, and sorted, so that a term's rows are few row groups
        that file statistics find. They are written once as they come, as the bounds of ranges take a second look at all rows, which
        would else cut and stem all words again. Vocabulary and statistics are taken from the written postings and docs; docs are written meanwhile.
        """
        spark = self.docs.sparkSession

        def write_docs() -> None:
            self.docs.write.mode("overwrite").parquet(f"{path}/docs")
            statistics(spark.read.parquet(f"{path}/docs")).write.mode("overwrite").parquet(f"{path}/stats")

        with ThreadPoolExecutor(1) as pool:
            docs_written = pool.submit(write_docs)
            unsorted = scratch_dir(spark, "postings")
            self.postings.write.parquet(unsorted)
            found = spark.read.schema(self.postings.schema).parquet(unsorted)
            ranged = found.repartitionByRange(partitions, "term", "doc_id") if partitions else found.repartitionByRange("term", "doc_id")
            ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
            vocabulary(spark.read.parquet(f"{path}/postings").select("term", "tf")).write.mode("overwrite").parquet(f"{path}/vocab")
            docs_written.result()
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "vocab", "stats")))
