"""Corpus upkeep over streams: fetched documents merged into a stored table batch by batch, and running term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stemming import stem
from ..functions.text import raw_words
from ..operators.crawl import upsert


def stream_upsert(fetched: DataFrame, path: str, checkpoint: str, key: str = "url", compact_every: int = 100, **trigger) -> StreamingQuery:
    """Merge a stream of fetched documents (url, raw_sha256, fetched_at, checked_at, ...) into a table under path, read by current().

    A batch writes only the rows of its own keys, merged with what the table holds of them, as path/delta=<batch id>; every compact_every
    batches the whole table is written as path/base=<batch id>. A batch that is run again after a failure starts from the same rows and writes
    the same ones, so nothing is merged twice.
    """
    schema = fetched.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, below=batch_id, key=key)
        stored = before if before is not None else spark.createDataFrame([], schema)
        whole = batch_id % compact_every == compact_every - 1
        if not whole:
            stored = stored.join(batch.select(key).distinct(), key, "left_semi").select(*schema.names)
        upsert(stored, batch, key).write.mode("overwrite").parquet(f"{path}/{'base' if whole else 'delta'}={batch_id:012d}")

    return fetched.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, below: int | None = None, key: str = "url") -> DataFrame | None:
    """The table of stream_upsert (before a batch), or None: of each key the newest row in the last base and the deltas after it. Only complete versions are read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions: dict[int, str] = {}
    for status in fs.listStatus(root):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in ("base", "delta") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")) and (below is None or int(number) < below):
            versions[int(number)] = f"{path}/{kind}={number}"
    since = max((n for n, p in versions.items() if p.rpartition("/")[2].startswith("base=")), default=-1)
    read = [p for n, p in sorted(versions.items()) if n >= since]
    if not read:
        return None
    rows = spark.read.parquet(*read)
    if len(read) == 1:
        return rows
    number = F.regexp_extract(F.col("_metadata.file_path"), "/(?:base|delta)=([0-9]+)/", 1)
    return rows.select(key, F.struct(*rows.columns).alias("r"), number.alias("v")).groupBy(key).agg(F.max_by("r", "v").alias("r")).select("r.*")


def term_counts(documents: DataFrame, time_col: str, window: str = "1 hour", delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """(start, end, term, count) of a stream of documents: occurrences of each stem in windows of event time, late rows up to delay counted."""
    words = documents.withWatermark(time_col, delay).select(F.col(time_col), F.explode(raw_words(F.col(text_col))).alias("w")).select(time_col, stem(F.lower("w")).alias("term"))
    return words.groupBy(F.window(time_col, window).alias("span"), "term").count().select("span.start", "span.end", "term", "count")
