"""Corpus sources: tables, text files, tab-separated lines and query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(documents: DataFrame) -> DataFrame:
    """(doc_id, url, title, text) of a documents table; rows without text are left out, as in a scan for parsed documents."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), "text")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A file scan with at least as many partitions as there are cores: a few large row groups would else be cut into words by a few tasks.

    Larger inputs have more splits than that and stay as they are. Only for plans without a shuffle, whose partitions are known beforehand.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, id_col) if scan._jdf.rdd().getNumPartitions() < cores else scan


def read_text_dir(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """(url, title, text) of a folder of .txt articles: the title is the file's name with spaces for underscores. Empty files have no row."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"), name.alias("name"))
    return found.select(F.concat(F.lit(base_url), "name").alias("url"), F.replace("name", F.lit("_"), F.lit(" ")).alias("title"), "text")


def text_dir_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of the non-empty .txt articles of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the empty .txt files of a folder, which file scans pass over; listed as a scan lists its files, on the driver."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.size == 0 and f.extension == "txt"]
    return spark.createDataFrame([(x,) for x in found], "path string")


def import_text_dir(spark: SparkSession, path: str, now: int, base_url: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    """Saved documents (as a crawl saves them) of a folder of .txt articles, empty ones included; bytes that aren't UTF-8 are replaced, and line ends are \\n."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "\r\n?", "\n")
    every = files.select(F.col("_metadata.file_name").alias("file"), text.alias("text")).unionByName(_empty_files(spark, path).select(F.substring_index("path", "/", -1).alias("file"), F.lit("").alias("text")))
    found = every.select(F.regexp_replace("file", r"\.txt$", "").alias("name"), "text")
    time = F.lit(now).cast("long")
    return found.select(
        F.concat(F.lit(base_url), "name").alias("url"), F.lit("wikipedia").alias("source"), F.col("text").alias("raw_content"), F.sha2("text", 256).alias("raw_sha256"), F.col("text").alias("parsed_text"),
        F.replace("name", F.lit("_"), F.lit(" ")).alias("title"), time.alias("fetched_at"), time.alias("checked_at"), F.lit("wikipedia_api").alias("method"))


def corpus_size(spark: SparkSession, path: str, sample: int = 1000) -> DataFrame:
    """(files, bytes, sample_files, sample_bytes) of the .txt articles of a folder, empty ones included, without reading them; the sample is the first ones by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length").unionByName(_empty_files(spark, path).select("path", F.lit(0).cast("long").alias("length")))
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    first = files.orderBy(F.substring_index("path", "/", -1)).limit(sample).agg(F.count("*").alias("sample_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("sample_bytes"))
    return total.crossJoin(F.broadcast(first))  # one row each


def read_config(path: str) -> dict:
    """Settings of a YAML file, {} where it holds no mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    return found if isinstance(found, dict) else {}


def parse_tsv(lines: DataFrame, col: str = "value") -> DataFrame:
    """(url, title, body) of lines with at least two tabs; other lines are dropped."""
    parts = F.split(F.col(col), "\t", 3)
    return lines.where(F.size(parts) == 3).select(parts[0].alias("url"), parts[1].alias("title"), parts[2].alias("body"))


def to_tsv(docs: DataFrame) -> DataFrame:
    """(value): url, title and text with separators as spaces, joined by tabs."""
    clean = [F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\n\r]", " ") for c in ("url", "title", "text")]
    return docs.select(F.concat_ws("\t", *clean).alias("value"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a file with one query a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")
