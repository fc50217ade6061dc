"""Tokens: runs of ASCII letters and digits, lower-cased and stemmed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemming import stem

WORD = "[A-Za-z0-9]+"


def raw_words(text: Column) -> Column:
    """Words in order, case kept: every other character separates. A null text has none.

    Lower-casing comes after the cut: lower-casing first would turn some non-ASCII letters into ASCII ones.
    """
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def words(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, word): every word in lower case with its ordinal from 0."""
    return corpus.select(F.col(id_col), F.posexplode(raw_words(F.col(text_col))).alias("pos", "w")).select(id_col, "pos", F.lower("w").alias("word"))


def stem_map(found: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, term) of the distinct words: each is stemmed once, whatever the number of its occurrences."""
    return found.select(F.col(word_col).alias("word")).distinct().select("word", stem(F.col("word")).alias("term"))


def tokens(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, term): the stemmed token stream."""
    found = words(corpus, id_col, text_col)
    return found.join(stem_map(found), "word").select(id_col, "pos", "term")


def query_words(text: str) -> list[str]:
    """Words of a query string, lower-cased, by the same rule."""
    return [w.lower() for w in re.findall(WORD, text)]
