"""Search: queries compiled to one aggregation over the postings of their terms."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import stem
from ..functions.text import query_words
from ..plans import query as Q
from .index import Index

LIMIT = 50
#: Words of a batch of queries that are weighed on the driver.
BATCH_WORDS = 10_000
#: Decimals of a score: documents whose scores only differ by the order of additions are ties, and ties go by id.
DIGITS = 9


class SearchEngine:
    """Boolean, phrase, proximity and free-text search over an index.

    All parts of a query are answered by one scan of the postings (filtered to its terms), one aggregate by document and
    one condition on its row. Documents that hold none of the terms are only looked at by queries they can match.
    """

    def __init__(self, index: Index):
        self.index = index
        self.spark = index.docs.sparkSession
        self._n: int | None = None
        self._stems: dict[str, str] = {}

    @property
    def n_docs(self) -> int:
        if self._n is None:
            self._n = self.index.stats.first()["n_docs"]
        return self._n

    def stems(self, words: list[str]) -> dict[str, str]:
        """Stem of each distinct word of a query, by the same expression as the index's; as rows of literals it is folded on the driver, without a job."""
        if len(self._stems) > 100_000:
            self._stems.clear()
        if new := sorted(set(words) - self._stems.keys()):
            rows = self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}')" for w in new) + " AS t(word)")  # words are letters and digits
            self._stems.update((r["word"], r["term"]) for r in rows.select("word", stem(F.col("word")).alias("term")).collect())
        return {w: self._stems[w] for w in words}

    def df(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of the terms that the vocabulary has; as many rows as the query has terms."""
        return {r["term"]: r["df"] for r in self.index.vocab.where(F.col("term").isin(sorted(set(terms)))).select("term", "df").collect()} if terms else {}

    def lookup(self, word: str) -> DataFrame:
        """(doc_id) of a word; positions aren't read."""
        return self.term_postings(word).select("doc_id")

    def term_postings(self, word: str) -> DataFrame:
        """Postings of a word's stem."""
        asked = query_words(word)[:1]
        return self.index.postings.where(F.col("term") == self.stems(asked)[asked[0]] if asked else F.lit(False))

    def matches(self, query: str) -> DataFrame:
        """(doc_id, score) of all documents that the query matches, in no order. score is 0 for phrases alone."""
        plan = Q.plan(query)
        words = Q.words_of(plan.ast) if plan.ast is not None else []
        stems = self.stems([*words, *plan.scored])
        scored: dict[str, int] = {}
        for w in plan.scored:
            scored[stems[w]] = scored.get(stems[w], 0) + 1
        frequency = self.df([*stems.values()])
        terms = sorted(frequency)
        number = {t: i for i, t in enumerate(terms)}
        phrased = {stems[w] for w in _phrase_words(plan.ast)}

        here = self.index.postings.where(F.col("term").isin(terms)) if terms else self.index.postings.where(F.lit(False))
        needed = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for t, i in number.items()]
        needed += [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{number[t]}") for t in sorted(phrased & number.keys())]
        rows = here.groupBy("doc_id").agg(*needed) if needed else here.select("doc_id")
        if plan.ast is not None and Q.matches_nothing(plan.ast):
            rows = self.index.docs.select("doc_id").join(rows, "doc_id", "left")

        score = F.lit(0.0)
        for t, i in number.items():
            if t in scored:
                weight = scored[t] * math.log(self.n_docs / frequency[t])
                score = score + F.when(F.col(f"tf{i}").isNotNull(), (1 + F.log(F.col(f"tf{i}").cast("double"))) * weight).otherwise(0.0)
        condition = self._condition(plan.ast, stems, number) if plan.ast is not None else reduce(lambda a, b: a | b, [F.col(f"tf{number[t]}").isNotNull() for t in scored if t in number], F.lit(False))
        return rows.where(condition).select("doc_id", F.round(score, DIGITS).alias("score"))

    def _condition(self, node, stems: dict[str, str], number: dict[str, int]) -> Column:
        if isinstance(node, Q.Not):
            return ~self._condition(node.item, stems, number)
        if isinstance(node, Q.And):
            return reduce(lambda a, b: a & b, [self._condition(x, stems, number) for x in node.items])
        if isinstance(node, Q.Or):
            return reduce(lambda a, b: a | b, [self._condition(x, stems, number) for x in node.items])
        if isinstance(node, Q.Term):
            t = stems[node.word]
            return F.col(f"tf{number[t]}").isNotNull() if t in number else F.lit(False)
        if isinstance(node, Q.Phrase):
            terms = [stems[w] for w in node.words]
            if any(t not in number for t in terms):
                return F.lit(False)
            return in_sequence([F.col(f"p{number[t]}") for t in terms], node.distance)
        return F.lit(False)

    def total(self, query: str) -> int:
        """Number of documents that a query matches."""
        return self.matches(query).count()

    def search(self, query: str, limit: int = LIMIT, offset: int = 0, ranked: bool | None = None) -> DataFrame:
        """(rank, doc_id, score, title, url) of the matches from offset on, at most limit, by descending score and then id.

        Queries of phrases alone are in id order unless ranked. ranked=False puts any query in id order.
        """
        return self._top(query, self.matches(query), limit, offset, ranked)

    def _top(self, query: str, found: DataFrame, limit: int, offset: int, ranked: bool | None) -> DataFrame:
        plan = Q.plan(query)
        if ranked and plan.mode == "quotes":
            words = " ".join(w for t in Q.lex(query) if t.kind != "op" for w in Q.query_words(t.text))
            scores = self.matches(words).withColumnRenamed("score", "s")
            found = found.select("doc_id").join(scores, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("score"))
        by_score = ranked if ranked is not None else plan.mode != "quotes"
        order = [F.desc("score"), F.col("doc_id")] if by_score else [F.col("doc_id")]
        top = found.orderBy(*order).limit(offset + limit)
        # at most offset + limit rows from here on
        numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)
        return numbered.join(self.index.docs.select("doc_id", "title", "url"), "doc_id").select("rank", "doc_id", "score", "title", "url")

    def search_page(self, query: str, page: int = 1, per_page: int = LIMIT) -> tuple[DataFrame, bool]:
        """Rows of a page from 1, and whether there is another: the page and one row more are fetched by one job."""
        found = self.search(query, per_page + 1, max(0, page - 1) * per_page)
        rows = sorted(found.collect())
        return self.spark.createDataFrame(rows[:per_page], found.schema), len(rows) > per_page

    def counted(self, query: str, limit: int = LIMIT, ranked: bool | None = None) -> tuple[int, list[Row]]:
        """Number of matches and the first rows of search, from one evaluation of the query's matches."""
        found = self.matches(query).persist()
        try:
            return found.count(), sorted(self._top(query, found, limit, 0, ranked).collect())
        finally:
            found.unpersist()

    def batch_free_text(self, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
        """(query_id, rank, doc_id, score): the top matches of each free-text query of queries (query_id, query), in one job.

        Postings are read once for the whole batch. Up to BATCH_WORDS words are weighed on the driver, and only the row groups of their
        terms are read; more are joined to the vocabulary and the postings.
        """
        words = F.regexp_extract_all("query", F.lit("[A-Za-z0-9]+"), F.lit(0))
        asked = queries.select("query_id", F.explode(words).alias("w")).select("query_id", F.lower("w").alias("word"))
        postings = self.index.postings.select("term", "doc_id", "tf")
        some = asked.limit(BATCH_WORDS + 1).collect()
        if len(some) <= BATCH_WORDS:
            stems = self.stems([r["word"] for r in some])
            frequency = self.df([*stems.values()])
            times = Counter((r["query_id"], stems[r["word"]]) for r in some if stems[r["word"]] in frequency)
            rows = [(q, t, c * math.log(self.n_docs / frequency[t])) for (q, t), c in times.items()]
            weights = F.broadcast(self.spark.createDataFrame(rows, T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])))
            postings = postings.where(F.col("term").isin(sorted(frequency))) if frequency else postings.where(F.lit(False))
        else:
            weights = asked.groupBy("query_id", stem(F.col("word")).alias("term")).agg(F.count("*").alias("qtf")).join(self.index.vocab.select("term", "df"), "term")
            weights = weights.crossJoin(F.broadcast(self.index.stats.select("n_docs"))).select("query_id", "term", (F.col("qtf") * F.log(F.col("n_docs") / F.col("df"))).alias("weight"))
        scored = postings.join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum((1 + F.log(F.col("tf").cast("double"))) * F.col("weight")), DIGITS).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


def _phrase_words(node) -> list[str]:
    if isinstance(node, Q.Phrase):
        return list(node.words)
    if isinstance(node, Q.Not):
        return _phrase_words(node.item)
    if isinstance(node, Q.And | Q.Or):
        return [w for x in node.items for w in _phrase_words(x)]
    return []


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _numbered(positions: Column, word: int) -> Column:
    return F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(-word).alias("k")))


def in_sequence(positions: list[Column], distance: int | None) -> Column:
    """Whether the positions hold p1 < p2 < ... with each one after the last (distance None) or all within distance. A missing list is false.

    Within a distance, all positions are gone through once in order: for each word the latest start of a sequence that has come as far as it is
    kept, and a last word ends the nearest sequence. A position that several words share counts for the last of them first, as a sequence
    takes a position once.
    """
    first, *rest = positions
    if distance is None:
        starts = reduce(F.array_intersect, [_moved(q, k) for k, q in enumerate(rest, 1)], first)
        return F.coalesce(F.size(starts) > 0, F.lit(False))
    n = len(positions)
    if n == 1:
        return F.coalesce(F.size(first) > 0, F.lit(False)) & F.lit(distance >= 0)
    events = F.sort_array(F.concat(*[_numbered(p, k) for k, p in enumerate(positions)]))
    none = F.lit(None).cast("int")
    start = F.struct(*[none.alias(f"s{k}") for k in range(n - 1)], F.lit(False).alias("found"))

    def step(acc: Column, e: Column) -> Column:
        here = lambda k: e["k"] == -k
        begun = [F.when(here(k), e["at"] if k == 0 else acc[f"s{k - 1}"]).otherwise(acc[f"s{k}"]).alias(f"s{k}") for k in range(n - 1)]
        ended = F.coalesce(here(n - 1) & (e["at"] - acc[f"s{n - 2}"] <= distance), F.lit(False))
        return F.struct(*begun, (acc["found"] | ended).alias("found"))

    return F.coalesce(F.aggregate(events, start, step, lambda acc: acc["found"]), F.lit(False))
