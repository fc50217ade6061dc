"""Language ID: TF-IDF n-gram vectors, several centroids per language, and rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import hashed_ngrams, spherical_kmeans, unit_rows
from .shared import binary_column

#: n-gram lengths in bytes, log2 of the vector's size, centroids per language.
SIZES, BITS, CENTROIDS = (2, 3, 4), 13, 4
#: The fit reads about this many labelled rows of a language at most, this many in all, and in any case this many of every language.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 400, 8000, 8
#: A text is rejected if its nearest centroid is farther than all but this share of that centroid's own rows, by this margin.
QUANTILE, MARGIN = 0.01, 0.05

#: ASCII other than letters becomes a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text, lower-cased, with words apart by one space and digits and ASCII punctuation left out."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return hashed_ngrams(np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8), SIZES, BITS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    nearest: np.ndarray  # least cosine that isn't rejected, of each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language or und, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if len(self.languages) and has_letter(t)]
        for at in range(0, len(known), 64):
            part = known[at : at + 64]
            cosines = self.vectors(np.stack([features(texts[i]) for i in part])) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            for i, row, b in zip(part, cosines, best, strict=True):
                score = float(min(1.0, max(0.0, row[b])))
                out[i] = (self.languages[b], score, bool(row[b] < self.nearest[b]))
        return out


def fit(samples: dict[str, np.ndarray]) -> LanguageModel:
    """A model of count matrices by language."""
    names = sorted(k for k, m in samples.items() if len(m))
    size = 1 << BITS
    if not names:
        return LanguageModel([], np.ones(size, np.float32), np.zeros((0, size), np.float32), np.zeros(0, np.float32))
    seen = sum((samples[n] > 0).sum(axis=0) for n in names)
    total = sum(len(samples[n]) for n in names)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    languages, centroids, nearest = [], [], []
    for n in names:
        rows = unit_rows(np.log1p(samples[n]).astype(np.float32) * idf)
        found = spherical_kmeans(rows, CENTROIDS)
        cosines = rows @ found.T
        own = np.argmax(cosines, axis=1)
        for c in range(len(found)):
            mine = cosines[own == c, c]
            languages.append(n)
            centroids.append(found[c])
            nearest.append(float(np.quantile(mine, QUANTILE)) - MARGIN if len(mine) else 0.0)
    return LanguageModel(languages, idf, np.stack(centroids), np.array(nearest, np.float32))


def train(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    Every language is learned. Its sample is every text whose hash is under a share of the language's texts, so it is spread over all of
    them, the same at every run, and takes a text that repeats once; with more languages it shrinks, to LEAST_ROWS or so. Distinct texts are
    counted (to a few percent) over all rows; texts stay on the executors, which send count vectors of fixed size.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col, F.lit("language sample")).alias("h"))
    totals = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()  # one row a language
    if not totals:
        return fit({})
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, ROWS // len(totals)))
    share = F.create_map(*[F.lit(x) for r in sorted(totals) for x in (r["lang"], min(1.0, each / r["texts"]))])
    sample = rows.where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < F.element_at(share, F.col("lang")))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            hashes, langs, slots, values = [], [], [], []
            for h, lang, x in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), binary_column(batch, "text"), strict=True):
                text = x.as_py().decode("utf-8", "replace")
                if has_letter(text):
                    counts = features(text)
                    at = np.flatnonzero(counts)
                    hashes.append(h), langs.append(lang), slots.append(at.astype(np.int32)), values.append(counts[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(langs, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["h", "lang", "slots", "counts"])

    vectors = sample.mapInArrow(count, "h long, lang string, slots array<int>, counts array<int>").dropDuplicates(["lang", "h"])
    found: dict[str, list] = {}
    for r in sorted(vectors.collect(), key=lambda r: (r["lang"], r["h"])):
        row = np.zeros(1 << BITS, np.float32)
        row[r["slots"]] = r["counts"]
        found.setdefault(r["lang"], []).append(row)
    return fit({k: np.stack(v[: 2 * each]) for k, v in found.items()})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", result_col: str = "language") -> DataFrame:
    """docs with one more column: struct(lang, score, rejected).

    lang is the language of the nearest centroid by cosine, score that cosine (0 to 1), rejected whether the text is farther
    from it than nearly all rows of the fit; a null text, one without letters, or any text for a model without languages
    is ("und", 0, true). Ties go to the language first by name. Only the text decides. Repeated rows get equal
    results, an empty table gives an empty one; a very long text is one vector like any other. result_col must not be a column of docs; nothing
    is shuffled. The broadcast model has CENTROIDS vectors of fixed size for each language.
    """
    if result_col in docs.columns:
        raise ValueError(f"docs already has a column {result_col}")
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            found = []
            column = binary_column(batch, text_col)
            for at in range(0, len(column), 256):
                texts = [x.decode("utf-8", "replace") for x in column[at : at + 256].to_pylist()]
                found += [{"lang": a, "score": b, "rejected": c} for a, b, c in shared.value.predict(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, result_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(result_col, kind)]))
