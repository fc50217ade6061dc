"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import alnum_words, binary_column, materialize

WINDOW = 10
#: UTF-8 bytes of benchmark texts whose windows each worker holds as they are; larger benchmarks are searched by hashed tables first.
BLOCK_BYTES = 1 << 20
#: log2 of the slots of the hashed shift table (a byte each) and of the bits of its suffix table: 4 MB each, whatever the benchmark's
#: size; and the tasks that fill such tables, which are the rows that the driver merges.
SHIFT_BITS, SUFFIX_BITS, SIEVE_PARTS = 22, 25, 8

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class WuManber:
    """Search for many word sequences of one length m.

    The text is read through the block of its last two words: the shift table says how far the search can move on
    before a pattern could end there. Where it says 0, the bucket of the longer suffix names the patterns to compare.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.block, self.suffix = m, min(2, m), min(4, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets[p[-self.suffix :]].append((list(p), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each occurrence, by start."""
        m, block, suffix, default, shift, buckets = self.m, self.block, self.suffix, self.default, self.shift.get, self.buckets
        n, i = len(words), m
        while i <= n:
            step = shift(tuple(words[i - block : i]), default)
            if step:
                i += step
                continue
            found = buckets.get(tuple(words[i - suffix : i]))
            if found:
                here = words[i - m : i]
                for pattern, items in found:
                    if pattern == here:
                        yield i - m, items
            i += 1


class Matcher:
    """Windows of benchmark items, by length: `window` words, or the whole item where it has fewer."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            words = tuple(alnum_words(text))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_length[size][words[i : i + size]].add(name)
        self.searches = [WuManber(p, m) for m, p in by_length.items()]

    def hits(self, text: bytes) -> dict:
        words = alnum_words(text)
        found, items = [], set()
        for search in self.searches:
            for start, names in search.search(words):
                found.append((start, start + search.m))
                items |= names
        spans = merge(found)
        return {"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)}


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict = {}


def _matcher(key: str, items: list[tuple[str, bytes]], window: int) -> Matcher:
    """One set of tables for a worker at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items, window)
    return _BUILT[key]


def _search(docs: DataFrame, items: list[tuple[str, bytes]], window: int, text_col: str, hits_col: str) -> DataFrame:
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = T.StructType([*docs.schema.fields, T.StructField(hits_col, HITS)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(HITS)
        matcher = _matcher(key, shared.value, window)
        for batch in batches:
            found = [matcher.hits(x.as_py()) for x in binary_column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, hits_col])

    return docs.mapInArrow(run, schema)


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, hits_col: str = "hits", block_bytes: int = BLOCK_BYTES, shift_bits: int = SHIFT_BITS) -> DataFrame:
    """docs with all its columns and one more, hits: struct(n_words, n_hit, spans, items).

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is `window` consecutive
    words of an item, or the whole item where it has fewer words; items without words, null texts and null item ids
    match nothing. hits.spans is the union of all occurrences in word positions (end exclusive), n_hit the words they
    cover, items the distinct ids (as strings, sorted) with an occurring window. A null or empty text has no words
    and no hits; repeated rows get equal hits; equal windows of several items count for each of them. hits_col must not
    be a column of docs; other columns can have any name.

    A benchmark of up to block_bytes is searched with tables of its windows in every worker: documents are read once and nothing is shuffled.
    A larger one is searched by hashed tables of fixed size (see Sieve), in one pass over documents whatever its size; what the tables
    let through is joined to the benchmark's windows by window hash and compared word by word. Texts that are hit are joined back by text hash.
    Documents are never read more than twice, and only texts with hits, or candidates of them, are written or shuffled before that join.
    """
    if hits_col in docs.columns:
        raise ValueError(f"docs already has a column {hits_col}")
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= block_bytes:
        items = sorted((r[0], r[1].encode("utf-8", "surrogatepass")) for r in bench.distinct().collect())
        return _search(docs, items, window, text_col, hits_col)

    per_text = _hits_of_large(docs.select(F.col(text_col).alias("text")), bench.distinct(), window, shift_bits)
    words = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))).cast("long")
    names = docs.columns  # docs may have columns named like those of per_text
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), F.sha2(F.col(text_col), 256).alias("__key"), words.alias("__words"))
    joined = keyed.join(per_text, "__key", "left")
    hits = F.struct(
        F.col("__words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(HITS["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.select("__row.*", hits.alias(hits_col))


class Sieve:
    """Wu-Manber tables of fixed size over hashed words, for windows of all lengths at once.

    shift holds, by the hash of a length and the last two words, how far the search can move on before a window of that length could
    end; suffix has a bit by the hash of a length and its last four words. Both err only towards a false candidate, however many windows
    fall into a slot. Tables of parts of a benchmark are merged by merge().
    """

    NEVER = 255

    def __init__(self, shift_bits: int = SHIFT_BITS, suffix_bits: int = SUFFIX_BITS):
        self.shift = np.full(1 << shift_bits, self.NEVER, dtype=np.uint8)
        self.suffix = np.zeros(1 << (suffix_bits - 3), dtype=np.uint8)
        self.lengths: set[int] = set()

    def _slots(self, gram: np.ndarray, m: int, size: int) -> np.ndarray:
        return ((gram + np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def add(self, hashes: np.ndarray, m: int) -> None:
        """All windows of m words of an item."""
        block = min(2, m)
        self.lengths.add(m)
        pairs = self._slots(_grams(hashes, block), m, len(self.shift))
        for last in range(block, m + 1):  # blocks that end at word `last` of some window
            np.minimum.at(self.shift, pairs[last - block : len(hashes) - m + last - block + 1], min(self.NEVER - 1, m - last))
        bits = self._slots(_grams(hashes, min(4, m))[m - min(4, m) :], m, len(self.suffix) * 8)
        np.bitwise_or.at(self.suffix, bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))

    def merge(self, lengths: set[int], shift: np.ndarray, suffix: np.ndarray) -> None:
        self.lengths |= lengths
        np.minimum(self.shift, shift, out=self.shift)
        np.bitwise_or(self.suffix, suffix, out=self.suffix)

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(m, starts) of the places at which a window of m words may stand."""
        for m in sorted(self.lengths):
            n, block, tail = len(hashes), min(2, m), min(4, m)
            if n < m:
                continue
            steps = np.minimum(self.shift[self._slots(_grams(hashes, block), m, len(self.shift))], min(self.NEVER, m - block + 1)).tolist()
            ends, i = [], m
            while i <= n:
                step = steps[i - block]
                if not step:
                    ends.append(i)
                i += step or 1
            if ends:
                at = np.array(ends, dtype=np.int64)
                bits = self._slots(_grams(hashes, tail)[at - tail], m, len(self.suffix) * 8)
                at = at[(self.suffix[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)]
                if len(at):
                    yield m, at - m


def _grams(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of m words, in order."""
    out = np.zeros(max(0, len(hashes) - m + 1), dtype=np.uint64)
    for k in range(m):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + len(out)]
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known = {w: xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _hits_of_large(texts: DataFrame, bench: DataFrame, window: int, shift_bits: int) -> DataFrame:
    """(__key, n_hit, spans, items) of the texts (text) with an occurrence of a window of bench (item, text); __key is the text's SHA-256."""
    spark = texts.sparkSession

    def to_arrow():
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(HITS["spans"].dataType)

    def sieves(batches):
        import pyarrow as pa

        made = Sieve(shift_bits)
        for batch in batches:
            for x in binary_column(batch, "text"):
                words = alnum_words(x.as_py())
                if words:
                    made.add(_word_hashes(words), min(window, len(words)))
        yield pa.RecordBatch.from_pydict({"lengths": pa.array([sorted(made.lengths)], pa.list_(pa.int32())), "shift": [made.shift.tobytes()], "suffix": [made.suffix.tobytes()]})

    sieve = Sieve(shift_bits)
    for r in bench.select("text").coalesce(SIEVE_PARTS).mapInArrow(sieves, "lengths array<int>, shift binary, suffix binary").collect():
        sieve.merge(set(r["lengths"]), np.frombuffer(r["shift"], dtype=np.uint8), np.frombuffer(r["suffix"], dtype=np.uint8))
    shared = spark.sparkContext.broadcast(sieve)

    def windows(batches):
        import pyarrow as pa

        for batch in batches:
            for item, x in zip(batch.column("item").to_pylist(), binary_column(batch, "text"), strict=True):
                words = alnum_words(x.as_py())
                m = min(window, len(words))
                found = sorted({b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)}) if m else []
                if found:
                    yield pa.RecordBatch.from_pydict({"w": pa.array(found, pa.binary()), "item": pa.array([item] * len(found), pa.string())})

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            for key, x in zip(batch.column("__key").to_pylist(), binary_column(batch, "text"), strict=True):
                words, found = alnum_words(x.as_py()), {}
                for m, starts in shared.value.candidates(_word_hashes(words)):
                    for s in starts.tolist():
                        found.setdefault(b" ".join(words[s : s + m]), []).append(s)
                if found:
                    ends = [[s + w.count(b" ") + 1 for s in v] for w, v in found.items()]
                    spans = [[{"start": a, "end": b} for a, b in merge(zip(v, e, strict=True))] for v, e in zip(found.values(), ends, strict=True)]
                    yield pa.RecordBatch.from_pydict({"__key": [key] * len(found), "w": pa.array(list(found), pa.binary()), "spans": pa.array(spans, to_arrow())})

    span = HITS["spans"].dataType.simpleString()
    # one row for each window and item, as the benchmark has them; equal words are the same window, so the join by words is the comparison
    known = bench.mapInArrow(windows, "w binary, item string").distinct()
    distinct = texts.where("text is not null").select(F.sha2("text", 256).alias("__key"), "text")
    candidates = materialize(distinct.mapInArrow(places, f"__key string, w binary, spans {span}"), "decontaminate-candidates").dropDuplicates(["__key", "w"])
    hit = candidates.join(known, "w")
    per_text = hit.groupBy("__key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    def union(batches):  # the spans of a text are no more than its words
        import pyarrow as pa

        kind = to_arrow()
        for batch in batches:
            spans = [merge((s["start"], s["end"]) for s in found) for found in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("__key"), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), batch.column("items"),
            ], ["__key", "n_hit", "spans", "items"])

    return materialize(per_text.mapInArrow(union, f"__key string, n_hit long, spans {span}, items array<string>"), "decontaminate-hits")
