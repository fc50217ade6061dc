"""Near copies at a stated shingle similarity: SimHash tables and bit-sliced comparison find most, MinHash bands the rest; the shingle sets themselves decide."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import binary_column, materialize
from .simhash import fingerprint_links, majority, sampled_tables

#: Words of a shingle, and the least Jaccard similarity of two shingle sets that links them, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Candidates share the ROWS minima of one of BANDS bands, the same at every table size: a pair at exactly 0.8 shares none with
#: probability (1 - 0.8 ** 5) ** 32 = 3e-6, one at 0.85 with 2e-8.
ROWS, BANDS, SEED = 5, 32, 42
#: SimHash fingerprints of 64 * WORDS bits of the shingle set. Sets of similarity 0.8 (the cosine 2 * 0.8 / 1.8 is an angle of 0.151 pi) differ
#: in 39 of 256 bits with a deviation of 6, so the radius takes in all but 2 in 10,000 of them that meet in one of TABLES sampled tables. By formula
#: those are 96 % at similarity 0.95, 80 % at 0.9 and 43 % at 0.8; the others are left to the bands.
WORDS, RADIUS, TABLES = 4, 60, 16
#: Bands of the passes after SimHash: they look only at buckets that still hold several components.
PASSES = ((0, BANDS),)
#: Links of one node that a task checks; those of a node with more are dealt out.
SHARE = 1 << 8
FINGERPRINT = [f"f{w}" for w in range(WORDS)]
#: Nodes of one bucket that a task compares with each other; larger buckets are dealt out as pairs of such chunks.
CHUNK = 1 << 12

_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles (the whole sequence where there are fewer words); empty without words."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # bytes: A-Z only, and white space is \x09-\x0D and \x20
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in found)]
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)], dtype=np.uint64))


def band_keys(values: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band, from the minima of its rows; none for an empty set."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1 << 11):
        np.minimum(least, (_FACTORS[:, None] * values[None, at : at + (1 << 11)] + _ADDENDS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def similar_links(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, similar: tuple[int, int] = SIMILAR) -> Iterable[tuple[int, int]]:
    """Positions (i, j) of links that connect all sets of the bucket that are similar; pairs already in one root aren't compared.

    Sets of side 0 are compared with each other, those of side 1 only with those of side 2.
    """
    top, bottom = similar
    roots, sizes = roots.copy(), np.array([len(s) for s in sets])
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        fits = (roots[rest] != roots[i]) & ((side[rest] != side[i]) | (side[i] == 0))
        fits &= np.minimum(sizes[rest], sizes[i]) * bottom >= np.maximum(sizes[rest], sizes[i]) * top
        rest, tile = rest[fits], 8
        while len(rest):
            now, rest = rest[:tile], rest[tile:]
            values = np.concatenate([sets[j] for j in now])
            at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
            shared = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes[now])[:-1]])
            for j in now[shared * bottom >= (sizes[i] + sizes[now] - shared) * top]:
                if roots[j] != roots[i]:
                    roots[roots == roots[j]] = roots[i]
                    yield i, int(j)
            rest, tile = rest[roots[rest] != roots[i]], min(512, tile * 4)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, hash, node, keys, f0, f1, ...) of each row: the hash of its text, the name of its shingle set, its band keys and its fingerprint."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in binary_column(batch, "text")]
            fps = np.array([majority(s, WORDS) for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array([xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), *[pa.array(fps[:, w].copy()) for w in range(WORDS)]],
                ["id", "hash", "node", "keys", *FINGERPRINT])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, ", ".join([f"id {kind}, hash string, node string, keys array<long>", *[f"{f} long" for f in FINGERPRINT]]))


def _sets(docs: DataFrame) -> DataFrame:
    """(node, values): the shingle set of each row as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(x.as_py()).tobytes() for x in binary_column(batch, "text")], pa.binary())], ["node", "values"])

    return docs.mapInArrow(run, "node string, values binary")


def _node_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, values): the shingle sets of the wanted (node distinct), written to the shared folder."""
    # rows that repeat id and text have one set; it is taken once
    texts = docs.join(wanted.join(nodes.select("node", "id", "hash"), "node"), ["id", "hash"]).select("node", "text")
    return materialize(_sets(texts).groupBy("node").agg(F.first("values").alias("values")), "near-sets")


def simhash_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between similar nodes (node, id, hash, f0, f1, ...) that SimHash finds: of fingerprints within RADIUS in the tables, those whose sets are similar.

    The comparison gives a spanning forest of the fingerprints' links, not all of them, so similar pairs may be missing here.
    """
    near = fingerprint_links(nodes.select("node", *FINGERPRINT), sampled_tables(RADIUS, WORDS, count=TABLES), RADIUS)
    pairs = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-simhash")
    sets = _node_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # a node with many links has a copy of its set for each SHARE of them, so they needn't meet in one task
    hubs = F.broadcast(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select("a", F.ceil(F.col("n") / SHARE).alias("parts")))
    dealt = pairs.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("long")).alias("part"))
    copies = sets.withColumnRenamed("node", "a").join(hubs, "a", "left").select("a", F.col("values").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b").join(copies, ["a", "part"]).select("a", "b", "x", "y")
    top, bottom = SIMILAR

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, other = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(shared * bottom >= (len(one) + len(other) - shared) * top)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a string, b string")


def _pass_links(docs: DataFrame, nodes: DataFrame, first: int, end: int, chunk: int) -> DataFrame:
    """(a, b): links that connect all similar nodes (node, id, hash, label, keys) that share one of these bands and have different labels."""
    keyed = nodes.select("node", "label", F.explode(F.slice("keys", first + 1, end - first)).alias("key"))
    named = F.xxhash64("label")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(named).alias("lo"), F.max(named).alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # buckets of the same nodes are compared once
    chosen = sizes.where("lo <> hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = materialize(keyed.join(chosen, "key"), "near-members")
    sets = _node_sets(docs, nodes, members.select("node").distinct())
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("node"), chunks)
    # a member of chunk c goes to the pairs (c, c) as side 0, (c, d > c) as side 1 and (d < c, c) as side 2
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda d: F.struct(F.least(own, d).alias("lo"), F.greatest(own, d).alias("hi"), F.when(d == own, 0).when(d > own, 1).otherwise(2).alias("side")))
    dealt = members.select("key", "node", "label", F.explode(pairs).alias("p")).select("key", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("p.side").alias("side"), "node", "label").join(sets, "node")
    ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "node")

    def links(rows):
        if len(rows) < 2:
            return
        numbers: dict[str, int] = {}
        roots = np.array([numbers.setdefault(r["label"], len(numbers)) for r in rows])
        sets = [np.frombuffer(r["values"], dtype=np.uint64) for r in rows]
        for i, j in similar_links(sets, roots, np.array([r["side"] for r in rows])):
            yield rows[i]["node"], rows[j]["node"]

    def run(batches):
        import pyarrow as pa

        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: (r["key"], r["lo"], r["hi"])):
            found = list(links(list(group)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], ["a", "b"])

    return ordered.mapInArrow(run, "a string, b string")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, hash, node, component): each row's id, MD5 of its text, shingle set and the least node of its group of near copies.

    Texts are cut as in simhash; their shingles count once each. Two rows link if the Jaccard similarity of their shingle sets is SIMILAR
    or more, as counted on the sets; texts without words are one set. Candidates are found by SimHash (see TABLES); those that it leaves
    share a band (see BANDS for the chance that a pair shares none). Rows with equal sets are one node, so copies are compared once; a node has a name of its own, whatever ids it has.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    rows = materialize(_texts(texts), "near-rows")
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("row"), F.first("keys").alias("keys"), *[F.first(f).alias(f) for f in FINGERPRINT])
    nodes = materialize(nodes.select("node", "row.id", "row.hash", "keys", *FINGERPRINT), "near-nodes")
    links = materialize(simhash_links(texts, nodes), "near-links")
    roots = connected_components(links)
    for first, end in PASSES:
        labelled = nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
        links = links.unionByName(materialize(_pass_links(texts, labelled, first, end, chunk), "near-links"))
        roots = connected_components(links)
    return rows.join(roots, "node", "left").select("id", "hash", "node", F.coalesce("root", "node").alias("component"))


def text_hash(text_col: str):
    """MD5 of a text, by which rows of one id are told apart; a null text has the empty hash."""
    return F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
