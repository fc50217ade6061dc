"""SimHash near-dedup: shingle fingerprints, block tables, and bit-sliced comparison within a radius."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import binary_column, materialize

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of one bucket that a task compares with each other; larger buckets are dealt out as pairs of such chunks.
CHUNK = 1 << 14
LANES = 64
#: Bits of a key of a sampled table.
KEY_BITS = 20
#: Odd constants that derive further words of a wide fingerprint from a shingle's hash.
MIXERS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else hashes of them that are as good as independent."""
    if not word:
        return hashes
    x = (hashes ^ np.uint64(MIXERS[word])) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: bytes, shingle: int = SHINGLE, words: int = 1, seed: int = SEED) -> np.ndarray:
    """SimHash of 64 * words bits: a bit is 1 if it is set in over half of the hashes of the word shingles; 0 without words.

    The first 64 bits come from XXH64 of the shingles, further words from mixes of that hash.
    """
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # bytes: A-Z only, and white space is \x09-\x0D and \x20
    if not found:
        return np.zeros(words, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        starts = [0, *itertools.accumulate(len(w) + 1 for w in found)]
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:], strict=False)], dtype=np.uint64)
    return majority(hashes, words)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of shingle hashes; 0 without any."""
    counts = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        for w in range(words):
            part = _mixed(hashes[at : at + (1 << 16)], w)
            counts[w] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical form of blocks of 64 fingerprints: (blocks, 64, words) -> (64 * words, blocks); bit `lane` of plane b is bit b of that lane."""
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(len(fps), LANES, -1), axis=2, bitorder="little")  # block, lane, bit
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(bits.shape[2], -1, 8).copy().view("<u8")[:, :, 0]


def lanes_within(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS, every: int = 8) -> np.ndarray:
    """For each block and query, the lanes at `radius` or fewer differing bits.

    queries (n, q, words) are compared with the blocks planes (64 * words, n): (n, q) masks of 64 lanes. All 64 distances of a
    block and a query are counted at once by carry-save adders over bit planes of counters and one of overflow. After every few
    planes, blocks whose lanes all exceed the radius for all queries are abandoned.
    """
    n, q, _ = queries.shape
    out = np.zeros((n, q), dtype=np.uint64)
    width = (radius + 1).bit_length()
    alive = np.arange(n)
    counters = [np.zeros((n, q), dtype=np.uint64) for _ in range(width)]
    over = np.zeros((n, q), dtype=np.uint64)
    every_one = np.uint64(0xFFFFFFFFFFFFFFFF)

    def beyond() -> np.ndarray:
        """Lanes whose counter is over the radius."""
        above, equal = np.zeros_like(over), np.full_like(over, every_one)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above | over

    last = len(planes) - 1
    for b in range(len(planes)):
        bit = queries[:, :, b // 64] >> np.uint64(b % 64) & np.uint64(1)
        carry = planes[b][:, None] ^ (np.uint64(0) - bit)
        for k in range(min(width, (b + 1).bit_length())):
            held = counters[k] & carry
            counters[k] ^= carry
            carry = held
        if b + 1 >= 1 << width:
            over |= carry
        if b % every == every - 1 and radius <= b < last:
            keep = (beyond() != every_one).any(axis=1)
            if keep.mean() < 0.75:
                alive, over, queries, planes = alive[keep], over[keep], queries[keep], planes[:, keep]
                counters = [c[keep] for c in counters]
                if not len(alive):
                    return out
    out[alive] = ~beyond()
    return out


def _lane_pairs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, query, lane) of the set bits."""
    block, query = np.nonzero(masks)
    bits = np.unpackbits(masks[block, query].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, lane = np.nonzero(bits)
    return block[hit], query[hit], lane


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(bucket: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS, tile: int = 128) -> Iterable[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links within each bucket: no component is lost, and there are fewer links than rows.

    Rows are sorted by bucket and side. Rows of side 0 are compared with each other; those of side 1 only with those of
    side 2 (two chunks of one large bucket).
    """
    n = len(fps)
    if n < 2:
        return
    forest = Forest(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = (sizes > 1) & (sizes <= LANES)

    # small buckets share blocks of 64 lanes and are told apart by a mask
    lane_of: list[int] = []
    blocks: list[list[int]] = []
    for s, size in zip(starts[small].tolist(), sizes[small].tolist(), strict=True):
        if len(lane_of) + size > LANES:
            blocks.append(lane_of)
            lane_of = []
        lane_of.extend(range(s, s + size))
    if lane_of:
        blocks.append(lane_of)
    for at in range(0, len(blocks), tile):
        rows = np.full((len(blocks[at : at + tile]), LANES), -1, dtype=np.int64)
        for k, b in enumerate(blocks[at : at + tile]):
            rows[k, : len(b)] = b
        yield from _compare(rows, rows, bucket, side, fps, radius, forest)

    # large buckets: their blocks of 64 in pairs, but not two blocks of one chunk that another task compares
    for s, size in zip(starts[sizes > LANES].tolist(), sizes[sizes > LANES].tolist(), strict=True):
        count = -(-size // LANES)
        padded = np.full(count * LANES, -1, dtype=np.int64)
        padded[:size] = np.arange(s, s + size)
        padded = padded.reshape(count, LANES)
        sides = side[s : s + size]
        second = int(np.searchsorted(sides, 2)) // LANES
        for i in range(count):
            first = i if sides[i * LANES] == 0 else max(i, second)
            if sides[i * LANES] == 2:
                break
            # blocks that are already in one component with all of block i have no more to say
            roots = np.array([forest.find(x) for x in range(s + i * LANES, s + size)])
            own = roots[:LANES]
            one = (own == own[0]).all()
            ahead = np.array([k for k in range(first, count) if not (one and (roots[(k - i) * LANES : (k - i + 1) * LANES] == own[0]).all())], dtype=np.int64)
            for at in range(0, len(ahead), tile):
                others = padded[ahead[at : at + tile]]
                yield from _compare(np.broadcast_to(padded[i], others.shape), others, bucket, side, fps, radius, forest)


def _compare(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int, forest: Forest) -> Iterable[tuple[int, int]]:
    block, query, lane = _lane_pairs(lanes_within(fps[a], bit_planes(fps[b]), radius))
    x, y = a[block, query], b[block, lane]
    right = (x >= 0) & (y >= 0)
    x, y = x[right], y[right]
    right = (x < y) & (bucket[x] == bucket[y]) & ((side[x] == 0) | (side[x] != side[y]))
    for i, j in zip(x[right].tolist(), y[right].tolist(), strict=True):
        if forest.join(i, j):
            yield i, j


def _columns(words: int) -> list[str]:
    return [f"f{w}" for w in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """(id, f0, f1, ...): fingerprint of each row as signed 64-bit integers; a null or empty text has zeros."""
    names = _columns(words)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle, words) for x in binary_column(batch, text_col)], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), *[pa.array(fps[:, w].copy()) for w in range(words)]], ["id", *names])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col)).mapInArrow(run, ", ".join(["id long", *[f"{n} long" for n in names]]))


def block_tables(radius: int, words: int = 1) -> list[list[int]]:
    """Bit masks of tables that lose no link: all bits in radius + 2 blocks, of which two fingerprints within the radius share two."""
    n, bits = radius + 2, 64 * words
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [_mask_words(blocks[i] | blocks[j], words) for i, j in itertools.combinations(range(n), 2)]


def sampled_tables(radius: int, words: int, loss: float = 0.005, seed: int = SEED, count: int | None = None) -> list[list[int]]:
    """Bit masks of tables for wide radii, where blocks would be too short: each takes KEY_BITS bits drawn at random.

    A pair at exactly `radius` differing bits fails to meet in any table with probability `loss`, closer pairs far more rarely. The tables
    are the same for every input, and so is whether a pair meets; a bucket of unrelated rows grows as rows / 2^KEY_BITS. count, where it
    is given, is the number of tables in place of what loss asks for: then the caller has another way for pairs that don't meet.
    """
    import math
    import random

    bits = 64 * words
    meet = math.prod((bits - radius - i) / (bits - i) for i in range(KEY_BITS))
    draw = random.Random(seed)
    return [_mask_words(sum(1 << b for b in draw.sample(range(bits), KEY_BITS)), words) for _ in range(count or math.ceil(math.log(loss) / math.log(1 - meet)))]


def _mask_words(mask: int, words: int) -> list[int]:
    parts = [mask >> 64 * w & (1 << 64) - 1 for w in range(words)]
    return [x - (1 << 64) if x >> 63 else x for x in parts]


def fingerprint_links(nodes: DataFrame, tables: list[list[int]], radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between the nodes (node, f0, f1, ... distinct) within the radius that connect all those that meet in a table.

    Buckets with one member are dropped after a count that is summed before the shuffle. Buckets over `chunk` members are split by
    hash into chunks and compared as pairs of chunks in separate tasks; none is cut short. A task emits a spanning forest of
    its links, not all its pairs.
    """
    words = len(tables[0])
    names = _columns(words)
    masks = F.array(*[F.array(*[F.lit(m) for m in t]) for t in tables])
    key = F.xxhash64("t", *[F.col(n).bitwiseAND(F.col("mask")[w]) for w, n in enumerate(names)])
    keyed = nodes.select("node", *names, F.posexplode(masks).alias("t", "mask")).select("node", *names, key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, "key")
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64(*names), chunks)
    # a member of chunk c goes to the pairs (c, c) as side 0, (c, d > c) as side 1 and (d < c, c) as side 2
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda d: F.struct(F.least(own, d).alias("lo"), F.greatest(own, d).alias("hi"), F.when(d == own, 0).when(d > own, 1).otherwise(2).cast("byte").alias("side")))
    dealt = members.select("node", *names, "key", F.explode(pairs).alias("p")).select(
        F.when(F.col("p.hi") == 0, F.col("key")).otherwise(F.xxhash64("key", "p.lo", "p.hi")).alias("task"), "key", F.col("p.lo").cast("int").alias("lo"), F.col("p.hi").cast("int").alias("hi"), F.col("p.side").alias("side"), "node", *names)
    kind = nodes.schema["node"].dataType.simpleString()
    ordered = dealt.repartition("task").sortWithinPartitions("task", "key", "lo", "hi", "side")

    def run(batches):
        import pyarrow as pa

        bounds = ["task", "key", "lo", "hi"]
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in [*bounds, "side", "node", *names]}
                held = cols if held is None else {f: np.concatenate([held[f], cols[f]]) for f in cols}
            if held is None or not len(held["node"]):
                continue
            new = np.r_[True, np.any([held[f][1:] != held[f][:-1] for f in bounds], axis=0)]
            bucket = np.cumsum(new)
            done = len(bucket) if batch is None else int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
            if not done:
                continue
            node, fps = held["node"][:done], np.stack([held[n][:done] for n in names], axis=1).astype(np.int64).view(np.uint64)
            found = list(links(bucket[:done], held["side"][:done], fps, radius))
            held = {f: x[done:] for f, x in held.items()}
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, words: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    Words are split at ASCII white space after A-Z are lower-cased; shingles are `shingle` words joined by a space, repeats
    included (the whole sequence where there are fewer words). A null or empty text, or one without words, has fingerprint 0
    and is linked like any other. Rows link at `radius` or fewer of 64 * words differing bits; component_id is the smallest id
    reachable, so ties can't arise. Repeated rows and ids give repeated result rows; an id with several texts links nothing by itself. Rows with a null id
    are linked by their fingerprint like the rest; a component of null ids only has a null component_id. An empty table gives an empty result. Other columns are ignored.

    Candidates meet in tables of masked bits: for a radius up to 4 bits of blocks that lose no link, for wider ones of bits
    drawn at random (see sampled_tables for the stated loss). Equal fingerprints (exact copies, most near copies of a hot group)
    become one node before any comparison, by an aggregate that is summed before its shuffle. Nothing about documents is collected
    on the driver.
    """
    names = _columns(words)
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, words), "simhash-fps")
    # a node is a fingerprint, whatever ids its rows have; the one of 64 bits is its own name
    name = F.col("f0") if words == 1 else F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names])
    nodes = materialize(fps.groupBy(*names).agg(F.min("id").alias("least")).withColumn("node", name), "simhash-nodes")
    tables = block_tables(radius, words) if radius <= 4 else sampled_tables(radius, words)
    edges = materialize(fingerprint_links(nodes, tables, radius, chunk), "simhash-links")
    roots = connected_components(edges)
    # components of several fingerprints are named by their least id; the others are their own
    linked = nodes.select("node", "least").join(materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "simhash-roots"), "node")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(named, "root").select("node", "component_id")
    every = nodes.join(labels, "node", "left").select(*names, F.coalesce("component_id", "least").alias("component_id"))
    shown = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return fps.join(every, names).select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
