import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexisweave.llm.exact_dedup import exact_dedup

LONG = "x" * 300000
ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "ab"), (7, "ba"), (8, LONG), (9, LONG), (10, LONG[:-1] + "y"), (11, "x" * 300), (12, "x" * 299 + "é"[0]), (3, "b"),
    (13, "é"), (14, "é"), (None, "n"), (None, "n"), (None, "a"), (15, "a "),
]


@pytest.mark.parametrize("slot_bits", [25, 1])
def test_against_brute_force(spark, slot_bits):
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in ROWS], "doc_id long, text string, len int, n int, keep string")
    got = exact_dedup(docs, slot_bits=slot_bits, carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256), "n": F.col("n")})
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "sha", "n"]
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t in ROWS:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest(), 2))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_grow_with_the_rows_within_bounds():
    from lexisweave.llm.exact_dedup import slot_bits_for

    assert [slot_bits_for(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 24, 1 << 25, 1 << 40)] == [25, 25, 25, 26, 29, 30, 30]
