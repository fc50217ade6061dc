"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PREFIX_CHARS = 256
#: log2 of the slots of a bitmap of repeated keys: 32 for each row, within these bounds, 4 MB and 128 MB.
SLOT_BITS = (25, 30)


def slot_bits_for(rows: int) -> int:
    return min(SLOT_BITS[1], max(SLOT_BITS[0], (32 * max(1, rows) - 1).bit_length()))


def _slot(slot_bits: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << slot_bits)) + 1


def _repeated(slots: DataFrame) -> DataFrame:
    """Bitmap of the slots that more than one row has: one row of 4 KB for 32768 slots."""
    again = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return again.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _survivors(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """rows (with slot) plus survives: whether the slot's bit is set. The bitmap's size is bounded by SLOT_BITS, so it is broadcast."""
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(bitmap), "bucket", "left")
    bit = F.expr("shiftright(__byte, cast(bitmap_bit_position(slot) % 8 as int)) & 1")
    return joined.withColumn("__byte", byte).withColumn("survives", F.coalesce(bit == 1, F.lit(False))).drop("bucket", "bits", "__byte")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, slot_bits: int | None = None, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the carry columns (expressions over docs).

    Rows are equal when their texts are identical; a null text counts as empty. The row with the largest id of a group
    stays; rows that repeat an id all count in group_size, and all are kept if that id is. Null ids are smaller than any
    other (in a group with null ids only, keep_id is null and all rows are kept). An empty table gives an empty result.
    Other columns of docs are ignored unless carry names them, so their names can't clash.

    Three passes over docs, none of which shuffles a text. The first counts lengths, the second hashes the prefixes of
    rows whose length occurs again, the third hashes whole texts of rows whose length and prefix hash do. What a pass
    hands to the next is a bitmap over hashed keys, sized by the number of rows within SLOT_BITS: a false hit only costs a hash, the last
    grouping is by length and SHA-256. Beyond some 2^30 rows the largest bitmap fills up, and more and more texts are hashed that needn't be; results stay whole. Counts are summed before each shuffle, so a key with a third of all rows is one row per task,
    and the join back has one row per key on the counted side: adaptive execution broadcasts or splits it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = {f"__c{i}": e for i, e in enumerate((carry or {}).values())}
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"), *[e.alias(n) for n, e in extra.items()])

    if slot_bits is None:
        slot_bits = slot_bits_for(docs.count())
    by_length = rows.withColumn("slot", _slot(slot_bits, F.col("len")))
    lengths = materialize(_repeated(by_length.select("slot")), "exact-lengths")
    prefix = F.when(F.col("survives"), F.xxhash64(F.left("text", F.lit(prefix_chars))))
    by_prefix = _survivors(by_length, lengths).withColumn("pre", prefix).withColumn("slot", _slot(slot_bits, F.col("len"), F.col("pre")))
    prefixes = materialize(_repeated(by_prefix.where("pre is not null").select("slot")), "exact-prefixes")
    hashed = _survivors(by_prefix.drop("survives"), prefixes).withColumn("sha", F.when(F.col("survives") & F.col("pre").isNotNull(), F.sha2("text", 256)))
    hashed = hashed.select("id", "len", "sha", *extra)

    groups = hashed.where("sha is not null").groupBy("len", "sha").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where("n > 1")
    groups = materialize(groups, "exact-groups")  # a table of its own, so that its join can be broadcast or a hot text split
    joined = hashed.join(groups, ["len", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"),
        *[F.col(n).alias(name) for n, name in zip(extra, carry or {}, strict=True)],
    )
