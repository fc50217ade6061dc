"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import GATES, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text whose case hasn't been changed: runs of letters, digits and non-ASCII characters, stated by what is in them, as Java's regular
#: expressions take some thirty times as long for a class that is stated by what isn't.
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

DETECTION = "struct<start:int,neg_end:int,tier:int,rule:int,label:string,confidence:double,base:boolean>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(padded: Column, regex: Column) -> Column:
    """Word positions array<struct<start, n>> of the regex's matches, left to right without overlap.

    padded has a space before and after each word, so a matched string is whole words, and its next literal occurrence after the
    previous match is the next match.
    """
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("word"), F.array().cast("array<struct<start:int,n:int>>").alias("found"))

    def step(acc: Column, match: Column) -> Column:
        place = F.call_function("locate", match, padded, acc["at"])
        return let(place, lambda p: let(F.regexp_count(F.substring(padded, acc["at"], p - acc["at"]), F.lit("[^ ]+")).cast("int"), lambda skipped: let(
            F.regexp_count(match, F.lit("[^ ]+")).cast("int"), lambda n: F.struct(
                (p + F.length(match)).cast("int").alias("at"), (acc["word"] + skipped + n).cast("int").alias("word"),
                F.concat(acc["found"], F.array(F.struct((acc["word"] + skipped).cast("int").alias("start"), n.alias("n")))).alias("found")))))

    return F.aggregate(F.regexp_extract_all(padded, regex, F.lit(0)), start, step, lambda acc: acc["found"])


def _table(found: Sequence[Rule]) -> Column:
    """The rules as one literal array."""
    return F.array(*[F.struct(
        F.lit(r.order).alias("rule"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
        F.lit(r.confidence).alias("confidence"), F.lit(r.regex).alias("regex"), F.lit(r.base).alias("base")) for r in found])


def _detections(words: Column, table: Column, keywords: Column) -> Column:
    """All matches of the rules whose keyword is among the words, sorted by start, longest first, then by priority."""
    def of(rule: Column, padded: Column) -> Column:
        return F.transform(_spans(padded, rule["regex"]), lambda s: F.struct(
            s["start"].alias("start"), (-(s["start"] + s["n"])).alias("neg_end"), rule["tier"].alias("tier"), rule["rule"].alias("rule"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))

    padded = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    return let(F.array_intersect(words, keywords), lambda kws: let(padded, lambda text: F.array_sort(
        F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(kws, r["keyword"])), lambda r: of(r, text))))))


def _kept(found: Column) -> Column:
    """Detections without those inside an earlier one of the same or a higher priority tier.

    found is sorted by start and longest first, so what holds a detection comes before it; it is enough to know the furthest end
    of each tier so far. A base detection is kept in any case.
    """
    zero = F.struct(*[F.lit(0).alias(f"e{t}") for t in range(4)], F.array().cast(f"array<{DETECTION}>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["neg_end"]
        ends = [F.greatest(acc[f"e{t}"], F.when(d["tier"] == t, end).otherwise(0)).alias(f"e{t}") for t in range(4)]
        inside = F.lit(False)
        for t in range(4):
            inside = inside | ((d["tier"] >= t) & (acc[f"e{t}"] >= end))
        kept = F.when(inside & ~d["base"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d)))
        return F.struct(*ends, kept.alias("kept"))

    return F.aggregate(found, zero, step, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, text_col: str = "text", extra_rules: Sequence[Rule] = (), result_col: str = "licenses") -> DataFrame:
    """docs with one more column: struct(n_words, detections), detections as array<struct<start, neg_end, tier, rule, label, confidence, base>>.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased; positions count words from 0, neg_end is
    minus the end (exclusive). Rules are tried only on texts that hold one of the gates and their keyword. A rule's matches
    are found left to right; where intervals nest, a detection inside one of the same or a higher priority tier is dropped
    (equal intervals: the rule listed first stays), base phrases excepted. A null or empty text has 0 words and no
    detections. Repeated rows give repeated results, an empty table an empty one. result_col must not be a column of docs.

    Nothing is shuffled and no Python runs: every row is finished where it is read. Only texts with a gate (a single pass of a
    short pattern) are cut into words.
    """
    if result_col in docs.columns:
        raise ValueError(f"docs already has a column {result_col}")
    known = [*rules(), *extra_rules]
    table, keywords = _table(known), F.array(*[F.lit(k) for k in sorted({r.keyword for r in known})])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    gate = text.rlike("(?i)(?=[lcswrp])(?:" + "|".join(GATES) + ")")
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(ANY_CASE), F.lit(0))
    none = F.array().cast(f"array<{DETECTION}>")
    found = F.when(gate, let(_detections(words, table, keywords), _kept)).otherwise(none)
    return docs.withColumn(result_col, F.struct(F.regexp_count(text, F.lit(ANY_CASE)).cast("long").alias("n_words"), found.alias("detections")))


def license_digest(scan: DataFrame, id_col: str = "doc_id", result_col: str = "licenses") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of scan_licenses' result; score is the highest confidence."""
    found = F.col(f"{result_col}.detections")
    base = F.filter(found, lambda d: d["base"])
    labels = lambda a: F.array_join(F.sort_array(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    return scan.select(F.col(id_col), F.col(f"{result_col}.n_words").alias("n_words"), found.alias("d"), base.alias("b")).select(
        id_col, "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(F.transform("b", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("b", lambda d: d["start"])).cast("long").alias("last_word"), labels(F.col("b")).alias("base_labels"), labels(F.col("d")).alias("labels"),
        F.coalesce(F.array_max(F.transform("d", lambda d: d["confidence"])), F.lit(0.0)).alias("score"))
