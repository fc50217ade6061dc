"""The 1980 suffix-stripping stemmer as a column expression.

Words are lower-case ASCII letters and digits. `y` is marked once as a consonant (`Y`) or vowel (`y`): suffixes never change the letters
before them. Each step is bound once (see let), so the expression stays linear in size whatever is done with the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix and replacement of the second and third step, suffixes of the fourth, each in the order in which they are tried.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

VOWEL = "[aeiouy]"
MEASURE = "[aeiouy]+[^aeiouy]+"
CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
#: Double consonants that lose one letter (l, s and z keep both); digits are consonants.
DOUBLE = "(" + "|".join(["yY", *[c * 2 for c in "bcdfghjkmnpqrtvwx0123456789"]]) + ")$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, as an optimizer barrier against repeated inlining."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _measure(w: Column) -> Column:
    return F.regexp_count(w, F.lit(MEASURE))


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1)).otherwise(w)


def _restore(w: Column) -> Column:
    e = F.concat(w, F.lit("e"))
    return F.when(w.rlike("(at|bl|iz)$"), e).when(w.rlike(DOUBLE), _cut(w, 1)).when((_measure(w) == 1) & w.rlike(CVC), e).otherwise(w)


def _past(w: Column) -> Column:
    def chopped(n: int) -> Column:
        return let(_cut(w, n), lambda s: F.when(s.rlike(VOWEL), _restore(s)).otherwise(w))

    return F.when(w.endswith("eed"), F.when(_measure(_cut(w, 3)) > 0, _cut(w, 1)).otherwise(w)).when(w.endswith("ed"), chopped(2)).when(w.endswith("ing"), chopped(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when((w.endswith("y") | w.endswith("Y")) & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _first_of(rules: list[tuple[str, str]], least: int) -> Callable[[Column], Column]:
    def step(w: Column) -> Column:
        out = None
        for suffix, new in rules:
            base = _cut(w, len(suffix))
            then = F.when(_measure(base) > least, F.concat(base, F.lit(new)) if new else base).otherwise(w)
            out = F.when(w.endswith(suffix), then) if out is None else out.when(w.endswith(suffix), then)
        if least:  # the fourth step ends with ion after s or t
            out = out.when(w.endswith("sion") | w.endswith("tion"), F.when(_measure(_cut(w, 3)) > least, _cut(w, 3)).otherwise(w))
        return out.otherwise(w)

    return step


def _final_e(w: Column) -> Column:
    base = _cut(w, 1)
    return F.when(w.endswith("e") & ((_measure(base) > 1) | ((_measure(base) == 1) & ~base.rlike(CVC))), base).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & (_measure(w) > 1), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two characters stay."""
    marked = F.when(word.contains("y"), F.regexp_replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), "yy", "yY")).otherwise(word)
    steps = [_plural, _past, _final_y, _first_of(STEP2, 0), _first_of(STEP3, 0), _first_of([(s, "") for s in STEP4], 1), _final_e, _final_l]

    def chain(w: Column, rest: list) -> Column:
        return let(w, lambda x: chain(rest[0](x), rest[1:])) if rest else F.lower(w)

    return F.when(F.length(word) <= 2, word).otherwise(chain(marked, steps))


# ---------------------------------------------------------------------------- the same rules in SQL, one CTE a step


def stem_sql(source: str, word: str = "word") -> str:
    """DuckDB CTEs `stems(word, stem)` of the distinct words of a CTE."""
    m = lambda x: f"len(regexp_extract_all({x}, '{MEASURE}'))"
    cut = lambda n: f"left(w, len(w) - {n})"
    has = lambda x, r: f"regexp_matches({x}, '{r}')"

    def rules(table: list[tuple[str, str]], least: int) -> str:
        whens = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {m(cut(len(s)))} > {least} THEN {cut(len(s))} || '{t}' ELSE w END" for s, t in table)
        ion = f"WHEN {has('w', '[st]ion$')} THEN CASE WHEN {m(cut(3))} > 1 THEN {cut(3)} ELSE w END" if least else ""
        return f"CASE {whens} {ion} ELSE w END"

    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {m(cut(3))} > 0 THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND {has(cut(2), VOWEL)} THEN {cut(2)} || '|' "
        f"WHEN ends_with(w, 'ing') AND {has(cut(3), VOWEL)} THEN {cut(3)} || '|' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '|') THEN w WHEN {has(cut(1), '(at|bl|iz)$')} THEN {cut(1)} || 'e' WHEN {has(cut(1), DOUBLE)} THEN {cut(2)} "
        f"WHEN {m(cut(1))} = 1 AND {has(cut(1), CVC)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN {has('w', '[yY]$')} AND {has(cut(1), VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        rules(STEP2, 0),
        rules(STEP3, 0),
        rules([(s, "") for s in STEP4], 1),
        f"CASE WHEN ends_with(w, 'e') AND ({m(cut(1))} > 1 OR {m(cut(1))} = 1 AND NOT {has(cut(1), CVC)}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m('w')} > 1 THEN {cut(1)} ELSE w END",
    ]
    ctes = [f"st0 AS MATERIALIZED (SELECT DISTINCT {word} AS word, regexp_replace(regexp_replace({word}, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS w FROM {source})"]
    ctes += [f"st{i + 1} AS MATERIALIZED (SELECT word, {s} AS w FROM st{i})" for i, s in enumerate(steps)]
    return ", ".join([*ctes, f"stems AS MATERIALIZED (SELECT word, CASE WHEN len(word) <= 2 THEN word ELSE lower(w) END AS stem FROM st{len(steps)})"])
