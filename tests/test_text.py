import random
import re

import duckdb
from pyspark.sql import functions as F

from lexisweave.functions.stemming import STEP2, STEP3, STEP4, stem, stem_sql
from lexisweave.functions.text import raw_words, tokens


class PlainStemmer:
    """The published algorithm, letter by letter."""

    def vowel(self, w, i):
        return w[i] in "aeiou" or w[i] == "y" and i > 0 and not self.vowel(w, i - 1)

    def m(self, w):
        kinds = re.sub(r"(.)\1*", r"\1", "".join("V" if self.vowel(w, i) else "C" for i in range(len(w))))
        return kinds.count("VC")

    def any_vowel(self, w):
        return any(self.vowel(w, i) for i in range(len(w)))

    def cvc(self, w):
        return len(w) >= 3 and not self.vowel(w, len(w) - 1) and self.vowel(w, len(w) - 2) and not self.vowel(w, len(w) - 3) and w[-1] not in "wxy"

    def __call__(self, w):
        if len(w) <= 2:
            return w
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.m(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end):
                    if self.any_vowel(w[: -len(end)]):
                        w = w[: -len(end)]
                        if w.endswith(("at", "bl", "iz")):
                            w += "e"
                        elif len(w) > 1 and w[-1] == w[-2] and not self.vowel(w, len(w) - 1):
                            w = w if w[-1] in "lsz" else w[:-1]
                        elif self.m(w) == 1 and self.cvc(w):
                            w += "e"
                    break
        if w.endswith("y") and self.any_vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (STEP2, STEP3):
            for a, b in table:
                if w.endswith(a):
                    w = w[: -len(a)] + b if self.m(w[: -len(a)]) > 0 else w
                    break
        for a in STEP4:
            if w.endswith(a):
                w = w[: -len(a)] if self.m(w[: -len(a)]) > 1 else w
                break
        else:
            if w.endswith(("sion", "tion")) and self.m(w[:-3]) > 1:
                w = w[:-3]
        if w.endswith("e") and (self.m(w[:-1]) > 1 or self.m(w[:-1]) == 1 and not self.cvc(w[:-1])):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.m(w) > 1 else w


def vocabulary():
    rnd = random.Random(2)
    ends = [a for a, _ in STEP2 + STEP3] + STEP4 + ["s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", "ion", "tion", "sion", ""]
    out = {"".join(rnd.choice("aeiouybcdlstxz1") for _ in range(rnd.randint(0, 6))) + rnd.choice(ends) + rnd.choice(ends) for _ in range(15000)}
    return sorted(w for w in out | set("players playing player running runner university universal relational was is 2024s skies championships yy yyy sky toy feed agreed hopping falling fizzed".split()) if w)


def test_stem_in_both_engines(spark):
    found = vocabulary()
    plain = PlainStemmer()
    want = {w: plain(w) for w in found}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in found], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS word", [found])
    assert dict(con.execute(f"WITH {stem_sql('t')} SELECT word, stem FROM stems").fetchall()) == want
    for w, s in [("players", "player"), ("playing", "plai"), ("running", "run"), ("runner", "runner"), ("university", "univers"), ("universal", "univers"), ("relational", "relat"), ("was", "wa"), ("is", "is"), ("2024s", "2024"), ("skies", "ski")]:
        assert want[w] == s


def test_stem_can_be_filtered(spark):
    rows = spark.createDataFrame([("running",), ("cats",)], "w string").withColumn("s", stem(F.col("w"))).where("s = 'run'")
    assert [r.w for r in rows.collect()] == ["running"]


def test_words(spark):
    texts = ["100-meter 2--1 FIFA's", "café Kelvin Kelvin", None, "", "a\nb\tc", "ÉA_b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.w for r in rows.orderBy("doc_id").select(raw_words(F.col("text")).alias("w")).collect()]
    assert got == [["100", "meter", "2", "1", "FIFA", "s"], ["caf", "Kelvin", "elvin"], [], [], ["a", "b", "c"], ["A", "b"]]
    found = sorted((r.doc_id, r.pos, r.term) for r in tokens(rows).collect())
    assert found[:6] == [(0, 0, "100"), (0, 1, "meter"), (0, 2, "2"), (0, 3, "1"), (0, 4, "fifa"), (0, 5, "s")]
