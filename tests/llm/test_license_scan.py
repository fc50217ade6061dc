import random
import re

from lexisweave.llm.license_rules import BASE, GATES, rules
from lexisweave.llm.license_scan import license_digest, scan_licenses

RULES = rules()


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text):
    """Every rule on every text, without gates, keywords or running maxima."""
    w = words(text)
    padded = "".join(f" {x} " for x in w)
    found = []
    for r in RULES:
        for m in re.finditer(r.regex, padded):
            s = len(padded[: m.start()].split())
            found.append((s, s + len(m[0].split()), r))
    kept = [
        (s, e, r) for s, e, r in found
        if r.base or not any((t, f, q.order) != (s, e, r.order) and t <= s and f >= e and q.tier <= r.tier and ((t, -f) < (s, -e) or (q.tier, q.order) < (r.tier, r.order)) for t, f, q in found)
    ]
    base = [(s, r.label) for s, _, r in kept if r.base]
    want = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    assert sorted(base) == sorted(want)
    at = [s for s, _ in base]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({r.label for *_, r in kept})), max((r.confidence for *_, r in kept), default=0.0))


TEXTS = [
    None, "", " .,", "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "MIT License mit license MIT-LICENSE mit licenses permit license", "Apache License apache license", "licenſe K MIT License", "SPDX-License-Identifier: Apache-2.0", "(c) Copyright 2020 X. All rights reserved.",
    "GNU Lesser General Public License v2.1 or any later version; gnu general public license any later version", "Permission is hereby granted, free of charge, to any person obtaining a copy", "public domain\npublic,domain",
    "é MIT License ñ", "the mit license " * 700 + "word " * 9000 + "Apache license", "general public license general public license", "licensed under the terms of the mit license and the isc license", "general public", "permission",
    "Creative Commons Attribution-ShareAlike 4.0", "dual licensed: BSD 3-clause license, zlib license", "a\x00mit\x7flicense",
]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = sorted({x for r in RULES for x in re.findall(r"[a-z0-9]{2,}", r.pattern)}) + ["the", "2", "0", "of"] * 20 + ["license", "public", "general", "mit", "apache", "gnu", "licensed", "under"] * 15
    texts = TEXTS + [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0, "x", True) for i, t in enumerate(texts)] + [(3, texts[3], 0, "x", True)], "doc_id long, text string, d int, labels string, base boolean")
    scan = scan_licenses(docs)
    assert scan.columns == [*docs.columns, "licenses"]
    got = sorted(map(tuple, license_digest(scan).collect()), key=lambda r: r[0])
    want = sorted([(i, *plain(t)) for i, t in enumerate(texts)] + [(3, *plain(texts[3]))], key=lambda r: r[0])
    assert got == want
    assert license_digest(scan_licenses(docs.limit(0))).count() == 0


def test_rules_contain_keyword_and_gate():
    gates = re.compile("|".join(g.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff") for g in GATES))
    assert len(RULES) > 200
    for r in RULES:
        assert r.keyword in re.findall(r"[a-z0-9]+", re.sub(r"\[cs\]", "s", r.pattern.replace("?!", " ").replace("s?", "s"))) or r.keyword in ("license", "mit", "cddl"), r
        assert gates.search(r.pattern.replace("licen[cs]", "license").replace(" ", " ")), r


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = license_digest(scan_licenses(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
