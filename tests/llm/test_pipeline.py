import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lexisweave.llm import pipeline_stages as S
from lexisweave.llm import queries as Q

VOCABULARY = ["".join(random.Random(k).choices(["ba", "to", "ri", "lem", "son", "ka", "mu"], k=2 + k % 3)) for k in range(900)]
BENCH = " ".join(VOCABULARY[k * 17 % 900] for k in range(14))


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY if rnd.random() < 0.7 else ["the", "of", "and", "in"]) for _ in range(n)) + "."


def fixture():
    """Documents (id, kind, text): clean, junk, exact and near copies, and texts with a benchmark passage."""
    rnd = random.Random(11)
    clean = [prose(rnd, rnd.randint(110, 250)) for _ in range(60)]
    rows = [(i, "clean", t) for i, t in enumerate(clean)]
    rows += [(100 + i, "junk", "!! ".join(prose(rnd, 60).split()).upper()) for i in range(10)] + [(120 + i, "junk", " | ".join(prose(rnd, 60).split())) for i in range(8)] + [(140, "junk", None), (141, "junk", "")]
    rows += [(200 + i, "copy", clean[i % 7]) for i in range(30)]
    for i in range(10):
        w = clean[20 + i].split()
        w[len(w) // 2] = "other"
        rows.append((300 + i, "copy", " ".join(w)))
    rows += [(400 + i, "leak", prose(rnd, 40) + " " + BENCH.upper() + " " + prose(rnd, 40)) for i in range(6)]
    return rows


def test_stages(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2], f"src{i % 5}", len(t) if t else None, k) for i, k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, quality string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = dict((i, k) for i, k, _ in rows)
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), "test")
        out[name] = now
        assert name == "tokens" or now.columns == docs.columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in out.items()}
    assert ids["quality"] == sorted(i for i, k, _ in rows if k != "junk")
    assert ids["near_dedup"] == sorted(i for i, k, _ in rows if k in ("clean", "leak"))
    assert ids["decontaminate"] == sorted(i for i, k, _ in rows if k == "clean")
    assert set(ids["mixing"]) <= set(ids["decontaminate"]) and {kinds[i] for i in ids["mixing"]} == {"clean"}

    # the mix, by running sums over the seeded order; then the library itself
    mixed = [(r.doc_id, r.text) for r in out["mixing"].collect()]
    total = sum(len(t.split()) for i, k, t in rows if k == "clean")
    assert sum(len(t.split()) for _, t in mixed) in range(int(Q.MIX_SHARE * total) - 10, int(Q.MIX_SHARE * total) + 1)
    library = Tokenizer.from_file(Q.tokenizer_path())
    want = sorted((i, len(e) + 1, zlib.crc32(np.array([*e, Q.END_ID], "<u4").tobytes())) for i, t in mixed for e in [library.encode(t, add_special_tokens=False).ids])
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out["tokens"].collect())
    assert got == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out["tokens"].collect()))


def test_rows_that_repeat(spark, tmp_path):
    rnd = random.Random(3)
    a, b = prose(rnd, 80), prose(rnd, 90)
    docs = spark.createDataFrame([(1, a, "en", "s"), (1, a, "en", "s"), (2, b, "en", "s"), (2, prose(rnd, 70), "en", "s"), (None, a, None, None), (None, b, "en", "s"), (9, b, "en", "s")], "doc_id long, text string, lang string, source string")
    kept = S.near_dedup(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "2", "None", "None"]
    assert S.mixing(spark, docs, "").count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (S.quality, S.near_dedup, S.mixing):
        found = stage(spark, docs, "")
        assert found.columns == docs.columns and found.count() == 0


def test_empty_tables_of_the_last_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, BENCH), (None, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    for folder in ("a", "b"):
        found = S.decontaminate(spark, docs, f"{tmp_path}/{folder}")
        assert found.columns == docs.columns and found.count() == 0
    rows = spark.createDataFrame([(1, BENCH), (1, BENCH), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in S.decontaminate(spark, rows, f"{tmp_path}/a").collect()) == ["2", "None"]
    assert S.decontaminate(spark, rows, f"{tmp_path}/b").count() == 4
    assert S.tokens(spark, docs, "").count() == 0
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in S.tokens(spark, rows.where("text is null or text = ''"), "").collect()) == [("2", 1, 1), ("None", 0, 1)]


def test_clashing_names_and_line_breaks(spark):
    rnd = random.Random(4)
    texts = ["\n\t".join(prose(rnd, 9) for _ in range(12)) for _ in range(8)]
    names = ["__id", "__hash", "__key", "__take", "__all", "quality", "hits", "mix_key", "near_id", "epoch", "component"]
    docs = spark.createDataFrame([(i, t, "en", "s", *range(len(names))) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    assert S.near_dedup(spark, docs, "").columns == docs.columns and S.quality(spark, docs, "").columns == docs.columns
    mixed = S.mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    whole, cut = set(texts), [r.text for r in mixed.collect() if r.text not in texts]
    assert len(cut) == 1 and any(t.startswith(cut[0]) and "\n\t" in cut[0] for t in whole)
