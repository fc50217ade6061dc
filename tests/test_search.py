import math
import random

import pytest
from pyspark.sql import functions as F

from lexisweave.operators.index import Index
from lexisweave.operators.search import SearchEngine, in_sequence

BODIES = [
    "football world cup", "Football players playing in the world", "tennis championship final", "world football cup record", "the world record was broken in a record world cup", "", "100-meter relay; FIFA's 2-1 score",
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    corpus = spark.createDataFrame([(i, f"u{i}", f"t{i}", b) for i, b in enumerate(BODIES)], "doc_id long, url string, title string, text string")
    return SearchEngine(Index.build(corpus).save(str(tmp_path_factory.mktemp("index"))))


def ids(engine, q):
    return sorted(r.doc_id for r in engine.matches(q).collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("football && world", [0, 1, 3]), ("football || tennis", [0, 1, 2, 3]), ("!football", [2, 4, 5, 6]), ("!!football", [0, 1, 3]), ("football && ---", [0, 1, 3]), ("--- && football", []), ("football &&", []),
        ("&& football", []), ("football ||", [0, 1, 3]), ('football && ""', []), ("100-meter && relay", [6]), ("(football tennis)", [0, 1, 2, 3]), ("players", [1]), ("play", [1]), ('"world cup"', [0, 4]), ('"world cup" / 2', [0, 4]),
        ('"world cup" / 1', [0, 4]), ('"world cup" / 3', [0, 3, 4]), ('"world cup" / 0', []), ('"world record"', [4]), ('"world record" / 3', [3, 4]), ('"record world" / 4', [4]), ('"fifa s"', [6]), ('"world cup" football', [0]),
        ("nosuch", []), ("!nosuch", [0, 1, 2, 3, 4, 5, 6]), ("world && !football", [4]), ("", []), ("&&", []),
    ],
)
def test_golden_sets(engine, q, want):
    assert ids(engine, q) == want


def test_golden_ranking(engine):
    def top(q):
        return [(r["rank"], r.doc_id, round(r.score, 6), r.title) for r in sorted(engine.search(q).collect())]

    assert top("football world") == [(1, 0, 1.406914, "t0"), (2, 1, 1.406914, "t1"), (3, 3, 1.406914, "t3"), (4, 4, 0.947512, "t4")]
    assert [(d, s) for _, d, s, _ in top("world cup")] == [(4, 1.79481), (0, 1.406914), (3, 1.406914), (1, 0.559616)]
    assert [(d, s) for _, d, s, _ in top("world && !football")] == [(4, 0.947512)]
    assert [(d, s) for _, d, s, _ in top('"world cup"')] == [(0, 0.0), (4, 0.0)]
    ranked = sorted((r["rank"], r.doc_id) for r in engine.search('"world cup"', ranked=True).collect())
    assert ranked == [(1, 4), (2, 0)]
    assert [r.doc_id for r in sorted(engine.search("world cup", ranked=False).collect())] == [0, 1, 3, 4]


def test_pages(engine):
    rows, more = engine.search_page("football world", 1, 3)
    assert [r.doc_id for r in sorted(rows.collect())] == [0, 1, 3] and more
    rows, more = engine.search_page("football world", 2, 3)
    assert [(r["rank"], r.doc_id) for r in rows.collect()] == [(4, 4)] and not more
    assert engine.search_page("football world", 3, 3)[0].count() == 0


def test_set_laws(engine):
    n = len(BODIES)
    for a, b in [("world", "football"), ("record", "tennis"), ("the", "nosuch")]:
        x, y = set(ids(engine, a + " &&" + " " + a)), set(ids(engine, f"{b} || {b}"))
        assert len(x) + len(ids(engine, f"!{a}")) == n
        assert set(ids(engine, f"{a} && {b}")) == x & y and set(ids(engine, f"{a} || {b}")) == x | y
        assert ids(engine, f"!({a} || {b})") == ids(engine, f"!{a} && !{b}")


def test_batch_equals_single_queries(spark, engine):
    asked = {1: "football world", 2: "world cup cup", 3: "nosuch", 4: "100-meter"}
    got = {}
    for r in engine.batch_free_text(spark.createDataFrame(list(asked.items()), "query_id int, query string")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for k, q in asked.items():
        assert sorted(got.get(k, [])) == sorted((r["rank"], r.doc_id, r.score) for r in engine.search(q).collect())


def test_index_tables(engine):
    rows = {(r.term, r.doc_id): r.positions for r in engine.index.postings.collect()}
    assert rows["world", 4] == [1, 8] and rows["record", 4] == [2, 7] and rows["s", 6] == [4] and rows["plai", 1] == [2]
    assert {r.doc_id: r.length for r in engine.index.docs.collect()} == {0: 3, 1: 6, 2: 3, 3: 4, 4: 10, 5: 0, 6: 8}
    s = engine.index.stats.first()
    assert (s.n_docs, s.n_tokens) == (7, 34) and math.isclose(s.avg_len, 34 / 7)


def test_empty_corpus(spark):
    empty = SearchEngine(Index.build(spark.createDataFrame([], "doc_id long, url string, title string, text string")))
    assert empty.total("a") == 0 and empty.total("!a") == 0 and empty.index.stats.first().avg_len == 1.0


def test_proximity_equals_backtracking(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        rows.append((i, [sorted(rnd.sample(range(14), rnd.randint(0, 6))) for _ in range(3)], rnd.randint(2, 8)))

    def found(lists, last, first, d):
        if not lists:
            return last - first <= d
        return any(found(lists[1:], p, first, d) for p in lists[0] if p > last)

    df = spark.createDataFrame([(i, *p, d) for i, p, d in rows], "id int, a array<int>, b array<int>, c array<int>, d int")
    for d in range(2, 9):
        got = {r.id: r.x for r in df.select("id", in_sequence([F.col("a"), F.col("b"), F.col("c")], d).alias("x")).collect()}
        assert all(got[i] == any(found(p[1:], s, s, d) for s in p[0]) for i, p, _ in rows)
    got = {r.id: r.x for r in df.select("id", in_sequence([F.col("a"), F.col("b"), F.col("c")], None).alias("x")).collect()}
    assert all(got[i] == any(s + 1 in p[1] and s + 2 in p[2] for s in p[0]) for i, p, _ in rows)


def test_plans(engine):
    plan = engine.search("football && world")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    lookup = engine.lookup("world")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in lookup and "EqualTo(term,world)" in lookup
