import hashlib
import json

import __spark_entry__
from lexisweave import cli
from lexisweave.operators import crawl as C
from lexisweave.sources import corpus as S
from lexisweave.streaming import upkeep as U


def test_text_dir(spark, tmp_path):
    (tmp_path / "Figure_skating.txt").write_text("Title: x\n\nbody")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.json").write_text("{}")
    rows = sorted(map(tuple, S.read_text_dir(spark, str(tmp_path), "http://w/").collect()))
    assert rows == [("http://w/Figure_skating", "Figure skating", "Title: x\n\nbody")]
    assert tuple(S.text_dir_sizes(spark, str(tmp_path)).first()) == (1, 14)


def test_lines(spark, tmp_path):
    lines = spark.createDataFrame([("u\tt\tb\tc",), ("u\tt",), ("",), ("\t\t",)], "value string")
    assert sorted(map(tuple, S.parse_tsv(lines).collect())) == [("", "", ""), ("u", "t", "b\tc")]
    docs = spark.createDataFrame([("u", None, "a\tb\nc")], "url string, title string, text string")
    assert S.parse_tsv(S.to_tsv(docs)).first() == ("u", "", "a b c")
    (tmp_path / "q").write_text("one two\n\n  \nthree\n")
    assert [r["query"] for r in S.read_queries(spark, str(tmp_path / "q")).collect()] == ["one two", "three"]


def test_filters(spark):
    found = spark.createDataFrame([("A b",), ("a B",), ("x:y",), ("",), ("new",)], "title string")
    seen = spark.createDataFrame([("NEW",)], "title string")
    assert [r.title.lower() for r in C.new_titles(found, seen).collect()] == ["a b"]
    rows = spark.createDataFrame([(t, i) for t in "ab" for i in range(5)], "t string, i int")
    assert sorted(map(tuple, C.quota(rows, "t", "i", 2).collect())) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_stream_upsert(spark, tmp_path):
    schema = "url string, raw_sha256 string, fetched_at long, checked_at long"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    want = {}
    for batch, rows in enumerate([[("a", "1", 1, 1), ("b", "2", 1, 1)], [("a", "1", 5, 5), ("b", "3", 5, 5), ("c", "4", 5, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        U.stream_upsert(stream, table, f"{tmp_path}/check").awaitTermination()
        for u, h, t, _ in rows:
            want[u] = (u, h, want[u][2] if u in want and want[u][1] == h else t, t)
        assert sorted(map(tuple, U.current(spark, table).collect())) == sorted(want.values())
        assert batch == 0 or U.current(spark, table, below=1).count() == 2


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "cats cat"), ("2024-01-01 01:10:00", "dog"), ("2024-01-01 09:00:00", "end")], "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = U.term_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts")
    query = stream.writeStream.format("memory").queryName("terms").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.term, r["count"]) for r in spark.table("terms").collect()) == [("cat", 2), ("dog", 1)]


def test_cli(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(0, "world cup", "en", "s"), (1, "cup", "en", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/docs")
    assert cli.main(["index", "--documents", f"{tmp_path}/docs", "--out", f"{tmp_path}/index"]) == 0
    (tmp_path / "q").write_text('world && cup\n"cup"\n')
    assert cli.main(["search", "--index", f"{tmp_path}/index", "--input-file", f"{tmp_path}/q", "--output-file", f"{tmp_path}/out"]) == 0
    assert (tmp_path / "out").read_text() == 'world && cup\nFound 1 docs.\n1. s/0 (doc:0)\n\n"cup"\nFound 2 docs.\n1. s/0 (doc:0)\n2. s/1 (doc:1)\n\n'


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["rank", "doc_id", "score", "title", "url"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_text_dir(spark, tmp_path):
    (tmp_path / "Figure_skating.txt").write_bytes(b"a\r\nb\xff\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.json").write_text("{}")
    rows = {r.url: r for r in S.import_text_dir(spark, str(tmp_path), 7, "http://w/").collect()}
    text = "a\nb\ufffd\n"
    assert tuple(rows["http://w/Figure_skating"]) == ("http://w/Figure_skating", "wikipedia", text, hashlib.sha256(text.encode()).hexdigest(), text, "Figure skating", 7, 7, "wikipedia_api")
    assert rows["http://w/b"].raw_content == "" and len(rows) == 2
    assert S.import_text_dir(spark, str(tmp_path), 7).columns == C.RECORD
    assert tuple(S.corpus_size(spark, str(tmp_path), 1).first()) == (2, 6, 1, 6)


def test_articles(spark, tmp_path):
    long = " ".join(["w\u2003x"] * 3)  # six words, as Unicode white space separates
    found = spark.createDataFrame([
        ("One (1)", "u1", "b", 1, long), ("one 1", "u2", "a", 5, long), ("Seen", "u3", "a", 1, long), ("x:y", "u4", "a", 2, long), ("", "u5", "a", 3, long), ("short", "u6", "a", 4, "w"), ("two", "u7", "a", 6, long), ("three", "u8", "a", 7, long),
        ("four", "u9", "b", 2, long), ("five", "u10", "b", 3, long), ("other", "u11", "c", 1, long),
    ], "title string, url string, category string, place int, text string")
    seen = spark.createDataFrame([("SEEN",), ("other",)], "name string")
    names = lambda per, target: sorted(r.name for r in C.articles(found, seen, ["a", "b"], per, target, least=6).collect())
    assert names(2, 100) == ["five", "four", "one_1", "two"]  # of the two titles with one name, the one of the first topic
    assert names(2, 5) == ["four", "one_1", "two"] and names(2, 2) == []
    rows = C.articles(found, seen, ["a", "b"], 1, 100, least=6)
    assert C.write_articles(rows, f"file://{tmp_path}") == 2
    assert json.loads((tmp_path / "raw/one_1.json").read_text()) == {"title": "one 1", "url": "u2", "category": "a", "word_count": 6}
    assert (tmp_path / "text/one_1.txt").read_text() == f"Title: one 1\nURL: u2\nSource: Wikipedia\nCategory: a\n\n{long}"
    assert sorted(x.name for x in (tmp_path / "text").iterdir() if x.suffix == ".txt") == ["four.txt", "one_1.txt"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("sources:\n  - name: s\n    seeds: ['http://a.com/']\n    allowed_domains: [a.com]\n    max_articles: 5\n    doc_url_regex: ''\n")
    source = C.Source.of(S.read_config(str(tmp_path / "c.yaml"))["sources"][0])
    assert (source.name, source.seeds, source.allowed_domains, source.max_articles, source.method) == ("s", ["http://a.com/"], ["a.com"], 5, "web")
    (tmp_path / "d.yaml").write_text("- 1")
    assert S.read_config(str(tmp_path / "d.yaml")) == {}
