"""Command line: build an index of a documents table, and search it.

python -m lexisweave.cli index --documents PATH --out INDEX
python -m lexisweave.cli search --index INDEX (--query Q | --input-file F [--output-file F]) [--limit N] [--unranked]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.index import Index
from .operators.search import LIMIT, SearchEngine
from .sources.corpus import corpus, read_queries


def answer(engine: SearchEngine, query: str, limit: int, ranked: bool | None) -> str:
    """Count and rows of one query."""
    total, rows = engine.counted(query, limit, ranked)
    return "\n".join([f"Found {total} docs.", *[f"{r['rank']}. {r['title']} ({r['url']})" for r in rows]])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexisweave")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("--documents", required=True)
    build.add_argument("--out", default="index")
    build.add_argument("--limit", type=int, default=0)
    search = commands.add_parser("search")
    search.add_argument("--index", default="index")
    search.add_argument("--query")
    search.add_argument("--input-file")
    search.add_argument("--output-file")
    search.add_argument("--limit", type=int, default=LIMIT)
    search.add_argument("--unranked", action="store_true")
    got = parser.parse_args(args)

    spark = SparkSession.builder.appName("lexisweave").getOrCreate()
    if got.command == "index":
        docs = corpus(spark.read.parquet(got.documents))
        Index.build(docs.orderBy("doc_id").limit(got.limit) if got.limit else docs).save(got.out)
        return 0
    engine = SearchEngine(Index.load(spark, got.index))
    if got.input_file:
        asked = [r["query"] for r in read_queries(spark, got.input_file).collect()]
    else:
        asked = [got.query] if got.query else (x.strip() for x in iter(sys.stdin.readline, ""))
    out = open(got.output_file, "w", encoding="utf-8") if got.output_file else sys.stdout
    try:
        for q in asked:
            if q == "exit":
                break
            if q:
                print(f"{q}\n{answer(engine, q, got.limit, False if got.unranked else None)}\n", file=out, flush=True)
    finally:
        if got.output_file:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
