"""Registered corpus-curation queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_benchmark_text
from .exact_dedup import exact_dedup
from .language_id import identify, train
from .license_scan import license_digest, scan_licenses
from .mixing import mix
from .quality import classify
from .quality import train as train_quality
from .secret_scan import scan_secrets, secret_digest
from .simhash import simhash_groups
from .token_files import read_token_files, write_token_files
from .warc import read_warc, resolve_revisits, write_warc

#: Vocabulary of op8 and the id that ends each document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_dedup(_table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


#: Production mix: three domains of sources, their languages, and the sources in them, which weigh alike.
DOMAINS = ("web", "books", "code")
MIX_WEIGHTS = ({"web": 0.5, "books": 0.3, "code": 0.2}, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}, {})
MIX_SHARE = 0.8


def mix_path() -> dict[str, Column]:
    """Domain (by the number in a source's name), language and source."""
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]+)", 1).try_cast("int"), F.lit(0))
    return {"domain": F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % 3 + 1).cast("int")), "lang": F.col("lang"), "source": F.col("source")}


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), mix_path(), MIX_WEIGHTS, budget_share=MIX_SHARE)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = train(docs, held_out)
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, train_quality(docs))
    return found.select("doc_id", "quality.label", "quality.score", "quality.keep")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(read_warc(write_warc(_table(spark, sf_dir, "pages")), with_payload=False))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return read_token_files(spark, files).withColumnRenamed("id", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_text(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op1_mix": op1_mix, "op2_language_id": op2_language_id, "op3_license_scan": op3_license_scan, "op4_quality": op4_quality, "op5_secret_scan": op5_secret_scan, "op6_simhash_dedup": op6_simhash_dedup, "op7_warc": op7_warc, "op8_token_files": op8_token_files, "op9_exact_dedup": op9_exact_dedup, "op10_decontaminate": op10_decontaminate}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _mix_sql() -> str:
    """Water-filling level by level, then the seeded order of each leaf by one running sum."""
    path = ["domain", "lang", "source"]
    case = lambda col, table: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END" if table else "1.0"
    steps = []
    for depth, table in enumerate(MIX_WEIGHTS, 1):
        names, parent = ", ".join(path[:depth]), path[: depth - 1]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        given = f"(SELECT budget FROM b{depth - 1} AS a WHERE {' AND '.join(f'a.{p} = n.{p}' for p in parent)})" if parent else f"least({MIX_SHARE} * (SELECT sum(tokens) FROM leaves), (SELECT sum(cap) FROM n1))"
        on = " AND ".join(f"l.{p} = s.{p}" for p in parent) or "true"
        steps.append(f"""
        n{depth} AS (SELECT {names}, {path[depth - 1]} AS name, CAST(sum(cap) AS DOUBLE) AS cap, CAST({case(path[depth - 1], table)} AS DOUBLE) AS weight FROM leaves GROUP BY ALL),
        l{depth} AS (
            SELECT n.*, cap / weight AS fill, ({given} - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER w - coalesce(sum(weight) OVER o, 0)) AS level
            FROM n{depth} AS n WINDOW w AS ({by}), o AS ({by} ORDER BY cap / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s{depth} AS (SELECT {"".join(p + ", " for p in parent)} arg_min(level, fill) AS stop FROM l{depth} WHERE level <= fill GROUP BY ALL),
        b{depth} AS (SELECT {", ".join("l." + p for p in path[:depth])}, CASE WHEN s.stop IS NULL THEN cap ELSE least(cap, greatest(0.0, s.stop) * weight) END AS budget FROM l{depth} AS l LEFT JOIN s{depth} AS s ON {on})""")
    return f"""
        WITH d AS (
            SELECT doc_id, ['web', 'books', 'code'][coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 3 + 1] AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS n
            FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * 4.0 AS cap FROM d GROUP BY ALL),{",".join(steps)},
        p AS (
            SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(round(budget, 3)) AS BIGINT) // CAST(tokens AS BIGINT) ELSE 0 END AS epochs,
                CASE WHEN tokens > 0 THEN CAST(floor(round(budget, 3)) AS BIGINT) % CAST(tokens AS BIGINT) ELSE 0 END AS rest
            FROM leaves JOIN b3 USING (domain, lang, source)),
        o AS (
            SELECT d.*, epochs, rest, coalesce(sum(n) OVER (
                PARTITION BY domain, lang, source ORDER BY md5('mix:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN p USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, epoch, n AS n_tokens, n AS take_tokens FROM (SELECT *, unnest(generate_series(0, epochs - 1)) AS epoch FROM o)
        UNION ALL
        SELECT doc_id, domain, lang, source, epochs, n, CAST(least(n, rest - before) AS BIGINT) FROM o WHERE before < rest"""


ORACLES = {
    "op1_mix": _mix_sql(),
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM d""",
    "op9_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM documents JOIN g ON coalesce(text, '') = t""",
    "op10_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT item, least(10, len(w)) AS m, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS k
            FROM b, generate_series(0, greatest(len(w) - 10, 0)) AS g(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT m FROM win),
        places AS (
            SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS k
            FROM (SELECT doc_id, w, m, unnest(generate_series(0, len(w) - m)) AS i FROM d, sizes WHERE len(w) >= m)),
        hit AS (SELECT DISTINCT doc_id, p.m, i, item FROM places p JOIN win USING (m, k)),
        covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(generate_series(0, m - 1)) AS pos FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
            sha256(coalesce(items.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
