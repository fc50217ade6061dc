"""Corpus upkeep: freshness, content hashes, upserts, frontier steps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..sources.scratch import scratch_dir

MIN_WORDS = 400
#: A word of a text: white space is what Unicode calls so, and the four ASCII separators.
UNICODE_WORD = r"(?U)[^\s\x1c-\x1f]+"
#: Columns of a saved document.
RECORD = ["url", "source", "raw_content", "raw_sha256", "parsed_text", "title", "fetched_at", "checked_at", "method"]


def content_hash(raw: Column) -> Column:
    """SHA-256 of the content, in hex."""
    return F.sha2(raw, 256)


def fresh(fetched_at: Column, now: int | Column, ttl: int) -> Column:
    """Whether a document was fetched less than ttl seconds ago; false without a ttl or a time."""
    if ttl <= 0:
        return F.lit(False)
    return F.coalesce((fetched_at > 0) & (F.lit(now) - fetched_at < ttl), F.lit(False))


def upsert(existing: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """existing and fetched (same columns, with raw_sha256, fetched_at, checked_at) merged by key.

    Content that hasn't changed only gets the new checked_at; changed or new content replaces the row. Of repeated keys in fetched the latest
    counts. One aggregate by key: each side has at most a few rows a key.
    """
    columns = existing.columns
    rest = [c for c in columns if c != key]
    both = existing.select(key, F.struct(*rest).alias("r"), F.lit(0).alias("side")).unionByName(fetched.select(key, F.struct(*rest).alias("r"), F.lit(1).alias("side")))
    newest = lambda side: F.max_by(F.when(F.col("side") == side, F.col("r")), F.when(F.col("side") == side, F.struct("r.fetched_at", "r.raw_sha256")))
    merged = both.groupBy(key).agg(newest(0).alias("old"), newest(1).alias("new"))
    same = F.col("old.raw_sha256") == F.col("new.raw_sha256")

    def value(c: str) -> Column:
        kept = F.when(F.col("new").isNull() | (F.col("old").isNotNull() & same), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        return (F.when(F.col("new").isNotNull(), F.col("new.checked_at")).otherwise(F.col("old.checked_at")) if c == "checked_at" else kept).alias(c)

    return merged.select(*[F.col(key) if c == key else value(c) for c in columns])


def import_new(existing: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """Rows of found whose key existing doesn't have."""
    return found.join(existing.select(key), key, "left_anti")


def word_count(text: Column) -> Column:
    """White-space separated words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(UNICODE_WORD)), F.lit(0))


def enough_words(text: Column, least: int = MIN_WORDS) -> Column:
    """Whether a text has at least so many white-space separated words."""
    return word_count(text) >= least


def new_titles(found: DataFrame, seen: DataFrame, col: str = "title") -> DataFrame:
    """Titles that aren't empty, hold no colon, and whose lower-cased file name isn't in seen; one row a name."""
    name = F.lower(H.safe_name(F.col(col)))
    rows = found.where((F.trim(col) != "") & ~F.col(col).contains(":")).withColumn("__name", name)
    known = seen.select(F.lower(H.safe_name(F.col(col))).alias("__name"))
    return rows.join(known, "__name", "left_anti").dropDuplicates(["__name"]).drop("__name")


def quota(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each group, by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def within_target(rows: DataFrame, group: str, groups: Sequence[str], order: Sequence[str], per_group: int, target: int, have: int = 0) -> DataFrame:
    """Rows that a collection takes which visits the groups in the order of `groups`: at most per_group of each, by order, until it holds target.

    have is what it holds already. Rows of other groups are left out. Only one row a group is summed up in one place.
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)]), F.col(group))
    numbered = rows.where(F.col(group).isin(list(groups))).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= per_group)
    taken = numbered.groupBy(group).agg(F.count("*").alias("__c"))
    before = taken.select(group, (F.sum("__c").over(Window.orderBy(number)) - F.col("__c")).alias("__before"))  # one row a group
    return numbered.join(F.broadcast(before), group).where(F.col("__n") + F.col("__before") <= target - have).drop("__n", "__before")


def articles(found: DataFrame, seen: DataFrame, groups: Sequence[str], per_group: int, target: int, least: int = MIN_WORDS) -> DataFrame:
    """(name, category, meta, article): what is stored of found (title, url, category, place, text).

    Titles that are empty or hold a colon, texts of fewer than `least` words, and names that seen (name) has are left out; of repeated names
    the first by group and place counts. meta is the JSON of title, url, category and word_count, article the text under its header lines.
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)]), F.col("category"))
    good = found.where((F.col("title") != "") & ~F.col("title").contains(":") & enough_words(F.col("text"), least) & F.col("category").isin(list(groups)))
    named = good.withColumn("name", H.safe_name(F.col("title"))).withColumn("__key", F.lower("name"))
    new = named.join(seen.select(F.lower("name").alias("__key")).distinct(), "__key", "left_anti")
    first = new.groupBy("__key").agg(F.min_by(F.struct(*found.columns, "name"), F.struct(number, "place", "url")).alias("r")).select("r.*")
    taken = within_target(first, "category", groups, ["place", "url"], per_group, target, seen.select(F.lower("name")).distinct().count())
    meta = F.to_json(F.struct("title", "url", "category", word_count(F.col("text")).alias("word_count")))
    head = F.concat(F.lit("Title: "), "title", F.lit("\nURL: "), "url", F.lit("\nSource: Wikipedia\nCategory: "), "category", F.lit("\n\n"), "text")
    return taken.select("name", "category", meta.alias("meta"), head.alias("article"))


def write_articles(rows: DataFrame, folder: str) -> int:
    """Write <name>.json (meta) and <name>.txt (article) of each row under raw/ and text/ of the folder; returns their number.

    Files are written by the tasks under hidden names and moved into place, so a repeated task leaves no half of a file.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for sub in ("raw", "text"):
            system.create_dir(f"{root}/{sub}", recursive=True)
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                for path, value in ((f"{root}/raw/{r['name']}.json", r["meta"]), (f"{root}/text/{r['name']}.txt", r["article"])):
                    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(value.encode("utf-8", "replace"))
                    system.move(part, path)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return rows.select("name", "meta", "article").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Source:
    """Rules of a web source; patterns are searched anywhere in the URL, and an empty document pattern takes every page.

    closed_references: titles and texts undo only HTML references that end with a semicolon.
    """

    allowed_domains: list[str]
    doc_url_regex: str = ""
    follow_url_regex: str = ""
    seeds: list[str] = field(default_factory=list)
    max_articles: int = 0
    name: str = "web"
    method: str = "web"
    closed_references: bool = False

    @classmethod
    def of(cls, settings: Mapping) -> Source:
        """The source of one entry of a configuration's list; settings that are missing or empty have their default."""
        known = {k: settings[k] for k in ("doc_url_regex", "follow_url_regex", "name", "method") if settings.get(k)}
        return cls(list(settings.get("allowed_domains") or []), seeds=[str(s) for s in settings.get("seeds") or []], max_articles=int(settings.get("max_articles") or 0), **known)

    def is_doc(self, url: Column) -> Column:
        return url.rlike(self.doc_url_regex) if self.doc_url_regex else F.lit(True)

    def wanted(self, url: Column) -> Column:
        """Pages worth a visit: allowed domain, no file, and a document or one to follow."""
        ok = H.domain_allowed(url, self.allowed_domains) & H.page_like(url)
        return ok & (self.is_doc(url) | url.rlike(self.follow_url_regex)) if self.follow_url_regex else ok


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of every link of every page: normalised, repeats kept."""
    return pages.select("page_id", "url", F.explode(H.hrefs(F.col("html"))).alias("href")).select("page_id", H.links(F.col("url"), F.col("href")).alias("link")).where("link is not null")


def _written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: plans of later rounds start there."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seed_frontier(spark: SparkSession, source: Source) -> DataFrame:
    """(url, place): the source's seeds, normalised, in their order."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(source.seeds)], "i long, s string")
    return rows.select(H.normalize_url(F.col("s")).alias("url"), F.array("i").alias("place")).where("url is not null")


def crawl_step(frontier: DataFrame, visited: DataFrame, pages: DataFrame, source: Source, existing: DataFrame, now: int, ttl: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of a breadth-first crawl: (next frontier, visited, documents fetched). The round's visits are written to the shared folder.

    frontier (url, and place where it is known) and visited hold urls, pages (page_id, url, html) what a fetch returns. A page is visited
    once, if wanted. Its links are followed whether or not it is a document. A document's url is the page's without its query; of a round's
    pages with one document url the first by place, then url, then page_id counts (pages may hold a url several times), and a document that is fresh in existing (url, fetched_at) isn't fetched.

    place is an array of numbers: the seed's number, then that of each link on its page. Its order is the order of a queue's visits within a round.
    """
    if "place" not in frontier.columns:
        frontier = frontier.withColumn("place", F.array().cast("array<bigint>"))
    todo = frontier.groupBy("url").agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti").where(source.wanted(F.col("url")))
    todo = _written(todo, "crawl-visits")  # all results are taken from it
    seen = visited.select("url").unionByName(todo.select("url"))
    got = pages.select("page_id", H.normalize_url(F.col("url")).alias("url"), "html").join(todo, "url")
    found = got.select("url", "place", F.posexplode(H.hrefs(F.col("html"))).alias("at", "href")).select(H.links(F.col("url"), F.col("href")).alias("link"), F.concat("place", F.array(F.col("at").cast("long"))).alias("place")).where("link is not null")
    follow = found.groupBy(F.col("link").alias("url")).agg(F.min("place").alias("place")).join(seen, "url", "left_anti")
    first = got.where(source.is_doc(F.col("url"))).groupBy(H.strip_query(F.col("url")).alias("doc")).agg(F.min_by(F.struct("html", "place"), F.struct("place", "url", F.col("page_id").isNull(), "page_id", F.xxhash64("html"))).alias("p"))
    current = existing.where(fresh(F.col("fetched_at"), now, ttl)).select(F.col("url").alias("doc"))
    docs = first.join(current, "doc", "left_anti").select(
        F.col("doc").alias("url"), F.col("p.html").alias("raw_content"), content_hash(F.col("p.html")).alias("raw_sha256"), H.html_to_text(F.col("p.html"), source.closed_references).alias("parsed_text"), H.html_title(F.col("p.html"), source.closed_references).alias("title"),
        F.lit(now).cast("long").alias("fetched_at"), F.lit(now).cast("long").alias("checked_at"), F.col("p.place").alias("place"))
    return follow, seen, docs


def records(docs: DataFrame, source: Source) -> DataFrame:
    """Documents of crawl_step as saved: with the source's name, the method, and the url as title where the page has none."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("url")).otherwise(F.col("title"))
    return docs.withColumn("title", title).withColumn("source", F.lit(source.name)).withColumn("method", F.lit("web")).select(*RECORD)


def crawl(pages: DataFrame, source: Source, existing: DataFrame, now: int, ttl: int, seeds: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """existing (columns RECORD) after a breadth-first crawl from the source's seeds, or from seeds (url, place), until no page is left.

    max_articles, where it is over 0, ends the crawl at the page that saves so many documents: content that is new or has changed counts,
    a document that is fresh or only checked doesn't. Every round is written to the shared folder, so plans stay short; rounds are as
    many as the longest chain of links. Only counts and one place of a round reach the driver.
    """
    frontier = seeds if seeds is not None else seed_frontier(pages.sparkSession, source)
    visited, saved = frontier.select("url").where("false"), 0
    collection = existing.select(*RECORD)
    for n in range(max_rounds):
        follow, seen, docs = crawl_step(frontier, visited, pages, source, collection, now, ttl)
        docs = _written(docs, f"crawl-docs-{n}")
        changed = docs.join(collection.select("url", "raw_sha256"), ["url", "raw_sha256"], "left_anti")
        count = changed.count()
        last = source.max_articles and saved + count >= source.max_articles
        if last:
            # the page that saves the last document ends the crawl
            end = changed.orderBy("place", "url").limit(source.max_articles - saved).agg(F.max(F.struct("place", "url")).alias("end"))
            docs = docs.join(F.broadcast(end)).where(F.struct("place", "url") <= F.col("end")).drop("end")
        collection = _written(upsert(collection, records(docs, source)), f"crawl-collection-{n}")
        if last:
            return collection
        saved += count
        visited, frontier = _written(seen, f"crawl-visited-{n}"), _written(follow, f"crawl-frontier-{n}")
        if frontier.isEmpty():
            return collection
    raise RuntimeError(f"the crawl did not end after {max_rounds} rounds")


def crawl_sources(pages: DataFrame, config: Mapping, existing: DataFrame, now: int, only: str = "") -> DataFrame:
    """existing after crawls of the configuration's sources in their order, or of the one named `only`. Entries that aren't mappings and sources of the encyclopedia's API are passed over."""
    ttl = int((config.get("crawler") or {}).get("cache_ttl_s") or 0)
    for settings in config.get("sources") or []:
        if not isinstance(settings, Mapping) or only and settings.get("name", "") != only:
            continue
        source = Source.of(settings)
        if source.method != "wikipedia":
            existing = crawl(pages, source, existing, now, ttl)
    return existing


def write_collection(docs: DataFrame, path: str) -> None:
    """Saved documents in folders by source, each sorted by fetched_at so that file statistics find a span of time. A source may be spread over many tasks."""
    docs.repartitionByRange("source", "fetched_at", "url").sortWithinPartitions("source", "fetched_at").write.mode("overwrite").partitionBy("source").parquet(path)


def collection_between(spark: SparkSession, path: str, sources: Iterable[str], since: int, until: int) -> DataFrame:
    """Saved documents of the sources fetched at since or later and before until; other sources' folders aren't listed, and row groups are pruned by time."""
    return spark.read.parquet(path).where(F.col("source").isin(list(sources)) & (F.col("fetched_at") >= since) & (F.col("fetched_at") < until))
