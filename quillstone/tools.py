"""What a user asks for, each as one function over tables: verify a text, check a source, compare sources, research, recall.

A corpus is a table of documents (doc_id, text[, url, author, published_at]). A Graph ties these to a store, so that what is verified once
is known later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dates, lineage, recall, research, sources, verify
from .operators.graphs import cut
from .sources.store import SCHEMAS, Store, claim_rows, replace_rows


class Graph:
    """Known claims, searched by words and names. With a store, claims are written through to it and read again by ``reload``."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store
        self.claims = spark.createDataFrame([], SCHEMAS["claims"])
        self.reload()

    def reload(self) -> DataFrame:
        if self.store is not None:
            self.claims = self.store.table("claims")
        return self.claims

    def add(self, incoming: DataFrame) -> DataFrame:
        """Adds claims (id, text, verdict, confidence, ics, now); those without an id or a text are left out."""
        if self.store is not None:
            self.store.put_claims(incoming)
            return self.reload()
        self.claims = cut(replace_rows(self.claims, claim_rows(incoming, self.claims).select(*self.claims.columns)))
        return self.claims

    def recall(self, queries: DataFrame, now: int, limit: int = 8, fresh_only: bool = True) -> DataFrame:
        """As recall.hybrid_recall, for queries (query_id, query)."""
        return recall.hybrid_recall(queries, self.claims, now, limit, fresh_only)

    def connect(self, source: list[str], target: list[str], most: int = 3) -> list:
        return recall.connect(recall.entity_index(self.claims), source, target, most)


def verify_text(text: str, docs: DataFrame, search: verify.Gather | None = None, graph: Graph | None = None, now: int = 0) -> verify.Verification:
    """Grades the claims of one text; with a graph, those that evidence was found for are kept there."""
    spark = docs.sparkSession
    claims = verify.atomize(spark.createDataFrame([("text", text)], "id string, text string")).select("claim_id", "claim")
    out = verify.verify(claims, docs, search)
    if graph is not None:
        known = out.claims.filter("verdict <> 'UNVERIFIED'")
        graph.add(known.select(T.short_id(F.col("claim")).alias("id"), F.col("claim").alias("text"), "verdict", F.col("confidence").cast("double").alias("confidence"), F.col("ics").cast("int").alias("ics"), F.lit(now).cast("long").alias("now")))
    return out


def check_source(pages: DataFrame, now: int) -> DataFrame:
    """(url, kind, is_primary, credibility, slop, published, date_confidence, warnings) of pages (url, html)."""
    signals = pages.select("url", "html", *(F.lit(None).cast("string").alias(c) for c in ("last_modified", "http_date")), F.lit(None).cast("long").alias("wayback"))
    dated = dates.resolve_dates(signals, F.lit(now)).withColumn("text", T.strip_html(T.clamp(F.coalesce("html", F.lit("")))))
    rated = sources.with_credibility(dated.withColumn("published_at", F.col("dates.effective")))
    return rated.select("url", "credibility.kind", "credibility.is_primary", F.col("credibility.score").alias("credibility"), F.col("slop.score").alias("slop"), F.col("dates.effective").alias("published"), F.col("dates.confidence").alias("date_confidence"), F.concat("credibility.warnings", "dates.warnings").alias("warnings"))


def compare_sources(docs: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: how many sources and independent origins; each source's component and origin) of documents (id, text[, published_at,
    url]) and their links (id, url)."""
    edges = cut(lineage.lineage_edges(docs, links) if links is not None else lineage.similarity_edges(docs))
    traced = cut(lineage.lineage(docs, edges))
    return lineage.summary(traced), traced


def deep_research(question: str, docs: DataFrame, search: verify.Gather | None = None, mode: str = "standard", graph: Graph | None = None, now: int = 0) -> research.Research:
    """Research over a corpus. With a graph, parts that are known and fresh say so, and what is found is kept."""
    out = research.research(question, docs, search or verify.corpus_gatherer(docs), mode, recalled=None if graph is None else lambda asked: graph.recall(asked, now, 3))
    if graph is not None and (found := research.canonical_claims(out)):
        rows = docs.sparkSession.createDataFrame([(c["text"], c["verdict"], float(c["confidence"]), int(c["ics"])) for c in found], "text string, verdict string, confidence double, ics int")
        graph.add(rows.select(T.short_id(F.col("text")).alias("id"), "*", F.lit(now).cast("long").alias("now")))
    return out


def research_recall(query: str, graph: Graph, now: int, include_stale: bool = False, limit: int = 8) -> DataFrame:
    """Known claims for a query, best first; stale ones only if asked for, and marked by ``fresh``."""
    asked = graph.spark.createDataFrame([("q", query)], "query_id string, query string")
    return graph.recall(asked, now, limit, not include_stale).orderBy("rank").select("id", "text", "verdict", "confidence", "fresh", "rank")
