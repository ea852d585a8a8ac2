"""From text to graded claims: statements are cut out, evidence is gathered, judged, anchored and weighed by independent origins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .anchoring import with_anchor
from .graphs import cut
from .judging import judge
from .lineage import ics_by_group, quote_edges, similarity_edges
from .recall import bm25
from .sources import with_credibility
from .verdicts import confidence

#: From queries (query_id, query) to hits (query_id, doc_id, rank); from pairs, claims and docs to judgments, as judging.judge.
Gather = Callable[[DataFrame], DataFrame]
Judge = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def atomize(texts: DataFrame) -> DataFrame:
    """(id, pos, claim_id, claim): check-worthy sentences of texts (id, text). Places count sentences that are not check-worthy too."""
    s = texts.select("id", F.posexplode(T.claim_sentences(F.col("text"))).alias("pos", "claim")).filter(T.is_checkworthy(F.col("claim")))
    return s.select("id", "pos", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string")).alias("claim_id"), "claim")


def corpus_gatherer(docs: DataFrame, most: int = 6) -> Gather:
    """Searches a corpus (doc_id, text) by BM25, where no web search is at hand."""
    return lambda queries: bm25(queries, docs.select(F.col("doc_id").alias("id"), "text"), limit=most).select("query_id", F.col("id").alias("doc_id"), "rank")


def gather(claims: DataFrame, search: Gather, most: int = 6, templates: tuple[str, ...] = C.GATHER_QUERIES) -> DataFrame:
    """(claim_id, doc_id, place): the first ``most`` documents over all queries of a claim, in order of query and rank."""
    q = claims.select("claim_id", F.posexplode(F.array(*(T.fill(t, F.col("claim")) for t in templates))).alias("n", "query"))
    q = q.select(F.struct("claim_id", "n").alias("key"), "query")
    # equal keys name one query, so a search engine that knows plain ids only can serve
    hits = search(q.select(F.to_json("key").alias("query_id"), "query"))
    placed = hits.withColumn("key", F.from_json("query_id", q.schema["key"].dataType.simpleString())).select("key.claim_id", "doc_id", F.struct("key.n", "rank").alias("at"))
    first = placed.groupBy("claim_id", "doc_id").agg(F.min("at").alias("at"))
    lists = first.groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), 1, most).alias("l"))
    return lists.select("claim_id", F.posexplode("l").alias("place", "x")).select("claim_id", "x.doc_id", "place")


@dataclass
class Verification:
    """claims: (claim_id, claim, verdict, confidence, ics, source_count, volatility); citations: (claim_id, doc_id, verdict, quote,
    anchor, credibility); totals: one row."""

    claims: DataFrame
    citations: DataFrame
    totals: DataFrame


def verify(claims: DataFrame, docs: DataFrame, search: Gather | None = None, judged_by: Judge = judge) -> Verification:
    """Grades claims (claim_id, claim) against docs (doc_id, text[, url, author, published_at]).

    Every judged document counts as a proposed citation; one whose quotation cannot be found is rejected, as an empty one is. Support
    is counted in independent origins among a claim's supporting documents. A claim without evidence is UNVERIFIED.
    """
    claims = claims.select("claim_id", "claim")
    pairs = cut(gather(claims, search or corpus_gatherer(docs)))
    own = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    if "url" not in own.columns:
        own = own.withColumn("url", F.lit(None).cast("string"))
    judged = judged_by(pairs, claims, own)
    anchored = cut(with_anchor(judged.join(own.select("doc_id", "text"), "doc_id")).drop("text"))
    rated = with_credibility(own).select("doc_id", F.col("credibility.score").alias("credibility"))
    cited = cut(anchored.filter(F.col("anchor.ok") & F.col("verdict").isin("SUPPORTED", "PARTIAL", "CONTRADICTED")).join(rated, "doc_id"))
    support = cited.filter("verdict <> 'CONTRADICTED'").select(F.col("claim_id").alias("group"), F.col("doc_id").alias("id"))
    texts = own.select(F.col("doc_id").alias("id"), "text", *(["published_at"] if "published_at" in own.columns else [])).join(support.select("id").distinct(), "id", "left_semi")
    similar = cut(similarity_edges(texts))
    ics = ics_by_group(support, similar.unionByName(quote_edges(texts, similar)))
    has = lambda v: F.coalesce(F.max(F.col("verdict") == v), F.lit(False))
    per = cited.groupBy("claim_id").agg(has("SUPPORTED").alias("s"), has("PARTIAL").alias("p"), has("CONTRADICTED").alias("c"), F.avg("credibility").alias("mean"))
    r = claims.join(per, "claim_id", "left").join(ics.select(F.col("group").alias("claim_id"), "ics", F.col("n").alias("source_count")), "claim_id", "left").fillna(False, ["s", "p", "c"]).fillna(0, ["ics", "source_count"])
    verdict = F.when(F.col("s"), F.when(F.col("c"), "PARTIAL").otherwise("SUPPORTED")).when(F.col("p"), "PARTIAL").when(F.col("c"), "CONTRADICTED").otherwise("UNVERIFIED")
    r = r.withColumn("verdict", verdict)
    graded = r.select("claim_id", "claim", "verdict", confidence(F.col("verdict"), F.col("ics"), F.coalesce("mean", F.lit(50.0)), F.col("c")).alias("confidence"), "ics", "source_count", T.volatility(F.col("claim")).alias("volatility"))
    count = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(v.lower())
    tally = graded.agg(F.count("*").alias("total"), *map(count, ("SUPPORTED", "CONTRADICTED", "UNVERIFIED")))
    rate = anchored.agg(F.count("*").alias("proposed"), F.coalesce(F.sum((~F.col("anchor.ok")).cast("long")), F.lit(0)).alias("rejected"))
    totals = tally.crossJoin(rate).withColumn("phantom_rate", F.when(F.col("proposed") == 0, 0.0).otherwise(F.round(F.col("rejected") / F.col("proposed"), 6)))  # one row each
    return Verification(graded, cited, totals)
