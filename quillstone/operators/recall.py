"""Retrieval: ranked by words, by shared names, and by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .graphs import cut, shortest_path


def _ranked(df: DataFrame, by: str, *order: Column, limit: int | None) -> DataFrame:
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return r if limit is None else r.filter(F.col("rank") <= limit)


#: Up to so many words of queries, each counted once a query, go to every task; more meet the texts' words by shuffled joins.
SENT = 200_000


def bm25(queries: DataFrame, docs: DataFrame, k1: float = C.BM25_K1, b: float = C.BM25_B, limit: int | None = 10) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query) against docs (id, text): repeated query words count each time, ties go
    to the least id. Texts are split once; only postings of words that some query holds are kept."""
    q = cut(queries.select("query_id", F.explode(T.retrieval_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    sent = F.broadcast if q.count() <= SENT else lambda x: x
    # each text also has the empty word once, which stands for the text itself: its postings give the number of texts and their lengths
    own = q.sparkSession.range(1).select(F.lit("").alias("token"))
    d = docs.select("id", T.retrieval_tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("len"), F.explode(F.concat("t", F.array(F.lit("")))).alias("token"))
    kept = d.join(sent(q.select("token").distinct().unionByName(own)), "token", "left_semi")
    # dealt by text, so that all words of a query that a text holds meet in one task
    p = cut(kept.repartition("id").groupBy("token", "id", "len").agg(F.count("*").alias("tf")))
    totals = p.filter("token = ''").agg(F.sum("tf").alias("N"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    df = p.groupBy("token").agg(F.count("*").alias("df"))
    asked = cut(q.join(df, "token").crossJoin(F.broadcast(totals)))  # one row of totals
    hits = p.join(sent(asked), "token")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    s = hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("times") * idf * tf), 6).alias("score"))
    return _ranked(s, "query_id", F.desc("score"), F.asc("id"), limit=limit)


def reciprocal_rank_fusion(rankings: DataFrame, k: int = C.RRF_K) -> DataFrame:
    """(query_id, id, score) from (query_id, id, rank) rows of several lists, ranks from 1."""
    return rankings.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def entity_index(claims: DataFrame) -> DataFrame:
    """(entity, id): each claim's names in lower case, from claims (id, text)."""
    return claims.filter("id is not null and text is not null").select(F.explode(F.transform(T.entities(F.col("text")), F.lower)).alias("entity"), "id").distinct()


def entity_matches(queries: DataFrame, index: DataFrame, limit: int | None = 10) -> DataFrame:
    """(query_id, id, overlap, rank): claims by the number of names shared with a query, ties to the least id."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.transform(T.entities(F.col("query")), F.lower))).alias("entity")).distinct()
    s = q.join(index, "entity").groupBy("query_id", "id").agg(F.count("*").alias("overlap"))
    return _ranked(s, "query_id", F.desc("overlap"), F.asc("id"), limit=limit)


def hybrid_recall(queries: DataFrame, claims: DataFrame, now: int, limit: int = 8, fresh_only: bool = True) -> DataFrame:
    """(query_id, id, text, verdict, confidence, fresh, score, rank) from claims (id, text, verdict, confidence, last_verified[,
    volatility]): both rankings, three times as long as the result, are fused; stale claims go; the best ``limit`` stay."""
    kind = F.coalesce(F.col("volatility"), T.volatility(F.col("text"))) if "volatility" in claims.columns else T.volatility(F.col("text"))
    lists = bm25(queries, claims, limit=3 * limit).select("query_id", "id", "rank").unionByName(entity_matches(queries, entity_index(claims), 3 * limit).select("query_id", "id", "rank"))
    fused = reciprocal_rank_fusion(lists)
    c = claims.select("id", "text", F.coalesce("verdict", F.lit("UNVERIFIED")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), T.is_fresh(F.col("last_verified"), kind, F.lit(now)).alias("fresh"))
    found = fused.join(c, "id")
    return _ranked(found.filter("fresh") if fresh_only else found, "query_id", F.desc("score"), F.asc("id"), limit=limit)


def neighbours(index: DataFrame) -> DataFrame:
    """(entity, id, hub): claims that share a name, through the name's least claim. A name that n claims share gives n rows; two claims
    are neighbours if they have a row with the same entity and differ."""
    hub = index.groupBy("entity").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return index.join(hub, "entity").select("entity", "id", "hub")


def connect(index: DataFrame, source: list[str], target: list[str], most: int = 3) -> list:
    """Claim ids on a shortest chain of claims that share names, from one that holds a name of ``source`` to one that holds a name of
    ``target``; empty if there is none of at most ``most`` steps. All claims with such a name start and end it.

    Claims and names form a bipartite graph, in which a step is claim - name - claim; so a name of n claims costs 2n edges.
    """
    spark = index.sparkSession
    # nodes of either kind have one type; claims keep that of their ids, so that ties go to the least id
    claim = F.struct(F.col("id").alias("claim"), F.lit("").alias("name"))
    name = F.struct(F.lit(None).cast(index.schema["id"].dataType).alias("claim"), F.col("entity").alias("name"))

    def ends(names: list[str]) -> DataFrame:
        wanted = spark.createDataFrame([(n.lower(),) for n in names], "entity string").distinct()
        return index.join(wanted, "entity").select(claim.alias("id")).distinct()

    edges = index.select(claim.alias("source"), name.alias("target")).unionByName(index.select(name.alias("source"), claim.alias("target")))
    path = shortest_path(edges, ends(source), ends(target), 2 * most)
    return [str(p["claim"]) for p in path[::2]]
