"""A lexical judge: which sentence of a document bears on a claim, and whether for or against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def stance(sentence: Column) -> Column:
    """refute where more cues of negation than of affirmation occur, else support."""
    low = F.lower(sentence)
    count = lambda cues: reduce(Column.__add__, (F.contains(low, F.lit(c)).cast("int") for c in cues))
    return F.when(count(C.NEGATION_CUES) > count(C.AFFIRMATION_CUES), "refute").otherwise("support")


def judge(pairs: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, verdict, quote, score) of pairs (claim_id, doc_id), claims (claim_id, claim) and docs (doc_id, text).

    A claim's words weigh by their rarity among the document's own sentences, ln(1 + sentences / those with the word), unknown ones 1
    each; a sentence scores the share of the weight that it holds, and up to a quarter more for the claim's figures. The best sentence,
    the first of equals, is the quotation. Each pair's claim words meet its document's words by equi-join; no pair of words and
    sentences is tried that has nothing in common. Pairs without a document, or with an empty claim, are NEUTRAL with score 0.
    """
    pairs = pairs.select("claim_id", "doc_id").distinct()
    used = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    sents = used.select("doc_id", T.quotable(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("pos", "sentence"))
    tokens = sents.select("doc_id", "n", "pos", F.explode(F.array_distinct(T.content_tokens(F.col("sentence")))).alias("token"))
    idf = tokens.groupBy("doc_id", "token").agg(F.log(1 + F.max("n") / F.count("*")).alias("w"), F.collect_list("pos").alias("at"))
    c = claims.select("claim_id", "claim", T.figures(F.col("claim")).alias("figures"))
    words = c.select("claim_id", F.explode(T.content_tokens(F.col("claim"))).alias("token")).groupBy("claim_id", "token").agg(F.count("*").alias("times"))
    asked = pairs.join(words, "claim_id").join(idf, ["doc_id", "token"], "left").withColumn("weight", F.col("times") * F.coalesce("w", F.lit(1.0)))
    total = asked.groupBy("claim_id", "doc_id").agg(F.sum("weight").alias("total"))
    hit = asked.select("claim_id", "doc_id", "weight", F.explode("at").alias("pos")).groupBy("claim_id", "doc_id", "pos").agg(F.sum("weight").alias("matched"))
    # sentences that share only figures with the claim count too
    numbers = sents.select("doc_id", "pos", F.explode(T.figures(F.col("sentence"))).alias("figure")).join(tokens.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_semi")
    figured = pairs.join(c.select("claim_id", F.size("figures").alias("k"), F.explode("figures").alias("figure")), "claim_id").join(numbers, ["doc_id", "figure"]).groupBy("claim_id", "doc_id", "pos").agg((F.count("*") / F.max("k")).alias("share"))
    scored = hit.join(figured, ["claim_id", "doc_id", "pos"], "full").join(total, ["claim_id", "doc_id"])
    base = F.coalesce("matched", F.lit(0.0)) / F.col("total")
    scored = scored.withColumn("score", F.round(F.when(F.col("share").isNotNull(), F.least(F.lit(1.0), base + C.FIGURE_BONUS * F.col("share"))).otherwise(base), 9))
    best = scored.groupBy("claim_id", "doc_id").agg(F.min(F.struct(-F.col("score"), F.col("pos"))).alias("b")).select("claim_id", "doc_id", (-F.col("b.col1")).alias("score"), "b.pos")
    out = pairs.join(best.join(sents.select("doc_id", "pos", "sentence"), ["doc_id", "pos"]), ["claim_id", "doc_id"], "left")
    score = F.coalesce("score", F.lit(0.0))
    verdict = F.when(score < C.RELEVANCE_FLOOR, "NEUTRAL").when(stance(F.col("sentence")) == "refute", "CONTRADICTED").when(score >= C.SUPPORT_THRESHOLD, "SUPPORTED").otherwise("PARTIAL")
    return out.select("claim_id", "doc_id", verdict.alias("verdict"), F.when(score < C.RELEVANCE_FLOOR, "").otherwise(F.left("sentence", F.lit(C.MAX_QUOTE))).alias("quote"), F.round(score, 3).alias("score"))


def capabilities(search: object, llm: object = None, fetch: object = True) -> dict:
    """What a session can do with the services it was given, and what it lacks."""
    lacks = [
        *([] if search else ["No web-search service: the engine cannot discover sources."]),
        *([] if llm else ["No language model: claims are judged and questions are split by rules."]),
        *([] if fetch is not False else ["No page fetcher: only search snippets can be used as evidence."]),
    ]
    return {"search": bool(search), "fetch": fetch is not False, "llm": bool(llm), "judge_kind": "llm" if llm else "lexical", "planner_kind": "llm" if llm else "heuristic", "usable": bool(search), "degraded": lacks}
