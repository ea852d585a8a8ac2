"""Queries of quotations, judging, retrieval, verdicts and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import anchoring, judging, recall, reports, research, verdicts, verify
from ..operators.graphs import cut, shared_dir
from ..sources import store
from . import _sql as S
from ._registry import query, table
from .text_queries import NOW, credibility_sql, primary_ctes, slop_ctes

# Quotations: a benchmark item as it is, with other case and spacing, cut short, altered, and from a document that is missing or changed.
# Only A-Z are capitals here: the two dialects differ on what upper() makes of a sharp s.
_CAPITALS = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_MADE = f"""CASE q WHEN 0 THEN text WHEN 1 THEN {_CAPITALS.format("replace(text, ' ', '  ')")} WHEN 2 THEN left(text, 12) WHEN 3 THEN replace(text, ' ', ' x ') ELSE substring(text, 3, 60) END"""


@query("""WITH q AS (SELECT item_id, trim(text) AS quote FROM benchmark)
SELECT item_id AS quote_id, doc_id, strpos(d.text, quote) - 1 AS start FROM documents d JOIN q ON contains(d.text, quote)""")
def quote_occurrences(spark, sf_dir) -> DataFrame:
    return anchoring.occurrences(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), table(spark, sf_dir, "documents"))


_CANDIDATES = f"""o AS (SELECT item_id, doc_id, b.text AS item, d.text FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text))),
c AS (SELECT item_id, CASE WHEN q = 5 THEN -1 - doc_id ELSE doc_id END AS doc_id, q, {_MADE.replace('text', 'item')} AS quote, text FROM o, (SELECT unnest(range(6)) AS q)),
a AS (SELECT item_id, doc_id, q, quote, CASE WHEN q = 5 THEN NULL ELSE text END AS text FROM c),
r AS (SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'no document text' WHEN doc_id % 4 = 3 THEN 'integrity' WHEN length(trim(quote)) < {C.MIN_QUOTE} THEN 'quote too short'
  WHEN contains(text, trim(quote)) THEN 'exact' WHEN contains({S.normalize_claim('text')}, {S.normalize_claim('trim(quote)')}) THEN 'normalized' ELSE 'not found' END AS reason FROM a)"""


def _admitted(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    at = anchoring.occurrences(items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), docs).join(items.select(F.col("item_id").alias("quote_id"), "text"), "quote_id")
    c = at.select(F.col("quote_id").alias("item_id"), "doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("q")).withColumn("quote", F.expr(_MADE))
    c = c.select("item_id", F.when(F.col("q") == 5, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "q", "quote")
    stored = docs.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 3, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    return anchoring.admit(c, stored)


@query(f"WITH {_CANDIDATES} SELECT item_id, doc_id, q::BIGINT AS q, reason, CASE WHEN reason = 'exact' THEN strpos(text, trim(quote)) - 1 ELSE -1 END::BIGINT AS start FROM r")
def admit_citations(spark, sf_dir) -> DataFrame:
    a = F.col("anchor")
    return _admitted(spark, sf_dir).select("item_id", "doc_id", F.col("q").cast("long").alias("q"), a["reason"].alias("reason"), F.when(a["reason"] == "exact", a["start"]).otherwise(-1).alias("start"))


@query(f"WITH {_CANDIDATES} SELECT count(*) AS proposed, count(*) FILTER (reason NOT IN ('exact', 'normalized')) AS rejected, count(*) FILTER (reason NOT IN ('exact', 'normalized')) / count(*) AS phantom_rate FROM r")
def phantom_rate(spark, sf_dir) -> DataFrame:
    return anchoring.phantom_rate(_admitted(spark, sf_dir))


@query()
def fuzzy_anchor(spark, sf_dir) -> DataFrame:
    """Every benchmark item, with one word changed, in every document that holds it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    at = anchoring.occurrences(items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), docs).join(items.select(F.col("item_id").alias("quote_id"), F.regexp_replace("text", "^[^ ]+", "Changed").alias("quote")), "quote_id").join(docs.select("doc_id", "text"), "doc_id")
    a = F.col("anchor")
    return anchoring.with_anchor(at, fuzzy=True).select("quote_id", "doc_id", a["kind"].alias("kind"), F.round(a["score"], 6).alias("score"), a["start"].alias("start"), a["end"].alias("end"))


# Claims are benchmark items; documents that BM25 finds for them are the evidence.
_GATHER = ", ".join(f"({i}, {S.quoted(t)})" for i, t in enumerate(C.GATHER_QUERIES))
_EVIDENCE = f"""t(n, tpl) AS (VALUES {_GATHER}), cl AS (SELECT item_id AS claim_id, text AS claim FROM benchmark),
qs AS (SELECT (claim_id, n) AS query_id, replace(tpl, '{{}}', claim) AS query FROM cl, t), ds AS (SELECT doc_id AS id, text FROM documents), {S.bm25('qs', 'ds', 6)},
ga AS (SELECT query_id[1] AS claim_id, id AS doc_id, min((query_id[2], rank)) AS ord FROM b_top GROUP BY ALL),
pr AS (SELECT claim_id, doc_id, place FROM (SELECT claim_id, doc_id, row_number() OVER (PARTITION BY claim_id ORDER BY ord, doc_id) - 1 AS place FROM ga) WHERE place < 6)"""
_refute = " + ".join(f"contains(lower(sentence), {S.quoted(c)})::INT" for c in C.NEGATION_CUES)
_affirm = " + ".join(f"contains(lower(sentence), {S.quoted(c)})::INT" for c in C.AFFIRMATION_CUES)
_JUDGE = f"""{_EVIDENCE},
js AS (SELECT doc_id, {S.quotable('text')} AS s FROM documents SEMI JOIN pr USING (doc_id)),
se AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM js),
tk AS (SELECT DISTINCT doc_id, n, pos, unnest({S.content_tokens('sentence')}) AS token FROM se),
idf AS (SELECT doc_id, token, ln(1 + max(n)::DOUBLE / count(*)) AS w FROM tk GROUP BY ALL),
cw AS (SELECT claim_id, token, count(*) AS times FROM (SELECT claim_id, unnest({S.content_tokens('claim')}) AS token FROM cl) GROUP BY ALL),
aw AS (SELECT claim_id, doc_id, token, times * coalesce(w, 1.0) AS weight FROM pr JOIN cw USING (claim_id) LEFT JOIN idf USING (doc_id, token)),
tot AS (SELECT claim_id, doc_id, sum(weight) AS total FROM aw GROUP BY ALL),
mt AS (SELECT claim_id, doc_id, pos, sum(weight) AS matched FROM aw JOIN tk USING (doc_id, token) GROUP BY ALL),
cf AS (SELECT claim_id, list_distinct({S.figures('claim')}) AS f FROM cl), cfu AS (SELECT claim_id, len(f) AS k, unnest(f) AS fig FROM cf),
sf AS (SELECT DISTINCT doc_id, pos, unnest({S.figures('sentence')}) AS fig FROM se),
fg AS (SELECT claim_id, doc_id, pos, count(*)::DOUBLE / max(k) AS share FROM pr JOIN cfu USING (claim_id) JOIN sf USING (doc_id, fig) SEMI JOIN tk USING (doc_id, pos) GROUP BY ALL),
sc AS (SELECT claim_id, doc_id, pos, round(CASE WHEN share IS NULL THEN coalesce(matched, 0) / total ELSE least(1.0, coalesce(matched, 0) / total + {C.FIGURE_BONUS} * share) END, 9) AS score FROM mt FULL JOIN fg USING (claim_id, doc_id, pos) JOIN tot USING (claim_id, doc_id)),
bs AS (SELECT claim_id, doc_id, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM sc GROUP BY ALL),
jd0 AS (SELECT pr.claim_id, pr.doc_id, coalesce(score, 0) AS sc0, sentence FROM pr LEFT JOIN bs USING (claim_id, doc_id) LEFT JOIN se ON se.doc_id = pr.doc_id AND se.pos = bs.pos),
jd AS (SELECT claim_id, doc_id, CASE WHEN sc0 < {C.RELEVANCE_FLOOR} THEN 'NEUTRAL' WHEN {_refute} > {_affirm} THEN 'CONTRADICTED' WHEN sc0 >= {C.SUPPORT_THRESHOLD} THEN 'SUPPORTED' ELSE 'PARTIAL' END AS verdict,
  CASE WHEN sc0 < {C.RELEVANCE_FLOOR} THEN '' ELSE left(sentence, {C.MAX_QUOTE}) END AS quote, round(sc0, 3) AS score FROM jd0)"""


def _claims(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))


def _pairs(spark, sf_dir) -> DataFrame:
    return verify.gather(_claims(spark, sf_dir), verify.corpus_gatherer(table(spark, sf_dir, "documents")))


@query(f"WITH {_EVIDENCE} SELECT claim_id, doc_id, place::BIGINT AS place FROM pr")
def gather_evidence(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).select("claim_id", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_JUDGE} SELECT claim_id, doc_id, verdict, quote, score FROM jd")
def lexical_judge(spark, sf_dir) -> DataFrame:
    return judging.judge(cut(_pairs(spark, sf_dir)), _claims(spark, sf_dir), table(spark, sf_dir, "documents"))


_CITED = f"""{_JUDGE},
c AS (SELECT doc_id, '' AS url, text, NULL::VARCHAR AS author, NULL::BIGINT AS published_at, NULL::VARCHAR[] AS outbound FROM documents SEMI JOIN jd USING (doc_id)), {primary_ctes()}, {slop_ctes()},
cr AS (SELECT doc_id, {credibility_sql()} AS credibility FROM q),
an AS (SELECT jd.*, length(trim(quote)) >= {C.MIN_QUOTE} AND (contains(text, trim(quote)) OR contains({S.normalize_claim('text')}, {S.normalize_claim('trim(quote)')})) AS ok FROM jd JOIN documents USING (doc_id)),
ct AS (SELECT an.*, credibility FROM an JOIN cr USING (doc_id) WHERE ok AND verdict <> 'NEUTRAL')"""


@query(f"WITH {_CITED} SELECT claim_id, doc_id, verdict, credibility::BIGINT AS credibility FROM ct")
def verified_citations(spark, sf_dir) -> DataFrame:
    v = verify.verify(_claims(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return v.citations.select("claim_id", "doc_id", "verdict", F.col("credibility").cast("long").alias("credibility"))


@query(f"""WITH {_CITED}, per AS (SELECT claim_id, bool_or(verdict = 'SUPPORTED') AS s, bool_or(verdict = 'PARTIAL') AS p, bool_or(verdict = 'CONTRADICTED') AS x, count(*) FILTER (verdict <> 'CONTRADICTED') AS n FROM ct GROUP BY ALL)
SELECT cl.claim_id, CASE WHEN s THEN CASE WHEN x THEN 'PARTIAL' ELSE 'SUPPORTED' END WHEN p THEN 'PARTIAL' WHEN x THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END AS verdict, coalesce(n, 0) AS source_count, {S.volatility('claim')} AS volatility FROM cl LEFT JOIN per USING (claim_id)""")
def verify_claims(spark, sf_dir) -> DataFrame:
    v = verify.verify(_claims(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return v.claims.select("claim_id", "verdict", "source_count", "volatility")


@query()
def verify_reports(spark, sf_dir) -> DataFrame:
    v = verify.verify(_claims(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return reports.claim_report(v.claims, v.citations).join(reports.claim_json(v.claims, v.citations).toDF("claim_id", "json"), "claim_id")


@query(f"""WITH qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), ds AS (SELECT doc_id AS id, text FROM documents), {S.bm25('qs', 'ds', 10)}
SELECT query_id, id, score, rank FROM b_top""")
def bm25_search(spark, sf_dir) -> DataFrame:
    return recall.bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("rank", F.col("rank").cast("long"))


# Stored claims are documents; queries are the assistants' turns.
_INDEX = f"ix AS (SELECT DISTINCT id, unnest(list_transform({S.entities('text')}, lambda e: lower(e))) AS entity FROM ds)"
_ASK = "qs AS (SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations WHERE role = 'assistant')"
_MATCH = f"""qe AS (SELECT DISTINCT query_id, unnest(list_transform({S.entities('query')}, lambda e: lower(e))) AS entity FROM qs),
em AS (SELECT query_id, id, count(*) AS overlap FROM qe JOIN ix USING (entity) GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) AS rank FROM em)"""


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH ds AS (SELECT doc_id AS id, text FROM documents), {_INDEX} SELECT entity, id FROM ix")
def entity_index(spark, sf_dir) -> DataFrame:
    return recall.entity_index(_texts(spark, sf_dir))


@query(f"WITH ds AS (SELECT doc_id AS id, text FROM documents), {_INDEX}, {_ASK}, {_MATCH} SELECT query_id, id, overlap, rank FROM er WHERE rank <= 10")
def entity_matches(spark, sf_dir) -> DataFrame:
    return recall.entity_matches(_asked(spark, sf_dir), recall.entity_index(_texts(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH ds AS (SELECT doc_id AS id, text FROM documents), {_INDEX}, h AS (SELECT entity, min(id) AS hub FROM ix GROUP BY entity HAVING count(*) > 1) SELECT entity, id, hub FROM ix JOIN h USING (entity)""")
def shared_entities(spark, sf_dir) -> DataFrame:
    return recall.neighbours(recall.entity_index(_texts(spark, sf_dir)))


_CLAIMED = f"ds AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 3 = 0 THEN 'SUPPORTED' END AS verdict, CASE WHEN doc_id % 2 = 0 THEN 0.5 END AS confidence, {NOW} - (doc_id % 300) * 86400000::BIGINT AS last_verified FROM documents)"


@query(f"""WITH {_CLAIMED}, {_INDEX}, qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_MATCH}, {S.bm25('qs', 'ds', 24)},
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / ({C.RRF_K} + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM b_top UNION ALL SELECT query_id, id, rank FROM er WHERE rank <= 24) GROUP BY ALL),
fr AS (SELECT query_id, id, coalesce(verdict, 'UNVERIFIED') AS verdict, coalesce(confidence, 0)::DOUBLE AS confidence, score FROM fu JOIN ds USING (id) WHERE last_verified <> 0 AND {NOW} - last_verified < CASE {S.volatility('text')} WHEN 'fast' THEN 1 WHEN 'immutable' THEN 1825 ELSE 180 END * 86400000::BIGINT)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fr) WHERE rank <= 8""")
def hybrid_recall(spark, sf_dir) -> DataFrame:
    claims = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'SUPPORTED' END AS verdict", "CASE WHEN doc_id % 2 = 0 THEN 0.5D END AS confidence", f"{NOW} - (doc_id % 300) * 86400000 AS last_verified")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.hybrid_recall(q, claims, NOW).select("query_id", "id", "verdict", "confidence", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH ds AS (SELECT doc_id AS id, text FROM documents), {_INDEX}, s AS (SELECT entity, min(id) AS a, max(id) AS b FROM ix GROUP BY entity HAVING count(*) > 1),
two AS (SELECT min((x.entity, y.entity)) AS e FROM s x JOIN ix p ON p.entity = x.entity JOIN ix q ON q.id = p.id JOIN s y ON y.entity = q.entity AND y.entity > x.entity),
src AS (SELECT id FROM ix, two WHERE entity = e[1]), dst AS (SELECT id FROM ix, two WHERE entity = e[2])
SELECT 0::INTEGER AS step, min(id)::VARCHAR AS id FROM src JOIN dst USING (id) HAVING count(*) > 0""")
def connect_claims(spark, sf_dir) -> DataFrame:
    """A chain of claims between the first two names, in order, that some claim holds together and others hold too."""
    index = cut(recall.entity_index(_texts(spark, sf_dir)))
    shared = cut(recall.neighbours(index))
    # a claim's first two names, not all pairs of its names
    least = shared.groupBy("id").agg(F.min("entity").alias("a"))
    both = shared.join(least, "id").filter("entity > a").groupBy("id").agg(F.min(F.struct("a", F.col("entity").alias("b"))).alias("e"))
    ends = both.agg(F.min("e").alias("e")).first()["e"]
    path = recall.connect(index, [ends["a"]], [ends["b"]]) if ends is not None else []
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(path)], "step int, id string")


# Evidence on both sides: documents speak for or against their language's claim; sources stand for origins.
_SIDES = "s AS (SELECT 'claim ' || (doc_id % 40) AS claim, CASE WHEN doc_id % 7 < doc_id % 40 % 8 THEN 'refute' ELSE 'support' END AS side, doc_id, 'q' || doc_id AS quote, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 30 + doc_id % 60 END AS credibility, doc_id % 40 = 1 AND doc_id % 9 = 0 AS is_primary FROM documents WHERE doc_id % 40 < 36)"


def _sides(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 40 < 36").selectExpr("concat('claim ', doc_id % 40) AS claim", "CASE WHEN doc_id % 7 < doc_id % 40 % 8 THEN 'refute' ELSE 'support' END AS side", "doc_id", "concat('q', doc_id) AS quote", "CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 30 + doc_id % 60 END AS credibility", "doc_id % 40 = 1 AND doc_id % 9 = 0 AS is_primary")


def _copies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 3 = 0 AND doc_id >= 40").selectExpr("doc_id - 40 AS source", "doc_id AS target")


_JUDGED = f"""{_SIDES}, ee AS (SELECT doc_id - 40 AS source, doc_id AS target FROM documents WHERE doc_id % 3 = 0 AND doc_id >= 40),
dv AS (SELECT DISTINCT y.claim, y.side, y.doc_id FROM ee JOIN s x ON x.doc_id = source JOIN s y ON y.doc_id = target AND y.claim = x.claim AND y.side = x.side),
sd AS (SELECT s.claim, s.side, count(*) AS n, count(*) - count(dv.doc_id) AS ics, sum(coalesce(credibility, 50)) AS c, bool_or(is_primary) AS p FROM s LEFT JOIN dv ON dv.claim = s.claim AND dv.side = s.side AND dv.doc_id = s.doc_id GROUP BY ALL),
wt AS (SELECT *, ics * (c::DOUBLE / n / 50) * CASE WHEN p THEN 1.25 ELSE 1 END AS w FROM sd),
al AS (SELECT 'claim ' || unnest(range(40)) AS claim),
tw AS (SELECT claim, coalesce(max(ics) FILTER (side = 'support'), 0) AS support_ics, coalesce(max(ics) FILTER (side = 'refute'), 0) AS refute_ics, coalesce(max(n) FILTER (side = 'support'), 0) AS support_n, coalesce(max(n) FILTER (side = 'refute'), 0) AS refute_n,
  coalesce(max(w) FILTER (side = 'support'), 0)::DOUBLE AS sw, coalesce(max(w) FILTER (side = 'refute'), 0)::DOUBLE AS rw, coalesce(sum(c), 0) AS c FROM al LEFT JOIN wt USING (claim) GROUP BY claim),
vd AS (SELECT *, CASE WHEN support_n = 0 AND refute_n = 0 THEN 'UNVERIFIED' WHEN rw > 1.5 * sw OR support_n = 0 THEN 'CONTRADICTED' WHEN refute_n > 0 THEN 'PARTIAL' WHEN support_ics >= 2 THEN 'SUPPORTED' ELSE 'PARTIAL' END AS verdict, support_n > 0 AND refute_n > 0 AS contested FROM tw),
vj AS (SELECT *, {S.confidence('verdict', 'support_ics', 'CASE WHEN support_n + refute_n = 0 THEN 50 ELSE c::DOUBLE / (support_n + refute_n) END', 'refute_n > 0')} AS confidence FROM vd)"""


def _judged(spark, sf_dir) -> DataFrame:
    claims = spark.range(40).select(F.concat(F.lit("claim "), F.col("id").cast("string")).alias("claim"))
    return verdicts.adjudicate(claims, _sides(spark, sf_dir), _copies(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT claim, verdict, confidence, support_ics, refute_ics, support_n, refute_n, round(sw, 6) AS support_weight, round(rw, 6) AS refute_weight, contested FROM vj")
def adjudicate(spark, sf_dir) -> DataFrame:
    return _judged(spark, sf_dir)


_least, _bar = C.MODES["standard"][3:]
_GAP = f"""CASE WHEN verdict = 'UNVERIFIED' THEN 'broaden' WHEN verdict = 'CONTRADICTED' THEN CASE WHEN refute_ics < {_least} THEN 'corroborate-refutation' END WHEN contested THEN 'adjudicate-conflict' WHEN support_ics < {_least} THEN 'seek-independent' WHEN confidence < {_bar} THEN 'strengthen' END"""


@query(f"WITH {_JUDGED} SELECT count(*) AS questions, count(*) FILTER (({_GAP}) IS NULL) AS resolved, round(count(*) FILTER (({_GAP}) IS NULL) / count(*), 6) AS coverage FROM vj")
def coverage(spark, sf_dir) -> DataFrame:
    return verdicts.coverage(_judged(spark, sf_dir))


_LADDER = " ".join(f"WHEN s = '{k}' AND a = {i} THEN replace({S.quoted(v.replace('<year>', '2024'))}, '{{}}', claim)" for k, vs in C.GAP_QUERIES.items() for i, v in enumerate(vs))


@query(f"WITH {_JUDGED}, gp AS (SELECT claim, {_GAP} AS s, least(x, 2) AS a, x AS attempt FROM vj, (SELECT unnest(range(4)) AS x)) SELECT claim, s AS strategy, attempt::BIGINT AS attempt, CASE {_LADDER} END AS query FROM gp WHERE s IS NOT NULL")
def gap_queries(spark, sf_dir) -> DataFrame:
    j = _judged(spark, sf_dir)
    s = verdicts.gap(*(F.col(c) for c in ("verdict", "contested", "support_ics", "refute_ics", "confidence")))
    g = j.select("claim", s.alias("strategy"), F.explode(F.array(*map(F.lit, range(4)))).alias("attempt")).filter("strategy is not null")
    return g.select("claim", "strategy", F.col("attempt").cast("long").alias("attempt"), verdicts.gap_query(F.col("claim"), F.col("strategy"), F.col("attempt"), 2024).alias("query"))


_TEMPLATES = ", ".join(f"('{side}', {i}, {S.quoted(t)})" for side, ts in (("support", C.SUPPORT_QUERIES), ("refute", C.REFUTATION_QUERIES)) for i, t in enumerate(ts[:4]))


@query(f"WITH t(side, pos, tpl) AS (VALUES {_TEMPLATES}), c AS (SELECT DISTINCT text AS claim FROM benchmark) SELECT claim, side, pos::BIGINT AS pos, replace(tpl, '{{}}', trim(regexp_replace(claim, '{S.WS}+', ' ', 'g'))) AS query FROM c, t")
def side_queries(spark, sf_dir) -> DataFrame:
    q = verdicts.side_queries(table(spark, sf_dir, "benchmark").select(F.col("text").alias("claim")).distinct(), 4)
    return q.withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_SIDES}, r AS (SELECT *, 0 AS round FROM s UNION ALL SELECT claim, side, doc_id, quote, credibility + 1, is_primary, 1 FROM s WHERE doc_id % 2 = 0 UNION ALL SELECT claim, side, doc_id + 100000, quote, credibility, is_primary, 1 FROM s WHERE doc_id % 2 = 1)
SELECT claim, side, doc_id, quote, arg_min(coalesce(credibility, -1), round)::BIGINT AS credibility FROM r GROUP BY ALL""")
def merge_evidence(spark, sf_dir) -> DataFrame:
    s = _sides(spark, sf_dir)
    again = s.filter("doc_id % 2 = 0").withColumn("credibility", F.col("credibility") + 1).unionByName(s.filter("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") + 100_000))
    return verdicts.merge_evidence(s, again).select("claim", "side", "doc_id", "quote", F.coalesce("credibility", F.lit(-1)).cast("long").alias("credibility"))


@query(f"WITH {_SIDES}, i AS (SELECT DISTINCT claim, CASE side WHEN 'support' THEN '+' ELSE '-' END || doc_id || '|' || quote AS i FROM s) SELECT claim, sha256(string_agg(i, '~' ORDER BY i)) AS fingerprint FROM i GROUP BY claim")
def evidence_groups(spark, sf_dir) -> DataFrame:
    return reports.evidence_groups(_sides(spark, sf_dir))


@query()
def verdict_reports(spark, sf_dir) -> DataFrame:
    return reports.verdict_report(_judged(spark, sf_dir))


@query()
def decompose_questions(spark, sf_dir) -> DataFrame:
    return research.decomposed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")))


@query()
def research_question(spark, sf_dir) -> DataFrame:
    """All benchmark items as the parts of one question, researched over the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = [r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").collect() if r["text"]]
    result = research.research("the benchmark", docs, verify.corpus_gatherer(docs), "quick", planner=lambda *_: research.distinct_texts(texts))
    return spark.createDataFrame([(s["text"], s["status"], (s["verdict"] or {}).get("verdict"), s["attempts"]) for s in result.questions], "sub_question string, status string, verdict string, attempts int")


# Claims arrive in two batches, months apart; some repeat an id, some a text.
_LATER = 10_000_000_000
_BATCHES = f"SELECT 'c' || (conv_id * 100 + turn) AS id, text, 'SUPPORTED' AS verdict, 1000 + conv_id AS now FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'c' || (conv_id * 100 + turn), {_CAPITALS.format('text')}, 'PARTIAL', {_LATER} + conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0 UNION ALL SELECT 'd' || (conv_id * 100 + turn), text, NULL, {_LATER} FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 0"
_UPSERT = f"""r AS (SELECT *, {S.normalize_claim('text')} AS normalized FROM ({_BATCHES}) WHERE text <> ''), f AS (SELECT normalized, min(now) AS first_seen FROM r GROUP BY ALL),
l AS (SELECT id, arg_max(text, now) AS text, arg_max(normalized, now) AS normalized, arg_max(coalesce(verdict, 'UNVERIFIED'), now) AS verdict, max(now) AS last_verified FROM r GROUP BY id)"""


def _stored(spark, sf_dir) -> store.Store:
    """A store in the shared folder that has taken both batches."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id"), (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("k"), "text")
    row = lambda df, head, text, verdict, now: df.select(F.concat(F.lit(head), "k").alias("id"), text.alias("text"), F.lit(verdict).cast("string").alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("ics"), now.cast("long").alias("now"))
    n, t = F.col("conv_id"), F.col("text")
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for batch in (row(c, "c", t, "SUPPORTED", 1000 + n), row(c.filter("conv_id % 3 = 0"), "c", F.expr(_CAPITALS.format("text")), "PARTIAL", _LATER + n).unionByName(row(c.filter("conv_id % 5 = 0"), "d", t, None, F.lit(_LATER)))):
        s.put_claims(batch)
    return s


@query(f"WITH {_UPSERT} SELECT id, text, verdict, first_seen, last_verified, {S.volatility('text')} AS volatility FROM l JOIN f USING (normalized)")
def claims_upsert(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).table("claims").select("id", "text", "verdict", "first_seen", "last_verified", "volatility")


@query(f"""WITH {_UPSERT}, lv AS (SELECT normalized, max(last_verified) AS last_verified FROM l GROUP BY ALL), q AS (SELECT text FROM conversations UNION ALL SELECT 'never seen ' || conv_id FROM conversations)
SELECT q.text, CASE WHEN lv.normalized IS NULL THEN 'miss' WHEN {2 * _LATER} - last_verified < CASE {S.volatility('lv.normalized')} WHEN 'fast' THEN 1 WHEN 'immutable' THEN 1825 ELSE 180 END * 86400000::BIGINT THEN 'hit' ELSE 'stale' END AS reason FROM q LEFT JOIN lv ON lv.normalized = {S.normalize_claim('q.text')}""")
def recall_claims(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    asked = c.select("text").unionByName(c.select(F.concat(F.lit("never seen "), F.col("conv_id").cast("string")).alias("text")))
    return _stored(spark, sf_dir).recall(asked, 2 * _LATER).select("text", "reason")


@query(f"WITH {_UPSERT} SELECT verdict, count(*) AS n, count(DISTINCT normalized) AS texts FROM l GROUP BY verdict")
def claim_stats(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).table("claims").groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("normalized").alias("texts"))


_OTHERS = ", ".join(f"({S.quoted(t)})" for t in C.TABLES if t != "claims")


@query(f"WITH {_UPSERT} SELECT 'claims' AS name, count(*) AS n FROM l UNION ALL SELECT name, 0 FROM (VALUES {_OTHERS}) t(name)")
def store_stats(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame(list(_stored(spark, sf_dir).stats().items()), "name string, n long")


@query()
def export_vault(spark, sf_dir) -> DataFrame:
    return reports.vault(_stored(spark, sf_dir).table("claims"))


@query(f"WITH {_UPSERT} SELECT id, text FROM l WHERE verdict = 'PARTIAL'")
def store_find(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).find("claims", verdict="PARTIAL").select("id", "text")
