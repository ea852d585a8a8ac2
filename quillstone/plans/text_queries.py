"""Queries of text, dates, sources and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import dates, sources, verify
from ..sources import store
from . import _sql as S
from ._registry import query, table

NOW = 1_735_689_600_000  # 2025-01-01


@query(f"SELECT doc_id, {S.normalize_for_compare('text')} AS compared, {S.normalize_claim('text')} AS claim, sha256(text) AS sha256 FROM documents")
def normalize_text(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_compare(t).alias("compared"), T.normalize_claim(t).alias("claim"), F.sha2(t, 256).alias("sha256"))


@query(f"""WITH w AS (SELECT doc_id, {S.words(S.normalize_for_compare('text'))} AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END::BIGINT AS n_shingles FROM w""")
def shingle_counts(spark, sf_dir) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(T.normalize_for_compare(F.col("text"))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(T.shingles(F.col("w"))).cast("long").alias("n_shingles"))


@query(f"SELECT doc_id, array_to_string({S.retrieval_tokens('text')}, ' ') AS retrieval, array_to_string({S.content_tokens('text')}, ' ') AS content FROM documents")
def word_tokens(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.retrieval_tokens(t), " ").alias("retrieval"), F.array_join(T.content_tokens(t), " ").alias("content"))


@query(f"WITH f AS (SELECT doc_id, {S.figures('text')} AS f FROM documents) SELECT doc_id, len(list_distinct(f))::BIGINT AS n, list_min(f) AS least, list_max(f) AS most FROM f")
def figures(spark, sf_dir) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", T.figures(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n"), F.array_min("f").alias("least"), F.array_max("f").alias("most"))


@query(f"SELECT doc_id, array_to_string(list_sort({S.entities('text')}), '|') AS entities FROM documents")
def entities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.entities(F.col("text"))), "|").alias("entities"))


@query(f"WITH s AS (SELECT doc_id, {S.quotable('text')} AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::BIGINT AS pos, unnest(s) AS sentence FROM s")
def sentences(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.quotable(F.col("text"))).alias("pos", "sentence"))
    return s.withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT page_id, sha256({S.strip_html('html')}) AS sha256, length({S.strip_html('html')})::BIGINT AS n FROM pages""")
def page_text(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("n"))


_PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_KEPT = rf"list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:{C.TRACKING})'))"


@query(f"SELECT page_id, {S.host_of('url')} AS host, lower({S.host_of('url')} || {_PATH} || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END) AS url_key FROM pages")
def page_urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.host_of(F.col("url")).alias("host"), T.normalize_url(F.col("url")).alias("url_key"))


_ASKED = """r AS (SELECT page_id + 1000 * (page_id % 2) AS pos, url, CASE WHEN page_id % 3 = 0 THEN repeat('snippet ', 9) WHEN page_id % 3 = 1 THEN 'short' END AS snippet FROM pages
  UNION ALL SELECT 5000 + page_id, url || '/gone', repeat('snippet ', 7 + page_id % 2) FROM pages),
f AS (SELECT url, min(pos) AS pos, arg_min(snippet, pos) AS snippet FROM r GROUP BY url), h AS (SELECT url, max(html) AS html FROM pages GROUP BY url)"""


@query(f"""WITH {_ASKED}, j AS (SELECT f.*, nullif({S.strip_html('html')}, '') AS page FROM f LEFT JOIN h USING (url))
SELECT left(sha256(url), 13) AS id, pos, url, sha256(coalesce(page, trim(snippet))) AS sha256, page IS NULL AS snippet_only FROM j WHERE page IS NOT NULL OR length(trim(snippet)) >= 60""")
def fetched_pages(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    asked = pages.select((i + 1000 * (i % 2)).alias("pos"), "url", F.when(i % 3 == 0, "snippet " * 9).when(i % 3 == 1, "short").alias("snippet"))
    gone = pages.select((i + 5000).alias("pos"), F.concat("url", F.lit("/gone")).alias("url"), F.repeat(F.lit("snippet "), (7 + i % 2).cast("int")).alias("snippet"))
    return store.page_documents(asked.unionByName(gone), pages).select("id", "pos", "url", F.sha2("text", 256).alias("sha256"), "snippet_only")


@query(f"""WITH s AS (SELECT conv_id, turn, {S.sentences('text')} AS s FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, unnest(range(len(s)))::BIGINT AS pos, unnest(s) AS claim FROM s)
SELECT conv_id, turn, pos, 'c' || (pos + 1) AS claim_id, claim, {S.volatility('claim')} AS volatility FROM u WHERE {S.checkworthy('claim')}""")
def atomize_claims(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.struct("conv_id", "turn").alias("id"), "text")
    a = verify.atomize(c)
    return a.select("id.conv_id", "id.turn", F.col("pos").cast("long").alias("pos"), "claim_id", "claim", T.volatility(F.col("claim")).alias("volatility"))


_CUED = "CASE doc_id % 4 WHEN 0 THEN 'The stock price of ' WHEN 1 THEN 'RFC 9110 was founded in ' WHEN 2 THEN 'The shares' ELSE 'Plants ' END || text"
_SEEN = f"CASE WHEN doc_id % 9 = 0 THEN 0 ELSE {NOW} - (doc_id % 400) * 7200000 END"


@query(f"""WITH c AS (SELECT doc_id, {_CUED} AS claim, {_SEEN} AS seen FROM documents), v AS (SELECT *, {S.volatility('claim')} AS v FROM c)
SELECT doc_id, v AS volatility, seen <> 0 AND {NOW} - seen < CASE v WHEN 'fast' THEN 1 WHEN 'immutable' THEN 1825 ELSE 180 END * 86400000::BIGINT AS fresh FROM v""")
def freshness(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_CUED} AS claim", f"{_SEEN} AS seen").withColumn("volatility", T.volatility(F.col("claim")))
    return d.select("doc_id", "volatility", T.is_fresh(F.col("seen"), F.col("volatility"), F.lit(NOW)).alias("fresh"))


@query(f"""SELECT doc_id, {S.truncated('text', 40)} AS cut, left(sha256(text), 13) AS id, left(trim(regexp_replace(text, '[\\\\/:*?"<>|#^\\[\\]]', '-', 'g')), 100) AS name FROM documents""")
def short_names(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(t, 40).alias("cut"), T.short_id(t).alias("id"), T.safe_name(t).alias("name"))


# Pages with dates in every place, made from orders: the same expressions in both dialects.
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_LATER = "strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d')"
_K = "o_orderkey"


def _dated(day: str, later: str) -> str:
    return f"""concat(
  CASE WHEN {_K} % 3 = 0 THEN concat('<script type="application/ld+json">{{"@type":"Article","datePublished":"', {day}, 'T10:30:00+02:00","dateModified":"', CASE WHEN {_K} % 2 = 0 THEN {later} ELSE '1994-02-03' END, '"}}</script>') ELSE '' END,
  CASE WHEN {_K} % 5 = 0 THEN '<script type="application/ld+json">{{broken</script>' ELSE '' END,
  CASE WHEN {_K} % 4 = 1 THEN concat('<meta property="article:published_time" content="', {day}, '">') ELSE '' END,
  CASE WHEN {_K} % 4 = 2 THEN concat('<meta content="', {later}, 'T00:00:00Z" name="DC.date.issued">') ELSE '' END,
  CASE WHEN {_K} % 7 = 3 THEN concat('<meta property="og:updated_time" content="', {later}, '">') ELSE '' END)"""


def _dated_url(year: str, month: str, day: str) -> str:
    return f"CASE WHEN {_K} % 6 < 3 THEN concat('https://news.example.com/', {year}, '/', {month}, '/', CASE WHEN {_K} % 6 = 1 THEN concat({day}, '/') ELSE '' END, 'story') ELSE 'https://news.example.com/story' END"


_WAYBACK = f"CASE WHEN {_K} % 8 = 0 THEN epoch_ms(o_orderdate - INTERVAL 30 DAY) WHEN {_K} % 8 = 4 THEN epoch_ms(o_orderdate) END"
_META = lambda key, back: rf"""try_cast(nullif(regexp_extract(html, '{f'<meta content="([^"]*)" name="{key}">' if back else f'<meta property="{key}" content="([^"]*)">'}', 1), '') AS TIMESTAMP)"""
_SANE = lambda x: f"CASE WHEN {x} BETWEEN 725846400000 AND {NOW} + 86400000 THEN {x} END"
_RESOLVE = rf"""WITH i AS (SELECT o_orderkey, {_dated(_DAY, _LATER)} AS html, {_dated_url("year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)")} AS url, {_WAYBACK} AS wb0,
  CASE WHEN o_orderkey % 10 < 2 THEN epoch_ms(o_orderdate) + 43200000 END AS lm0, CASE WHEN o_orderkey % 10 < 2 THEN epoch_ms(o_orderdate) + CASE WHEN o_orderkey % 10 = 0 THEN 43210000 ELSE 99000000 END END AS dh0 FROM orders),
j AS (SELECT *, epoch_ms(try_cast(regexp_extract(html, '"datePublished":"([^"]*)T10:30:00', 1) AS TIMESTAMP)) + 30600000 AS jp0, epoch_ms(try_cast(regexp_extract(html, '"dateModified":"([^"]*)"', 1) AS TIMESTAMP)) AS jm0,
  epoch_ms({_META('article:published_time', False)}) AS mp0, epoch_ms({_META('DC.date.issued', True)}) AS dc0, epoch_ms({_META('og:updated_time', False)}) AS ou0,
  regexp_extract(url, '/([0-9]{{4}})/([0-9]{{1,2}})(?:/([0-9]{{1,2}}))?/', ['y', 'm', 'd']) AS u FROM i),
k AS (SELECT o_orderkey, {_SANE('jp0')} AS jp, {_SANE('jm0')} AS jm, {_SANE('mp0')} AS mp, {_SANE('dc0')} AS dc, {_SANE('ou0')} AS ou, {_SANE('wb0')} AS wb, {_SANE('lm0')} AS lm, {_SANE('dh0')} AS dh,
  epoch_ms(make_timestamp(try_cast(u.y AS BIGINT), try_cast(u.m AS BIGINT), 1, 0, 0, 0.0)) + (coalesce(try_cast(nullif(u.d, '') AS BIGINT), 1) - 1) * 86400000 AS ur0 FROM j),
l AS (SELECT *, {_SANE('ur0')} AS ur, coalesce(jp, mp, dc) AS pub, coalesce(abs(lm - dh) < 60000, false) AS render FROM k),
m AS (SELECT *, CASE WHEN NOT render THEN lm END AS http, coalesce(jm, ou, CASE WHEN NOT render THEN lm END) AS mod,
  list_filter([pub, CASE WHEN jm IS NOT NULL THEN jm ELSE ou END, ur, wb], lambda x: x IS NOT NULL) AS ev FROM l),
n AS (SELECT *, list_min(ev) AS eff, len(list_filter(list_concat(ev, CASE WHEN http IS NULL THEN [] ELSE [http] END), lambda x: x = pub)) AS agree FROM m)
SELECT o_orderkey, coalesce(pub, -1) AS published, coalesce(mod, -1) AS modified, coalesce(eff, -1) AS effective,
  CASE WHEN coalesce(mod < pub - 86400000, false) OR coalesce(wb < pub - 604800000, false) THEN 'SUSPECT' WHEN pub IS NOT NULL AND (agree >= 2 OR jp IS NOT NULL OR jm IS NOT NULL) THEN 'HIGH' WHEN pub IS NOT NULL OR eff IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  (render::INT + coalesce(mod < pub - 86400000, false)::INT + coalesce(wb < pub - 604800000, false)::INT + coalesce(abs(ur - pub) > 15552000000, false)::INT)::BIGINT AS n_warnings,
  (len(ev) + (http IS NOT NULL)::INT)::BIGINT AS n_evidence FROM n"""


@query(_RESOLVE)
def resolve_dates(spark, sf_dir) -> DataFrame:
    k, o = F.col("o_orderkey"), F.col("o_orderdate")  # in UTC, as the session is
    http = lambda t: F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    noon = o + F.expr("INTERVAL 12 HOURS")
    docs = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select(
        k,
        F.expr(_dated("date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate + INTERVAL 10 DAY, 'yyyy-MM-dd')")).alias("html"),
        F.expr(_dated_url("year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)")).alias("url"),
        F.when(k % 10 < 2, http(noon)).alias("last_modified"),
        F.when(k % 10 < 2, http(noon + F.when(k % 10 == 0, F.expr("INTERVAL 10 SECONDS")).otherwise(F.expr("INTERVAL 55800 SECONDS")))).alias("http_date"),
        F.when(k % 8 == 0, F.unix_millis(o - F.expr("INTERVAL 30 DAY"))).when(k % 8 == 4, F.unix_millis(o)).alias("wayback"),
    )
    d = F.col("dates")
    out = dates.resolve_dates(docs, F.lit(NOW))
    return out.select("o_orderkey", *(F.coalesce(d[c], F.lit(-1)).alias(c) for c in ("published", "modified", "effective")), d["confidence"].alias("confidence"), F.size(d["warnings"]).cast("long").alias("n_warnings"), F.size(d["evidence"]).cast("long").alias("n_evidence"))


_HOSTS = "['example.com', 'www.sec.gov', 'data.gov.uk', 'cdc.gov', 'mit.edu', 'arxiv.org', 'prnewswire.com', 'nature.com', 'blog.example.org', 'doi.org', 'ac.uk']"
_CREDITED = f"""c AS (SELECT doc_id, 'https://' || ({_HOSTS})[doc_id % 11 + 1] || '/a/' || doc_id AS url,
  CASE doc_id % 5 WHEN 0 THEN text || ' doi 10.1234/abc.5 end' WHEN 1 THEN text || repeat(' according to sources, in conclusion', 5) ELSE text END AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'A. Writer' WHEN doc_id % 3 = 1 THEN ' ' END AS author, CASE WHEN doc_id % 2 = 0 THEN 1700000000000 + doc_id END AS published_at,
  CASE WHEN doc_id % 4 = 0 THEN ['https://shop.example.com/?tag=x', 'https://example.com'] WHEN doc_id % 4 = 1 THEN ['https://example.com'] END AS outbound, doc_id % 17 = 0 AS retracted FROM documents)"""


def _credited(spark, sf_dir) -> DataFrame:
    i, hosts = F.col("doc_id"), F.array(*(F.lit(h) for h in _HOSTS.strip("[]").replace("'", "").split(", ")))
    return table(spark, sf_dir, "documents").select(
        i,
        F.concat(F.lit("https://"), F.get(hosts, (i % 11).cast("int")), F.lit("/a/"), i.cast("string")).alias("url"),
        F.when(i % 5 == 0, F.concat("text", F.lit(" doi 10.1234/abc.5 end"))).when(i % 5 == 1, F.concat("text", F.lit(" according to sources, in conclusion" * 5))).otherwise(F.col("text")).alias("text"),
        F.when(i % 3 == 0, "A. Writer").when(i % 3 == 1, " ").alias("author"),
        F.when(i % 2 == 0, i + 1_700_000_000_000).alias("published_at"),
        F.when(i % 4 == 0, F.array(F.lit("https://shop.example.com/?tag=x"), F.lit("https://example.com"))).when(i % 4 == 1, F.array(F.lit("https://example.com"))).alias("outbound"),
        (i % 17 == 0).alias("retracted"),
    )


def primary_ctes(source: str = "c") -> str:
    """CTE p: the rows of ``source`` (url, text, ...) with ids, kind and is_primary."""
    kinds = " ".join(rf"WHEN regexp_matches(host, '(?:^|\.)(?:{d})$') THEN '{k}'" for _, _, d, k in C.PRIMARY_HOSTS)
    ids = ", ".join(f"CASE WHEN {S.bounded(p, 'text', i)} OR {S.bounded(p, 'url', i)} THEN '{n}' END" for n, _, p, i in C.IDENTIFIERS)
    n = f"len(list_filter(string_split_regex(text, '{S.WS}+'), lambda w: w <> ''))"
    return rf"""p0 AS (SELECT *, {S.host_of('url')} AS host, {n} AS n_words FROM {source}),
p1 AS (SELECT *, CASE {kinds} ELSE 'unknown' END AS k0, list_filter([{ids}], lambda x: x IS NOT NULL) AS ids, regexp_matches(host, '(?:^|\.)(?:{C.WIRE_HOSTS})$') AS wire, {S.hits('(?i)' + C.ATTRIBUTIONS, 'text')}::DOUBLE / greatest(n_words, 1) * 1000 AS density FROM p0),
p AS (SELECT *, CASE WHEN wire THEN 'aggregator' WHEN len(ids) > 0 AND k0 = 'unknown' THEN 'primary' WHEN k0 = 'unknown' AND density > 1.5 THEN 'news' ELSE k0 END AS kind,
  NOT wire AND (k0 IN ('primary', 'official', 'peer-reviewed') OR len(ids) > 0 AND k0 IN ('unknown', 'reference')) AS is_primary FROM p1)"""


def slop_ctes() -> str:
    """CTE q: the rows of p with slop; needs author, published_at and outbound."""
    filler = " + ".join(S.hits(f, "lower(text)") for f in C.FILLERS)
    lens = f"list_transform({S.sentences('text')}, lambda s: len(list_filter(string_split_regex(s, '{S.WS}+'), lambda w: w <> ''))::DOUBLE)"
    return f"""q0 AS (SELECT *, {filler} AS fillers, {lens} AS lens, coalesce(length(trim(author)) > 1, false) AS authored, coalesce(published_at <> 0, false) AS dated, coalesce(len(outbound), 0) AS n_out,
  coalesce(len(list_filter(outbound, lambda u: regexp_matches(u, '(?i){C.AFFILIATE}'))), 0)::DOUBLE / greatest(coalesce(len(outbound), 0), 1) AS ratio FROM p),
q AS (SELECT *, CASE WHEN is_primary OR n_words < 120 THEN 0 ELSE least(100, CASE WHEN fillers >= 3 THEN least(12, fillers * 2) ELSE 0 END + CASE WHEN len(lens) >= 8 AND list_stddev_pop(lens) < 0.2 * list_avg(lens) THEN 14 ELSE 0 END
  + CASE WHEN authored THEN 0 ELSE 15 END + CASE WHEN dated THEN 0 ELSE 12 END + CASE WHEN n_out > 0 AND ratio > 0.1 THEN least(25, floor(ratio * 60 + 0.5))::INT WHEN n_out = 0 AND n_words > 600 THEN 10 ELSE 0 END) END::INT AS slop FROM q0)"""


def credibility_sql(listed: str = "false", ranked: str = "false", retracted: str = "false") -> str:
    kinds = "CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in C.KIND_BASE.items()) + " END"
    return f"greatest(0, least(100, {kinds} - CASE WHEN {retracted} THEN 60 ELSE 0 END - CASE WHEN {listed} THEN 35 ELSE 0 END + CASE WHEN {ranked} THEN 6 ELSE 0 END + CASE WHEN authored THEN 5 ELSE 0 END + CASE WHEN dated THEN 4 ELSE 0 END - floor(slop * 0.35 + 0.5)::INT))::INT"


@query(f"WITH {_CREDITED}, {primary_ctes()} SELECT doc_id, kind, is_primary, array_to_string(ids, ',') AS identifiers FROM p")
def assess_primary(spark, sf_dir) -> DataFrame:
    p = F.col("primary")
    return sources.with_primary(_credited(spark, sf_dir)).select("doc_id", p["kind"].alias("kind"), p["is_primary"].alias("is_primary"), F.array_join(p["identifiers"], ",").alias("identifiers"))


@query(f"WITH {_CREDITED}, {primary_ctes()}, {slop_ctes()} SELECT doc_id, slop, is_primary OR n_words < 120 AS exempt FROM q")
def assess_slop(spark, sf_dir) -> DataFrame:
    s = F.col("slop")
    return sources.with_slop(sources.with_primary(_credited(spark, sf_dir))).select("doc_id", s["score"].alias("slop"), s["exempt"].alias("exempt"))


@query(f"""WITH {_CREDITED}, {primary_ctes()}, {slop_ctes()} SELECT doc_id, kind, {credibility_sql("host = 'blog.example.org'", "host IN ('example.com', 'nature.com')", "retracted")} AS score,
(retracted::INT + (host = 'blog.example.org')::INT + (kind = 'aggregator')::INT)::BIGINT AS n_warnings FROM q""")
def assess_credibility(spark, sf_dir) -> DataFrame:
    reputation = spark.createDataFrame([("blog.example.org", True, None), ("example.com", False, 500), ("nature.com", False, 100_000), ("mit.edu", False, 100_001)], "host string, listed boolean, rank int")
    c = F.col("credibility")
    return sources.with_credibility(_credited(spark, sf_dir), reputation).select("doc_id", c["kind"].alias("kind"), c["score"].alias("score"), F.size(c["warnings"]).cast("long").alias("n_warnings"))


@query(f"""WITH c AS (SELECT doc_id, '' AS url, text, NULL::VARCHAR AS author, NULL::BIGINT AS published_at, NULL::VARCHAR[] AS outbound FROM documents), {primary_ctes()}, {slop_ctes()}
SELECT quality, count(*) AS n, round(avg(slop), 6) AS mean_slop, count(*) FILTER (slop >= 30) AS flagged FROM q JOIN labels USING (doc_id) GROUP BY quality""")
def slop_by_quality(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("url"), "text", F.lit(None).cast("string").alias("author"), F.lit(None).cast("long").alias("published_at"), F.lit(None).cast("array<string>").alias("outbound"))
    s = sources.with_slop(sources.with_primary(d)).select("doc_id", F.col("slop.score").alias("slop")).join(table(spark, sf_dir, "labels"), "doc_id")
    return s.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("slop"), 6).alias("mean_slop"), F.count_if(F.col("slop") >= 30).alias("flagged"))
