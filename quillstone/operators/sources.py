"""What kind of source a document is, how much filler it shows, and how credible that makes it, each with its signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

SIGNALS = "array<struct<id:string,weight:int>>"


def _host_is(host: Column, domains: str) -> Column:
    return F.rlike(host, F.lit(rf"(?:^|\.)(?:{domains})$"))


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"), F.lit(0)))


#: What a text must hold, some in lower case, for an identifier to stand in it; found at a fraction of the pattern's cost.
_NEEDS = {"doi": "10.", "arxiv": "arxiv:", "pmid": "pmid", "pmc": "PMC", "rfc": "RFC", "ecli": "ECLI:", "nct": "NCT", "isbn": "ISBN"}


def _identified(c: Column, low: Column, name: str, pattern: str, ignore_case: bool) -> Column:
    return F.contains(low if ignore_case else c, F.lit(_NEEDS[name])) & T.bounded(pattern, c, ignore_case)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{T.WS}+"), lambda w: w != ""))


def with_primary(docs: DataFrame) -> DataFrame:
    """Adds struct ``primary`` (is_primary, kind, identifiers) to documents (url, text, ...). Null urls and texts read as empty."""
    url, text = F.coalesce("url", F.lit("")), F.coalesce("text", F.lit(""))
    docs = docs.withColumn("__host", T.host_of(url)).withColumn("__low", F.lower(text))
    host = F.col("__host")
    by_host = F.lit("unknown")
    for _, _, domains, kind in reversed(C.PRIMARY_HOSTS):
        by_host = F.when(_host_is(host, domains), kind).otherwise(by_host)
    found = F.array_compact(F.array(*(F.when(_identified(text, F.col("__low"), name, p, i) | _identified(url, F.lower(url), name, p, i), name) for name, _, p, i in C.IDENTIFIERS)))
    docs = docs.withColumn("__kind", by_host).withColumn("__ids", found)
    kind, some = F.col("__kind"), F.size("__ids") > 0
    raised = some & kind.isin("unknown", "reference")
    wire = _host_is(host, C.WIRE_HOSTS)
    density = _count(text, f"(?i){C.ATTRIBUTIONS}") / F.greatest(word_count(text), F.lit(1)) * 1000
    final = F.when(wire, "aggregator").when(raised & (kind == "unknown"), "primary").when((kind == "unknown") & (density > 1.5), "news").otherwise(kind)
    primary = ~wire & (kind.isin("primary", "official", "peer-reviewed") | raised)
    return docs.withColumn("primary", F.struct(primary.alias("is_primary"), final.alias("kind"), F.col("__ids").alias("identifiers"))).drop("__host", "__kind", "__ids", "__low")


def _total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda a, s: a + s["weight"])


def with_slop(docs: DataFrame) -> DataFrame:
    """Adds struct ``slop`` (score, signals, exempt) to documents (text, author, published_at, outbound, primary): signs of filler
    without accountability. Primary sources and texts of under 120 words are exempt. outbound: array of URLs, or null."""
    text, out = F.coalesce("text", F.lit("")), F.coalesce("outbound", F.array().cast("array<string>"))
    docs = docs.withColumn("__n", word_count(text)).withColumn("__lens", F.transform(T.claim_sentences(text), lambda s: word_count(s).cast("double")))
    n, lens, k = F.col("__n"), F.col("__lens"), F.size("__lens")
    # no filler begins with a word that another ends with, so one pass finds all
    hits = _count(F.lower(text), "|".join(C.FILLERS))
    docs = docs.withColumn("__mean", F.aggregate("__lens", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("__lens"), F.lit(1)))
    mean = F.col("__mean")
    spread = F.sqrt(F.aggregate(lens, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(k, F.lit(1)))
    ratio = F.size(F.filter(out, lambda u: F.rlike(u, F.lit(f"(?i){C.AFFILIATE}")))) / F.greatest(F.size(out), F.lit(1))
    authored = F.coalesce(F.length(F.trim("author")) > 1, F.lit(False))
    dated = F.coalesce(F.col("published_at") != 0, F.lit(False))
    signal = lambda when, name, weight: F.when(when, F.struct(F.lit(name).alias("id"), weight.cast("int").alias("weight")))
    signals = F.array_compact(F.array(
        signal(hits >= 3, "filler-phrases", F.least(F.lit(12), hits * 2)),
        signal((k >= 8) & (spread < 0.2 * mean), "low-burstiness", F.lit(14)),
        signal(~authored, "no-author", F.lit(15)),
        signal(~dated, "no-date", F.lit(12)),
        signal((F.size(out) > 0) & (ratio > 0.1), "affiliate-heavy", F.least(F.lit(25), F.floor(ratio * 60 + 0.5))),
        signal((F.size(out) == 0) & (n > 600), "no-references", F.lit(10)),
    ))
    exempt = F.col("primary.is_primary") | (n < 120)
    docs = docs.withColumn("__signals", F.when(exempt, F.array().cast(SIGNALS)).otherwise(signals.cast(SIGNALS)))
    score = F.least(F.lit(100), _total(F.col("__signals")))
    return docs.withColumn("slop", F.struct(score.alias("score"), F.col("__signals").alias("signals"), exempt.alias("exempt"))).drop("__n", "__lens", "__mean", "__signals")


def with_credibility(docs: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """Adds struct ``credibility`` (score, kind, is_primary, signals, warnings) to documents (url, text[, author, published_at,
    outbound, retracted]). reputation: (host, listed, rank), one row for each host; others are neither listed nor ranked."""
    for name, kind in (("author", "string"), ("published_at", "long"), ("outbound", "array<string>"), ("retracted", "boolean")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    docs = with_slop(with_primary(docs))
    if reputation is not None:
        docs = docs.withColumn("__h", T.host_of(F.coalesce("url", F.lit("")))).join(reputation.select(F.col("host").alias("__h"), F.col("listed").alias("__listed"), F.col("rank").alias("__rank")), "__h", "left")
    else:
        docs = docs.withColumn("__listed", F.lit(False)).withColumn("__rank", F.lit(None).cast("int"))
    base = F.lit(0)
    for kind, x in C.KIND_BASE.items():
        base = F.when(F.col("primary.kind") == kind, x - 50).otherwise(base)
    flag = lambda c: F.coalesce(c, F.lit(False))
    authored, dated = flag(F.length(F.trim("author")) > 1), flag(F.col("published_at") != 0)
    slop = F.floor(F.col("slop.score") * 0.35 + 0.5).cast("int")
    signal = lambda when, name, weight: F.when(when, F.struct(F.lit(name).alias("id"), (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight")))
    signals = F.array_compact(F.array(
        signal(F.lit(True), "kind-baseline", base), signal(flag(F.col("retracted")), "retracted", -60), signal(flag(F.col("__listed")), "low-credibility-list", -35),
        signal(flag(F.col("__rank").between(1, 100_000)), "popular", 6), signal(authored, "has-author", 5), signal(dated, "has-date", 4),
        signal(F.col("slop.score") > 0, "slop", -slop),
    )).cast(SIGNALS)
    docs = docs.withColumn("__signals", signals)
    warnings = F.array_compact(F.array(F.when(flag(F.col("retracted")), "retracted"), F.when(flag(F.col("__listed")), "listed"), F.when(F.col("primary.kind") == "aggregator", "press wire")))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 50 + _total(F.col("__signals"))))
    done = F.struct(score.alias("score"), F.col("primary.kind").alias("kind"), F.col("primary.is_primary").alias("is_primary"), F.col("__signals").alias("signals"), warnings.alias("warnings"))
    return docs.withColumn("credibility", done).drop("__signals", "__listed", "__rank", "__h")
