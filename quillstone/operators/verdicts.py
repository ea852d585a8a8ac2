"""Verdicts from evidence on two sides, how sure they are, and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .lineage import ics_by_group


def confidence(verdict: Column, ics: Column, credibility: Column, contradicted: Column) -> Column:
    """0 to 1: by verdict, more for more origins and better sources; at most 0.4 where something speaks against it."""
    base = F.lit(0.05)
    for v, x in C.BASE_CONFIDENCE.items():
        base = F.when(verdict == v, x).otherwise(base)
    more = F.when(verdict.isin("SUPPORTED", "PARTIAL"), F.least(F.lit(0.2), 0.1 * F.log2(F.greatest(ics, F.lit(1)) + 1))).otherwise(0.0)
    x = base + more + (F.greatest(F.lit(0.0), F.least(F.lit(100.0), credibility.cast("double"))) - 50) / 50 * 0.1
    x = F.when(contradicted, F.least(x, F.lit(0.4))).otherwise(x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)


def adjudicate(claims: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each of claims (claim): (claim, verdict, confidence, support_ics, refute_ics, support_n, refute_n, support_weight,
    refute_weight, contested).

    evidence: (claim, side, doc_id, credibility, is_primary), side support or refute, one row for each document and quotation; edges:
    lineage (source, target). A side weighs its independent origins times its mean credibility over 50, a quarter more with a primary
    source. Support by one origin alone never settles a claim.
    """
    e = evidence.select(F.struct("claim", "side").alias("group"), F.col("doc_id").alias("id"), F.coalesce(F.col("credibility").cast("double"), F.lit(50.0)).alias("c"), F.coalesce("is_primary", F.lit(False)).alias("p"))
    sides = e.groupBy("group").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.max("p").alias("p")).join(ics_by_group(e, edges).select("group", "ics"), "group")
    sides = sides.withColumn("weight", F.col("ics") * (F.col("c") / F.col("n") / 50) * F.when(F.col("p"), 1.25).otherwise(1.0))
    pick = lambda s, c, d: F.coalesce(F.max(F.when(F.col("group.side") == s, F.col(c))), F.lit(d)).alias(f"{s}_{c}")
    per = sides.groupBy(F.col("group.claim").alias("claim")).agg(*(pick(s, c, d) for s in ("support", "refute") for c, d in (("ics", 0), ("n", 0), ("c", 0.0), ("weight", 0.0))))
    r = claims.select("claim").distinct().join(per, "claim", "left").fillna(0)
    n, m, s, t = F.col("support_n"), F.col("refute_n"), F.col("support_weight"), F.col("refute_weight")
    settled = F.when(F.col("support_ics") >= 2, "SUPPORTED").otherwise("PARTIAL")
    verdict = F.when((n == 0) & (m == 0), "UNVERIFIED").when((t > 1.5 * s) | (n == 0), "CONTRADICTED").when(m > 0, "PARTIAL").otherwise(settled)
    mean = F.when(n + m == 0, 50.0).otherwise((F.col("support_c") + F.col("refute_c")) / F.greatest(n + m, F.lit(1)))
    r = r.withColumn("verdict", verdict).withColumn("confidence", confidence(verdict, F.col("support_ics"), mean, m > 0)).withColumn("contested", (n > 0) & (m > 0))
    return r.select("claim", "verdict", "confidence", "support_ics", "refute_ics", "support_n", "refute_n", F.round("support_weight", 6).alias("support_weight"), F.round("refute_weight", 6).alias("refute_weight"), "contested")


def merge_evidence(*rounds: DataFrame) -> DataFrame:
    """The evidence of several rounds; of rows of one claim and side with equal doc_id and quote, that of the earliest round stays."""
    rows = None
    for i, r in enumerate(rounds):
        r = r.withColumn("__round", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    order = Window.partitionBy("claim", "side", "doc_id", "quote").orderBy("__round")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__round")


def gap(verdict: Column, contested: Column, support: Column, refute: Column, conf: Column, mode: str = "standard") -> Column:
    """What an open question needs next; null where it is resolved. A refutation by enough origins resolves it too."""
    least, bar = C.MODES.get(mode, C.MODES["standard"])[3:]
    return (
        F.when(verdict.isNull() | (verdict == "UNVERIFIED"), "broaden")
        .when(verdict == "CONTRADICTED", F.when(refute < least, "corroborate-refutation"))
        .when(contested, "adjudicate-conflict")
        .when(support < least, "seek-independent")
        .when(conf < bar, "strengthen")
    )


def coverage(judged: DataFrame, mode: str = "standard") -> DataFrame:
    """One row (questions, resolved, coverage) of rows with the columns of adjudicate."""
    g = gap(*(F.col(c) for c in ("verdict", "contested", "support_ics", "refute_ics", "confidence")), mode)
    r = judged.agg(F.count("*").alias("questions"), F.coalesce(F.sum(g.isNull().cast("long")), F.lit(0)).alias("resolved"))
    return r.withColumn("coverage", F.when(F.col("questions") == 0, 0.0).otherwise(F.round(F.col("resolved") / F.col("questions"), 6)))


def gap_query(claim: Column, strategy: Column, attempt: Column, year: int) -> Column:
    """The next search for an open question: each attempt another wording, the last one kept; unknown strategies broaden."""

    def pick(variants: tuple[str, ...]) -> Column:
        made = F.array(*(T.fill(v.replace("<year>", str(year)), claim) for v in variants))
        return F.get(made, F.least(attempt, F.lit(len(variants) - 1)).cast("int"))

    out = pick(C.GAP_QUERIES["broaden"])
    for name, variants in C.GAP_QUERIES.items():
        out = F.when(strategy == name, pick(variants)).otherwise(out)
    return out


def side_queries(claims: DataFrame, most: int = 3) -> DataFrame:
    """(claim, side, pos, query): up to ``most`` searches for and against each of claims (claim); blank claims give none."""
    flat = F.trim(F.regexp_replace("claim", f"{T.WS}+", " "))
    queries = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(i).alias("pos"), T.fill(t, flat).alias("query")) for side, ts in (("support", C.SUPPORT_QUERIES), ("refute", C.REFUTATION_QUERIES)) for i, t in enumerate(ts[:most])))
    return claims.filter(flat != "").select("claim", F.inline(queries))


def reasons(verdict: Column, support: Column, refute: Column, contested: Column, s: Column, t: Column) -> Column:
    """Why a verdict stands, in words."""
    text = lambda c: F.format_string("%.2f", c)
    return (
        F.when(verdict == "UNVERIFIED", "No admissible evidence was found on either side.")
        .when(verdict == "CONTRADICTED", F.concat(F.lit("Refuting evidence outweighs support ("), text(t), F.lit(" vs "), text(s), F.lit(").")))
        .when(contested, F.concat(F.lit("Evidence is divided ("), text(s), F.lit(" vs "), text(t), F.lit("); the claim is not settled.")))
        .when(verdict == "SUPPORTED", F.concat(F.lit("Supported by "), support.cast("string"), F.lit(" independent origins, with nothing found against it.")))
        .otherwise("One independent origin cannot corroborate itself, however often it is copied.")
    )
