"""Reports as text columns: one row each, so that writing them is any text sink's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .recall import entity_index
from .verdicts import reasons


def icon(verdict: Column) -> Column:
    out = F.lit("•")
    for v, x in C.ICONS.items():
        out = F.when(verdict == v, x).otherwise(out)
    return out


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def verdict_report(judged: DataFrame) -> DataFrame:
    """(claim, report) in Markdown, of rows with the columns of verdicts.adjudicate."""
    contested = F.when(F.col("contested"), " (contested)").otherwise("")
    head = F.concat(F.lit("### "), icon(F.col("verdict")), F.lit(" "), F.col("verdict"), contested, F.lit(" - "), percent(F.col("confidence")), F.lit(" confidence"))
    origins = F.concat(F.lit("**Independent origins:** "), F.col("support_ics").cast("string"), F.lit(" supporting, "), F.col("refute_ics").cast("string"), F.lit(" refuting"))
    why = reasons(*(F.col(c) for c in ("verdict", "support_ics", "refute_ics", "contested", "support_weight", "refute_weight")))
    return judged.select("claim", F.concat_ws("\n", head, F.concat(F.lit("> "), F.col("claim")), F.lit(""), origins, F.lit(""), F.concat(F.lit("- "), why)).alias("report"))


def claim_report(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(claim_id, report) in Markdown, of a Verification's tables; at most what a claim gathered is listed."""
    line = F.concat(F.lit("- ["), F.col("anchor.kind"), F.when(F.col("verdict") != "SUPPORTED", F.concat(F.lit(", "), F.col("verdict"))).otherwise(""), F.lit("] "), F.col("doc_id").cast("string"), F.lit(" (credibility "), F.col("credibility").cast("string"), F.lit('/100)\n  > "'), F.col("quote"), F.lit('"'))
    lines = citations.select("claim_id", "doc_id", line.alias("line")).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("l"))
    head = F.concat(F.lit("### "), icon(F.col("verdict")), F.lit(" "), F.col("verdict"), F.lit(" - "), percent(F.col("confidence")), F.lit(" confidence"))
    counted = F.when(F.col("source_count") > 0, F.concat(F.lit("**Corroboration:** "), F.col("ics").cast("string"), F.lit(" independent origins across "), F.col("source_count").cast("string"), F.lit(" sources")))
    return claims.join(lines, "claim_id", "left").select("claim_id", F.concat_ws("\n", head, F.concat(F.lit("> "), F.col("claim")), counted, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("report"))


def claim_json(claims: DataFrame, citations: DataFrame, most: int = 4, chars: int = 300) -> DataFrame:
    """(claim_id, report) as JSON, with the first citations and clipped quotations."""
    one = F.struct("doc_id", F.left("quote", F.lit(chars)).alias("quote"), F.col("verdict").alias("stance"), F.col("anchor.kind").alias("kind"), "credibility")
    cited = citations.select("claim_id", one.alias("c")).groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list("c")), 1, most).alias("citations"))
    return claims.join(cited, "claim_id", "left").select("claim_id", F.to_json(F.struct("claim", "verdict", "confidence", "ics", "source_count", "volatility", "citations")).alias("report"))


def vault(claims: DataFrame) -> DataFrame:
    """(path, content): a note for each claim (id, text, verdict, confidence, ics), one for each name, and an index, linked together."""
    c = claims.filter("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text", F.coalesce("verdict", F.lit("UNVERIFIED")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ics", F.lit(0)).alias("ics"))
    link = lambda x: F.concat(F.lit("[["), T.safe_name(x), F.lit("]]"))
    names = F.transform(T.entities(F.col("text")), link)
    meta = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("id")), F.concat(F.lit("verdict: "), F.col("verdict")), F.concat(F.lit("confidence: "), F.col("confidence").cast("string")), F.concat(F.lit("independent_origins: "), F.col("ics").cast("string")), F.concat(F.lit("volatility: "), T.volatility(F.col("text"))), F.lit("---"))
    note = F.concat_ws("\n", meta, F.lit(""), F.concat(F.lit("# "), F.col("text")), F.lit(""), F.when(F.size(names) > 0, F.concat(F.lit("## Entities\n"), F.array_join(names, " · "))))
    notes = c.select(F.concat(F.lit("claims/"), T.safe_name(F.col("id")), F.lit(".md")).alias("path"), note.alias("content"))
    index = entity_index(c)
    # a name's list can be long, but not longer than its claims: lines of 100 characters
    lines = index.join(c.select("id", F.concat(F.lit("- "), link(F.col("id")), F.lit(" - "), T.truncate(F.col("text"), 100)).alias("line")), "id")
    listed = lines.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("l"))
    topics = listed.select(F.concat(F.lit("entities/"), T.safe_name(F.col("entity")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col("entity"), F.lit("\n\n## Claims\n"), F.col("l")).alias("content"))
    counts = c.agg(F.count("*").alias("n")).crossJoin(index.agg(F.count_distinct("entity").alias("m")))  # one row each
    top = counts.select(F.lit("INDEX.md").alias("path"), F.concat(F.lit("# Evidence graph\n\n"), F.col("n").cast("string"), F.lit(" verified claims, "), F.col("m").cast("string"), F.lit(" entities")).alias("content"))
    return notes.unionByName(topics).unionByName(top)


def evidence_groups(evidence: DataFrame) -> DataFrame:
    """(claim, fingerprint): claims with equal evidence have equal fingerprints. Of evidence (claim, side, doc_id, quote)."""
    item = F.concat(F.when(F.col("side") == "support", "+").otherwise("-"), F.col("doc_id").cast("string"), F.lit("|"), F.col("quote"))
    return evidence.select("claim", item.alias("i")).groupBy("claim").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("i")), "~"), 256).alias("fingerprint"))


def research_report(result) -> str:
    """Markdown of a research.Research."""
    lines = [f"# {result.question}", ""]
    if result.stop == "unavailable":
        return "\n".join([*lines, "## Research could not run", "", *result.timeline])
    lines += [f"_{result.mode}: {result.rounds} rounds, {result.stop}, coverage {result.coverage:.0%}_", "", "## Findings", ""]
    for s in result.questions:
        v = s["verdict"] or {"verdict": "UNVERIFIED", "confidence": 0.05, "support_ics": 0, "refute_ics": 0}
        lines += [f"### {C.ICONS[v['verdict']]} {v['verdict']} - {v['confidence']:.0%} confidence", f"> {s['text']}", f"**Independent origins:** {v['support_ics']} supporting, {v['refute_ics']} refuting", ""]
    for status, title in (("weak", "Weakly evidenced"), ("contested", "Contested points"), ("exhausted", "Could not be established")):
        if own := [s["text"] for s in result.questions if s["status"] == status]:
            lines += [f"## {title}", "", *(f"- {t}" for t in own), ""]
    return "\n".join([*lines, "## Research trace", "", *(f"- {t}" for t in result.timeline)])
