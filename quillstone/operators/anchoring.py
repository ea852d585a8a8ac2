"""Quotations and where they stand in their sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import constants as C
from ..functions import text as T

_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_SCORED = StructType([*_SPAN.fields, StructField("score", DoubleType())])


def normalized_with_offsets(text: str) -> tuple[str, list[int]]:
    """Letters and digits in lower case, single spaces for all between, and the place in ``text`` of each character kept."""
    out, at = [], []
    for i, c in enumerate(text):
        if c.isalpha() or c.isnumeric():
            low = c.lower()
            out.append(low if len(low) == 1 else c)
            at.append(i)
        elif out and out[-1] != " ":
            out.append(" ")
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


@F.pandas_udf(_SPAN)
def _normalized_span(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows, held = [], {}
    for q, t in zip(quote, text):
        span = (None, None)
        if q is not None and t is not None:
            if t not in held:
                held = {t: normalized_with_offsets(t)}
            normal, at = held[t]
            wanted = normalized_with_offsets(q)[0]
            i = normal.find(wanted) if wanted else -1
            if i >= 0:
                span = (at[i], at[i + len(wanted) - 1] + 1)
        rows.append(span)
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int64")


@F.pandas_udf(_SCORED)
def _fuzzy_span(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fuzzy_window(q, t) for q, t in zip(quote, text)], columns=["start", "end", "score"]).astype({"start": "Int64", "end": "Int64"})


def fuzzy_window(quote: str | None, text: str | None) -> tuple[int | None, int | None, float]:
    """(start, end, score) of the first window of as many words as the quotation whose set of words is most similar to its own.

    The window slides: counts of the words inside, and of those that the quotation shares, change by one word in and one out.
    """
    if not quote or not text:
        return None, None, 0.0
    wanted = normalized_with_offsets(quote)[0].split()
    normal, at = normalized_with_offsets(text)
    have = normal.split()
    n, own = len(wanted), set(wanted)
    if not n or len(have) < n:
        return None, None, 0.0
    inside: dict[str, int] = {}
    shared, best, where = 0, -1.0, 0
    for j, w in enumerate(have):
        inside[w] = inside.get(w, 0) + 1
        shared += inside[w] == 1 and w in own
        if j >= n:
            out = have[j - n]
            inside[out] -= 1
            if not inside[out]:
                del inside[out]
                shared -= out in own
        if j >= n - 1:
            score = shared / (len(own) + len(inside) - shared)
            if score > best:
                best, where = score, j - n + 1
                if score == 1.0:
                    break
    starts = [0]
    for w in have[: where + n]:
        starts.append(starts[-1] + len(w) + 1)
    return at[starts[where]], at[starts[where + n] - 2] + 1, best


def anchor(quote: Column, text: Column, digest: Column | None = None) -> Column:
    """Struct (ok, kind, start, end, reason): where a quotation first stands in a text, exactly or in normalized form. Offsets count
    code points, the end exclusive. In built-in functions but for a normalized match's offsets, for which see with_anchor."""
    q = F.trim(quote)
    at = F.instr(text, q)
    normal = F.contains(T.normalize_claim(text), T.normalize_claim(q))
    reason = (
        F.when(text.isNull() | (text == ""), "no document text")
        .when(F.coalesce(digest != F.sha2(text, 256), F.lit(False)) if digest is not None else F.lit(False), "integrity")
        .when(F.coalesce(F.length(q), F.lit(0)) < C.MIN_QUOTE, "quote too short")
        .when(at > 0, "exact")
        .when(normal, "normalized")
        .otherwise("not found")
    )
    kind = F.when(reason == "exact", "EXACT").when(reason == "normalized", "NORMALIZED").otherwise("FAILED")
    exact = reason == "exact"
    return F.struct(reason.isin("exact", "normalized").alias("ok"), kind.alias("kind"), F.when(exact, (at - 1).cast("long")).alias("start"), F.when(exact, (at - 1 + F.length(q)).cast("long")).alias("end"), reason.alias("reason"))


def with_anchor(df: DataFrame, quote: str = "quote", text: str = "text", digest: str | None = None, fuzzy: bool = False, threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    """Adds struct ``anchor`` (ok, kind, start, end, score, reason). Only rows that built-in functions leave open pass through Arrow:
    normalized matches for their offsets and, with ``fuzzy``, quotations not found for their best window."""
    df = df.withColumn("__a", anchor(F.col(quote), F.col(text), F.col(digest) if digest else None))
    near = F.col("__a.kind") == "NORMALIZED"
    df = df.withColumn("__n", _normalized_span(F.when(near, F.col(quote)), F.when(near, F.col(text))))
    tried = F.col("__a.reason") == "not found"
    df = df.withColumn("__f", _fuzzy_span(F.when(tried, F.col(quote)), F.when(tried, F.col(text))) if fuzzy else F.lit(None).cast(_SCORED))
    close = F.coalesce(tried & (F.col("__f.score") >= threshold), F.lit(False))
    pick = lambda n: F.when(close, F.col(f"__f.{n}")).otherwise(F.coalesce(f"__a.{n}", f"__n.{n}"))
    done = F.struct(
        (F.col("__a.ok") | close).alias("ok"),
        F.when(close, "FUZZY").otherwise(F.col("__a.kind")).alias("kind"),
        pick("start").alias("start"),
        pick("end").alias("end"),
        F.when(F.col("__a.ok"), 1.0).otherwise(F.coalesce(F.col("__f.score"), F.lit(0.0))).alias("score"),
        F.when(close, "fuzzy").otherwise(F.col("__a.reason")).alias("reason"),
    )
    return df.withColumn("anchor", done).drop("__a", "__n", "__f")


def admit(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (claim_id, doc_id, quote) with their anchor, never a fuzzy one. A missing document, or one whose text is not what its
    ``sha256`` says, rejects the candidate."""
    digest = F.col("sha256") if "sha256" in docs.columns else F.lit(None).cast("string")
    d = docs.select("doc_id", F.col("text").alias("__text"), digest.alias("__digest"))
    return with_anchor(candidates.join(d, "doc_id", "left"), "quote", "__text", "__digest").drop("__text", "__digest")


def phantom_rate(admitted: DataFrame) -> DataFrame:
    """One row (proposed, rejected, phantom_rate): the share of candidates whose quotation cannot be found."""
    r = admitted.agg(F.count("*").alias("proposed"), F.coalesce(F.sum((~F.col("anchor.ok")).cast("long")), F.lit(0)).alias("rejected"))
    return r.withColumn("phantom_rate", F.when(F.col("proposed") == 0, 0.0).otherwise(F.col("rejected") / F.col("proposed")))


def occurrences(quotes: DataFrame, docs: DataFrame, k: int = 4) -> DataFrame:
    """(quote_id, doc_id, start): every document that holds a quotation of k + 2 or more words, and where it first does.

    Such a document holds the quotation's inner words as words of its own, so a run of k of them finds all candidates by an equi-join;
    the text is then searched once for each.
    """
    split = lambda c: F.filter(F.split(c, f"{T.WS}+"), lambda w: w != "")
    q = quotes.select("quote_id", F.trim("quote").alias("quote")).withColumn("w", split(F.col("quote"))).filter(F.size("w") >= k + 2)
    keys = q.select("quote_id", "quote", F.xxhash64(F.array_join(F.slice("w", 2, k), " ")).alias("key"))
    d = docs.select("doc_id", split(F.col("text")).alias("w")).filter(F.size("w") >= k)
    runs = F.array_distinct(F.transform(T.runs(F.col("w"), k), lambda r: F.xxhash64(r)))
    pairs = d.select("doc_id", F.explode(runs).alias("key")).join(keys, "key").select("doc_id", "quote_id", "quote").distinct()
    return pairs.join(docs.select("doc_id", "text"), "doc_id").select("quote_id", "doc_id", (F.instr("text", F.col("quote")) - 1).cast("long").alias("start")).filter("start >= 0")
