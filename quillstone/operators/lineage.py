"""Lineage of texts: which derive from which, where each comes from, and how many origins are independent.

Texts with one shingle set are a class, named by its earliest member. Similarity edges join class names, and a class name has an
edge to each other member, so that copies cost a row each, not one for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .graphs import components, cut, origins


def origin_time(published: Column, first_seen: Column) -> Column:
    """The earliest positive time, in milliseconds; the largest long where there is none."""
    return F.coalesce(F.least(F.when(published > 0, published), F.when(first_seen > 0, first_seen)), F.lit(2**63 - 1))


def prepared(docs: DataFrame) -> DataFrame:
    """(id, text, time) of documents (id, text[, published_at, first_seen]); rows with a null id are left out, and of rows that share
    one, the first by text stays."""
    stamp = [F.col(c) if c in docs.columns else F.lit(None).cast("long") for c in ("published_at", "first_seen")]
    rows = docs.filter("id is not null").select("id", F.coalesce("text", F.lit("")).alias("text"), origin_time(*stamp).alias("time"))
    return rows.groupBy("id").agg(F.min(F.struct("text", "time")).alias("r")).select("id", "r.text", "r.time")


def classes(docs: DataFrame, k: int = C.SHINGLE) -> DataFrame:
    """(id, time, rep, rep_time, n, grams) of prepared documents: rep is the earliest document with the same set of hashed shingles.
    A text without words has no shingles and is a class of its own. Only rep's own row carries grams."""
    # words are hashed first, so that runs are made of numbers; words and hashes are columns of their own, as what a lambda refers to is
    # computed for each element
    split = docs.select("id", "time", T.words(T.normalize_for_compare(F.col("text"))).alias("w"))
    coded = split.select("id", "time", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    m = F.size("w")
    zipped = F.arrays_zip(*(F.slice("w", F.lit(j + 1), F.greatest(m - (k - 1), F.lit(0))).alias(str(j)) for j in range(k)))
    runs = F.array_distinct(F.transform(zipped, lambda x: F.xxhash64(*(x[str(j)] for j in range(k)))))
    short = F.when(m == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("w")))
    # kept before it is used twice; sort_array compares longs as such, array_sort by a lambda
    sets = coded.select("id", "time", F.sort_array(F.when(m < k, short).otherwise(runs)).alias("grams"))
    sets = cut(sets.withColumn("n", F.size("grams")).withColumn("key", F.when(F.col("n") > 0, F.struct(F.xxhash64("grams").alias("x"), F.xxhash64(F.lit(1), F.col("grams")).alias("y")))))
    first = sets.filter("n > 0").groupBy("key").agg(F.min(F.struct("time", "id")).alias("first"))
    named = sets.join(first, "key", "left").withColumn("rep", F.coalesce("first.id", "id")).withColumn("rep_time", F.coalesce("first.time", "time"))
    return named.select("id", "time", "rep", "rep_time", "n", F.when(F.col("id") == F.col("rep"), F.col("grams")).alias("grams"))


def similar_classes(classed: DataFrame, threshold: float = C.DERIVATION) -> DataFrame:
    """(a, b, score), a < b, of all pairs of class names whose sets have a Jaccard similarity of at least ``threshold``.

    Exact prefix filtering: shingles are ordered from rare to frequent, and a similar pair must share one among each text's first
    n - ceil(t n) + 1. Frequent shingles thus hardly ever meet, no pair is lost, and sizes bound what is compared.
    """
    own = classed.filter("grams is not null and n > 0").select("id", "n", "grams")
    rows = own.select("id", "n", F.explode("grams").alias("gram"))
    frequency = rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = rows.join(frequency, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("list"))
    # shingles of one text only come first in its order, and use up its prefix
    keep = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("list")), F.lit(0)).cast("int")
    prefix = ordered.select("id", "n", F.explode(F.slice("list", F.lit(1), keep)).alias("p")).select("id", "n", "p.gram")
    x, y = prefix.toDF("a", "n_a", "gram"), prefix.toDF("b", "n_b", "gram")
    pairs = x.join(y, "gram").filter(f"a < b and least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) - 1e-9").select("a", "b").distinct()
    sets = own.select("id", "grams")
    full = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    score = both / (F.size("of_a") + F.size("of_b") - both)
    return full.select("a", "b", score.alias("score")).filter(F.col("score") >= threshold)


def _oriented(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(source, target, score) of (a, b, score): from the earlier to the later, equal and missing times by id."""
    p = pairs.join(times.toDF("a", "time_a"), "a").join(times.toDF("b", "time_b"), "b")
    forward = F.struct("time_a", "a") < F.struct("time_b", "b")
    return p.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("target"), "score")


def similarity_edges(docs: DataFrame, syndication: float = C.SYNDICATION, derivation: float = C.DERIVATION) -> DataFrame:
    """(source, target, kind, score): between class names by similarity, and from each class name to its other members (score 1)."""
    classed = cut(classes(prepared(docs)))
    copies = classed.filter("id <> rep").select(F.col("rep").alias("source"), F.col("id").alias("target"), F.lit(1.0).alias("score"))
    found = _oriented(similar_classes(classed, derivation), classed.select("id", "time"))
    return copies.unionByName(found).select("source", "target", F.when(F.col("score") >= syndication, "syndication").otherwise("derivation").alias("kind"), "score")


def _windows(normal: Column) -> Column:
    """Of each word that begins a run of 50 characters or more, the shortest such run."""
    return F.regexp_extract_all(normal, F.lit(f"(?<![^ ])(?=(.{{{C.QUOTE_CHARS - 1}}} ?[^ ]+))"), F.lit(1))


def longest_shared_run(a: str, b: str) -> str | None:
    """The longest run of words that two normalized texts share; of several, the first in b. Lengths are tried by halving."""
    x, y = a.split(), b.split()
    if not x or not y:
        return None
    codes = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    p, q = (np.array([codes[w] for w in s], np.uint64) for s in (x, y))

    def shared(n: int) -> int | None:
        def runs(s: np.ndarray) -> np.ndarray:
            out = np.zeros(len(s) - n + 1, np.uint64)
            power = np.uint64(1)
            done, size, block = 0, 1, s + np.uint64(1)
            while size <= n:  # runs of powers of two are put together
                if n & size:
                    out = out + block[done : done + len(out)] * power
                    power, done = np.uint64(pow(_BASE, done + size, 2**64)), done + size
                if len(block) > size:
                    block = block[:-size] + block[size:] * np.uint64(pow(_BASE, size, 2**64))
                size *= 2
            return out

        hit = np.flatnonzero(np.isin(runs(q), runs(p)))
        return int(hit[0]) if len(hit) else None

    low, high, best = 1, min(len(x), len(y)), None
    while low <= high:
        mid = (low + high) // 2
        if (at := shared(mid)) is not None:
            best, low = " ".join(y[at : at + mid]), mid + 1
        else:
            high = mid - 1
    return best


_BASE = 0x9E3779B97F4A7C15


def quote_edges(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, score): texts that share a run of words of 50 characters or more, from the earliest holder of some such
    run to each other holder; score is the length of the longest shared run, counted in words first. Pairs in ``known`` (source,
    target), in either direction, are left out.

    Two texts that share such a run share the shortest window of 50 characters that begins with one of its words, so an equi-join on
    windows finds all holders; a passage that many share costs each holder one row.
    """
    d = prepared(docs).select("id", "time", T.normalize_for_compare(F.col("text")).alias("normal"))
    held = d.select("id", "time", F.explode(F.array_distinct(F.transform(_windows(F.col("normal")), lambda w: F.xxhash64(w)))).alias("window"))
    first = held.groupBy("window").agg(F.min(F.struct("time", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("window", F.col("first.id").alias("source"))
    pairs = held.join(first, "window").filter("id <> source").select("source", F.col("id").alias("target")).distinct()
    if known is not None:
        both = known.select("source", "target").unionByName(known.select(F.col("target").alias("source"), F.col("source").alias("target")))
        pairs = pairs.join(both.distinct(), ["source", "target"], "left_anti")
    pairs = cut(pairs)

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(longest_shared_run(x, y) or "") for x, y in zip(a, b)])

    text = d.select("id", "normal")
    full = pairs.join(text.toDF("source", "a"), "source").join(text.toDF("target", "b"), "target")
    found = full.select("source", "target", shared("a", "b").alias("chars")).filter(F.col("chars") >= C.QUOTE_CHARS)
    return found.select("source", "target", F.lit("quote").alias("kind"), F.col("chars").cast("double").alias("score"))


def citation_edges(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, target, kind, score) from linked to linking document: links (id, url) meet docs (id, url) by normalized URL; of
    documents with one URL, the last by id is linked."""
    named = docs.filter("id is not null and url is not null").groupBy(T.normalize_url(F.col("url")).alias("key")).agg(F.max("id").alias("source"))
    found = links.filter("url is not null").select(F.col("id").alias("target"), T.normalize_url(F.col("url")).alias("key")).join(named, "key").filter("source <> target")
    return found.select("source", "target").distinct().select("source", "target", F.lit("citation").alias("kind"), F.lit(1.0).alias("score"))


def lineage_edges(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """All edges: similarity, then quotes among pairs not yet joined, then citations, which may run beside another edge."""
    similar = cut(similarity_edges(docs))
    edges = similar.unionByName(quote_edges(docs, similar))
    return edges if links is None else edges.unionByName(citation_edges(links, docs))


def lineage(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, is_root, origin) of every document. A component is a circle of citations, or one document; it is a root if no
    edge comes in from outside, and its least id then stands for it. origin is the least root that reaches the document."""
    nodes = docs.filter("id is not null").select("id").distinct()
    edges = cut(edges.select("source", "target").distinct())
    circle = components(edges)
    named = cut(nodes.join(circle, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    between = cut(edges.join(named.toDF("source", "cs"), "source").join(named.toDF("target", "ct"), "target").filter("cs <> ct").select(F.col("cs").alias("source"), F.col("ct").alias("target")).distinct())
    roots = cut(named.select(F.col("component").alias("id")).distinct().join(between.select(F.col("target").alias("id")).distinct(), "id", "left_anti"))
    reached = origins(between, roots)
    out = named.join(reached.toDF("component", "origin"), "component", "left").join(roots.select(F.col("id").alias("component"), F.lit(True).alias("is_root")), "component", "left")
    return out.select("id", "component", F.coalesce("is_root", F.lit(False)).alias("is_root"), F.coalesce("origin", "id").alias("origin"))


def summary(traced: DataFrame) -> DataFrame:
    """One row (total, ics, circular, summary) of what ``lineage`` gives."""
    by = traced.groupBy("component").agg(F.count("*").alias("n"), F.max("is_root").alias("root"))
    r = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("root").cast("long")), F.lit(0)).alias("ics"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("circular"))
    return r.withColumn("summary", F.when(F.col("total") == 0, "No documents to analyze.").otherwise(F.concat_ws(" ", F.col("total").cast("string"), F.lit("sources,"), F.col("ics").cast("string"), F.lit("independent origins"))))


def ics_by_group(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, ics, n): the independent origins among each group's documents (group, id), from edges between documents at large.

    Only edges with both ends in a group count there. Circles are not looked for: similarity and quotes run from earlier to later, and
    so form none.
    """
    m = members.select("group", "id").distinct()
    inner = m.toDF("group", "source").join(edges.select("source", "target").distinct(), "source").join(m.toDF("group", "target"), ["group", "target"]).select("group", F.col("target").alias("id")).distinct()
    return m.join(inner.withColumn("derived", F.lit(1)), ["group", "id"], "left").groupBy("group").agg(F.sum(F.when(F.col("derived").isNull(), 1).otherwise(0)).alias("ics"), F.count("*").alias("n"))


#: Tasks a core that hash shingles.
TASKS = 8


def minhash_signatures(docs: DataFrame, hashes: int = C.HASHES, k: int = C.SHINGLE) -> DataFrame:
    """(id, signature): coordinate i is the least of the first four bytes, little-endian, of SHA-256 over "i\\0shingle"; all ones without
    shingles. Documents (id, text)."""
    heads = [f"{i}\0".encode() for i in range(hashes)]
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for grams in b.column(1).to_pylist():
                raw = [g.encode() for g in grams]
                out.append([int(np.frombuffer(b"".join([sha(h + g).digest() for g in raw]), "<u4")[::8].min()) if raw else 0xFFFFFFFF for h in heads])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "signature"])

    # a few files, or a file of long texts, would leave most cores idle: texts are dealt out to several tasks a core
    dealt = docs.select("id", "text").repartition(TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    data = dealt.select("id", T.words(T.normalize_for_compare(F.coalesce("text", F.lit("")))).alias("w")).select("id", T.shingles(F.col("w"), k).alias("grams"))
    return data.mapInArrow(run, f"id {data.schema['id'].dataType.simpleString()}, signature array<long>")


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal coordinates; 0 for empty signatures or ones of different lengths."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(same / F.size(a))


def lsh_candidates(signatures: DataFrame, bands: int = C.BANDS) -> DataFrame:
    """(band, id, first): for every band whose coordinates several signatures share, each holder with the least one. Signatures must
    divide into bands evenly."""
    size = F.size("signature")
    checked = signatures.select("id", F.when(size % bands == 0, F.col("signature")).otherwise(F.raise_error(F.lit("the signature does not divide into bands"))).alias("s"), (size / bands).cast("int").alias("rows"))
    keys = checked.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_join(F.slice("s", i * F.col("rows") + 1, F.col("rows")), ","))).alias("band", "key"))
    first = keys.groupBy("band", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keys.join(first, ["band", "key"]).select("band", "id", "first")
