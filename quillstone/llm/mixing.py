"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's texts, in an order drawn from their ids, form one line of words, cut into blocks of ``block`` words. A target that
exceeds the source takes whole passes first; each pass draws all blocks in a permutation of its own, and the rest is drawn by one
more. A source's quota is the blocks of all its passes. The quotas of all sources are split recursively among
the output shards: a node gives its left half a multivariate-hypergeometric draw of what it holds, so every shard has exact block
quotas and the shards' quotas sum to the sources'. Shards draw disjoint ranges of a source's passes laid end to end, and
each shard orders its blocks by a key of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch

PATTERN = (5.0, 2.0, 1.0)


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """(id, source, size in words) of every row, and its row key as ``row`` if one is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for part in _text.slices(b, 2):
                starts, _, first = _text.spans(*_text.buffers(part.column(2)))
                n.append(np.diff(first))
            size = pa.array(np.concatenate(n).astype(np.int64)) if n else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, *b.columns[3:]], ["id", "source", "size", *more])

    more = ["row"] if row_col else []
    data = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), *(F.col(row_col).cast("long").alias(c) for c in more))
    return data.mapInArrow(run, "id long, source string, size long" + "".join(f", {c} long" for c in more))


def targets(per_source: DataFrame, share: float, most: float, pattern: tuple[float, ...] = PATTERN) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, each at most ``most`` times its source, the excess reshared by
    weight. The level at which uncapped sources settle follows from sources in order of size by weight: one pass over one row for
    each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, pattern))
    t = per_source.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(pattern) + 1))
    t = t.withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = t.withColumn("below", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("above", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (share * F.sum("source_size").over(every) - F.col("below")) / F.col("above"))
    # the first source whose cap isn't reached at its own level sets the level for all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return t.select("source", "source_size", F.coalesce(F.least(F.col("cap"), level["level"] * F.col("weight")), "cap").alias("target"))


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` balls are good. From 10^9 on, where numpy's draw ends, by rejection from a ratio of uniforms: points
    under the root of the distribution, in a box around its mode."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if total and drawn else 0
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    share = good / total
    mean, variance = drawn * share, drawn * share * (1 - share) * ((total - drawn) / (total - 1))
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), least), most)

    def log_weight(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, drawn - k, bad - drawn + k))

    top, wide = log_weight(mode), 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + wide * (v - 0.5) / u) if u else -1
        if least <= k <= most and 2 * math.log(u) <= log_weight(k) - top:
            return k


def multivariate(quotas: np.ndarray, drawn: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw, source by source of what is left."""
    out, left = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        left -= q
        out[i] = hypergeometric(q, left, drawn, rng)
        drawn -= int(out[i])
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: the splitting tree's leaves. Each row's sum differs from the others' by at most one."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    mine = total * left // shards
    drawn = multivariate(quotas, mine, rng)
    return np.concatenate([split(drawn, left, rng), split(quotas - drawn, shards - left, rng)])


def permuted(block: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The place of each block in a keyed permutation of [0, n): a Feistel network over the next power of four, walked into range."""
    out = block.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        low, high = out[todo] & m, out[todo] >> h
        for k in range(4):
            low, high = high ^ (_text.mix64(low + s + np.uint64(k * 0x9E37)) & m), low
        out[todo] = (high << h) | low
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, block: int = 256, shards: int = 64, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, passes, blocks) of every row; blocks: array of (shard, order, from, words) drawn.

    from: first word of the piece within its text; the shard writes its pieces by ``order``. passes: how often a source is drawn
    whole. taken: the words of its blocks, those of whole passes too, never above ceil(most) * size. ``row_col``, a unique key of
    rows, comes along as ``row``. Null and empty texts have size 0 and take 0; null sources form one source, ordered
    last; rows that share an id each count. Reruns draw the same. An empty table gives no rows; other columns are not read.

    The driver holds one row and the quotas for each source; the texts stay where they are, and no window spans a whole source: a
    source is cut by its order keys into up to 4096 runs, whose sums are laid end to end.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    sized = sizes(df, id_col, text_col, source_col, row_col)
    row = ["row"] if row_col else []
    key = F.xxhash64(F.lit(seed), "id", "size")
    rows = scratch.keep(sized.withColumn("key", key).withColumn("run", F.shiftrightunsigned("key", 52)))
    runs = scratch.keep(rows.groupBy("source", "run").agg(F.sum("size").alias("words")))
    per_source = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = sorted(targets(per_source, share, most).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    taken = [round(r["target"]) for r in plan]
    rest = np.array([t - t // n * n if (n := r["source_size"]) else 0 for t, r in zip(taken, plan)], np.int64)
    whole = [t // r["source_size"] if r["source_size"] else 0 for t, r in zip(taken, plan)]
    count = np.array([-(-r["source_size"] // block) for r in plan], np.int64)
    # the last block drawn is cut, so that the words drawn, not only the blocks, meet the target
    quota = np.minimum(-(-rest // block), count)
    leaves = split(np.array(whole, np.int64) * count + quota, shards, np.random.Generator(np.random.PCG64(seed))) if len(plan) else np.zeros((shards, 0), np.int64)
    begins = np.concatenate([np.zeros((1, len(plan)), np.int64), np.cumsum(leaves, axis=0)])
    table = spark.createDataFrame(
        [(r["source"], r["source_size"], float(r["target"]), int(w), int(x), int(q)) for r, w, x, q in zip(plan, whole, rest, quota)],
        "source string, source_size long, target double, passes long, rest long, quota long",
    )
    offsets = runs.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a run is a bounded share of a source; within it, the texts' own offsets
    within = Window.partitionBy("source", "run").orderBy("key", "id", *row).rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # hot sources have as many rows here as runs, and one row in the table
    placed = laid.join(offsets.withColumnRenamed("source", "s").withColumnRenamed("run", "r").join(table, F.col("s").eqNullSafe(F.col("source"))).drop("source"), F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return _draw(placed.select("id", "size", "source", (F.col("before") + F.col("inner")).alias("start"), "source_size", "target", "passes", "rest", "quota", *row), block, seed, {r["source"]: begins[:, i] for i, r in enumerate(plan)}).withColumnRenamed("id", id_col)


def _draw(placed: DataFrame, block: int, seed: int, begins: dict) -> DataFrame:
    kind = pa.list_(pa.struct([("shard", pa.int64()), ("order", pa.int64()), ("from", pa.int64()), ("words", pa.int64())]))

    held = placed.sparkSession.sparkContext.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            num = {n: c[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("size", "source_size", "start", "passes", "rest", "quota")}
            size, start = num["size"], num["start"]
            first = start // block
            n = np.where(size > 0, (start + np.maximum(size, 1) - 1) // block - first + 1, 0)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            sources, of = np.unique(np.array([source_key(x) for x in c["source"].to_pylist()], object), return_inverse=True)
            salts = np.array([hash_source(None if x == "-" else x[1:], seed) for x in sources], np.uint64)
            salt, count, whole = salts[of][row], (-(-num["source_size"] // block))[row], (num["source_size"] // block)[row]
            passes, quota, rest = (num[x][row] for x in ("passes", "quota", "rest"))
            found = []
            for k in range(int(passes.max()) + 1 if len(row) else 0):
                full = k < passes
                # the line's last block may be short: the pass that is not whole draws it last, so that the words drawn meet the target
                among = np.where(full, count, np.maximum(whole, 1))
                key = salt + np.maximum(passes - k, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                place = np.where(full | (piece < whole), permuted(np.minimum(piece, among - 1), among, key), whole)
                drawn = np.flatnonzero(full | ((k == passes) & (place < quota)))
                # words of a block: all, but only what is left in the last block drawn; where that is the line's end, fewer
                words = np.where(~full & (place == quota - 1), rest - (quota - 1) * block, block)[drawn]
                r, p = row[drawn], piece[drawn]
                a = np.maximum(p * block, start[r])
                z = np.minimum(p * block + words, start[r] + size[r])
                some = z > a
                found.append([x[some] for x in (r, k * count[drawn] + place[drawn], a, z)])
            row, place, a, z = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
            by = np.lexsort((place, row))
            row, place, a, z = row[by], place[by], a[by], z[by]
            shard = np.zeros(len(row), np.int64)
            for i, x in enumerate(sources):
                mine = of[row] == i
                shard[mine] = np.searchsorted(held.value[x[1:] if x != "-" else None], place[mine], side="right") - 1
            order = _text.mix64(place.astype(np.uint64) + salts[of][row]).view(np.int64)
            cut = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            blocks = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in (shard, order, a - start[row], z - a)], ["shard", "order", "from", "words"]))
            taken = np.bincount(row, z - a, len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([c["id"], c["size"], c["source_size"], c["target"], pa.array(taken), c["passes"], blocks.cast(kind), *(c[x] for x in more)], ["id", "size", "source_size", "target", "taken", "passes", "blocks", *more])

    more = ["row"] if "row" in placed.columns else []
    return placed.mapInArrow(run, "id long, size long, source_size long, target double, taken long, passes long, blocks array<struct<shard:long,order:long,from:long,words:long>>" + "".join(f", {x} long" for x in more))


def source_key(source: str | None) -> str:
    """Sources that can be sorted: "+" and the source, or "-" for null."""
    return "-" if source is None else "+" + source


def hash_source(source: str | None, seed: int) -> int:
    import zlib

    return (zlib.crc32((source if source is not None else "\0null").encode()) << 20) ^ seed


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> None:
    """Mixes (``how``: as for mix) and writes the mixture as Parquet by shard: (shard, order, id, words as text), locally shuffled.

    Texts meet their plan by a key that each row of a written copy has, so ids may be null or repeated."""
    keyed = Scratch(df.sparkSession, "mix-rows").keep(df.select(id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()))
    plan = mix(keyed, id_col, text_col, source_col, row_col="row", **how).select("row", "blocks")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = keyed.select("row", id_col, words.alias("words")).join(plan, "row")
    # cut before they are dealt out, so that a piece doesn't carry its whole text
    cut = F.transform("blocks", lambda b: F.struct(b["shard"].alias("shard"), b["order"].alias("order"), b["from"].alias("from"), F.array_join(F.slice("words", b["from"].cast("int") + 1, b["words"].cast("int")), " ").alias("text")))
    pieces = texts.select("row", id_col, cut.alias("pieces")).select("row", id_col, F.explode("pieces").alias("p")).select("p.shard", "p.order", "row", "p.from", id_col, "p.text")
    pieces.repartition("shard").sortWithinPartitions("shard", "order", "row", "from").select("shard", "order", id_col, "text").write.partitionBy("shard").parquet(path)
