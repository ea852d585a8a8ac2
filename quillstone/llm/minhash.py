"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations serve for all signature coordinates: one scatters the shingles over [0, 2^32), the other, shifted circularly by k,
gives coordinate k; a coordinate is the least value over the text's shingles. Texts with one shingle set are one class, and only
the classes' least ids go on. Classes whose coordinates agree throughout a band are candidates; a candidate becomes a link when
the Jaccard similarity of the full sets reaches the threshold. With 64 bands of 8 coordinates, a pair at similarity 0.8 is missed
with probability 8e-6, one at 0.9 with 1e-16, while one at 0.3, as unrelated texts of a language may have, meets once in 240 times.

No bucket is expanded into all its pairs at once. In rounds, each bucket names a hub, the least id first and random members later;
members of other components are compared with it, and connected components follow. So a bucket of near copies costs a row for each
copy and round. What is left then are buckets of several components, as texts make that are alike but mostly not similar enough. Small
ones are joined to pairs. The members of large ones are dealt into chunks, and every two chunks of a bucket meet in a tile, in which
all sets are compared at once by products of blocks of their incidence matrix: only links come out, whatever the bucket's size, and
no tile holds more than two chunks, which are bounded in texts and in shingles. So no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._scratch import Scratch

BANDS, ROWS, ROUNDS, CHUNK, SMALL = 64, 8, 2, 512, 32
CHUNK_GRAMS = 2_000_000  # shingles in a chunk, 16 MB
_U32 = np.uint32


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit integers, in place."""
    t = x >> _U32(16)
    x ^= t
    x *= _U32(0x7FEB352D)
    np.right_shift(x, _U32(15), out=t)
    x ^= t
    x *= _U32(0x846CA68B)
    np.right_shift(x, _U32(16), out=t)
    x ^= t
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least of second((first(s) + k) mod 2^32) over the shingles s."""
    first = (shingles >> np.uint64(32)).astype(_U32)
    shift = np.arange(coordinates, dtype=_U32)
    out = np.full(coordinates, 0xFFFFFFFF, _U32)
    step = max(1, 65536 // coordinates)
    for i in range(0, len(first), step):
        np.minimum(out, _second(first[i : i + step, None] + shift[None, :]).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sig.reshape(bands, rows).T:
        key = _text.mix64(key ^ column.astype(np.uint64)) + np.uint64(1)
    return key


def _rows(batches: Iterator[pa.RecordBatch], k: int):
    for big in batches:
        for b in _text.slices(big, 1):
            h, first = _text.words(b.column(1))
            yield b.column(0), [_text.shingles(h[first[i] : first[i + 1]], k) for i in range(b.num_rows)]


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _rows(batches, k):
            n = np.array([len(s) for s in sets], np.int64)
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            high = np.array([_text.mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            keys = [band_keys(signature(s, bands * rows), bands, rows) for s in sets if len(s)]
            at = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["id", "n", "low", "high", "keys"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _rows(batches, k):
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "grams"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, class_id, component_id, kept) for each distinct id.

    class_id is the least id with the same shingle set, component_id the least id reachable over links, kept whether the row is
    that one. A null or empty text, or one of white space only, has no shingles and is linked with nothing; a text of fewer than
    ``k`` words is one shingle. Rows with a null id are left out, as they cannot be linked or named. Of rows that share an id, all
    texts take part and the id belongs to the least class among them. An empty table gives no rows; other columns are not read.
    """
    hundredths = round(100 * threshold)
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    data = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    signed = scratch.keep(data.mapInArrow(_signatures(k, bands, rows), "id long, n long, low long, high long, keys array<long>"))
    own = scratch.keep(signed.filter("n > 0").groupBy("n", "low", "high").agg(F.min("id").alias("rep")))
    members = signed.select("id", "n", "low", "high").join(own, ["n", "low", "high"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = scratch.keep(members)
    # a class takes part once, by the row whose id names it
    chosen = signed.filter("n > 0").join(own, (F.col("id") == F.col("rep")) & signed.n.eqNullSafe(own.n) & (signed.low == own.low) & (signed.high == own.high), "left_semi")
    banded = chosen.select("id", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("key")
    held = scratch.keep(banded.join(shared, "key", "left_semi").select("key", "id", "n"))
    scratch.drop(signed)

    # whole sets, of those texts only that share a bucket
    sets = scratch.keep(data.join(held.select("id").distinct(), "id", "left_semi").mapInArrow(_sets(k), "id long, grams array<long>"))
    similar_size = f"100 * least(n_a, n_b) >= {hundredths} * greatest(n_a, n_b)"  # sizes alone bound the similarity

    links = compared = labels = None
    split = held.withColumn("label", F.col("id"))
    for r in range(ROUNDS + 1):
        if r:
            labelled = held.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
            mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
            split = scratch.keep(labelled.join(mixed, "key", "left_semi"))
            if split.isEmpty():
                break
        if r == ROUNDS:
            size = split.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("grams_of_key"))
            sized = scratch.keep(split.join(size, "key"))
            x, y = (sized.filter(f"m <= {SMALL}").select("key", "id", "n", "label").toDF("key", c, f"n_{c}", f"label_{c}") for c in "ab")
            pairs = x.join(y, "key").filter("a < b")
        else:
            y = split.toDF("key", "b", "n_b", "label_b")
            order = F.col("id") if r == 0 else F.xxhash64(F.lit(r), "id")
            hub = split.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "label")).alias("h")).select("key", F.col("h.id").alias("a"), F.col("h.n").alias("n_a"), F.col("h.label").alias("label_a"))
            pairs = y.join(hub, "key")
        pairs = pairs.filter(f"label_a <> label_b and {similar_size}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.keep(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))
        found = _verified(sets, pairs, hundredths, scratch)
        if r == ROUNDS:
            found = scratch.keep(found.unionByName(_tiled(sized.filter(f"m > {SMALL}"), sets, hundredths)).distinct())
        compared = pairs if compared is None else compared.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links, scratch)
    joined = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "n", "rep", F.coalesce("label", "rep").alias("label"))
    per = joined.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("rep").alias("class_id"), F.min("label").alias("component_id"))
    return per.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _tiled(members: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Links (a, b) between different labels within each bucket, of members (key, id, label, m, grams_of_key), the bucket's size in
    texts and in shingles; both bound a chunk."""
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("grams_of_key") / CHUNK_GRAMS)).cast("int")
    dealt = members.select("key", "id", "label", chunks.alias("g"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("c"))
    others = F.sequence(F.lit(0), F.col("g") - 1)
    tiles = dealt.select("key", "id", "label", F.explode(F.transform(others, lambda o: F.struct(F.least(o, F.col("c")).alias("i"), F.greatest(o, F.col("c")).alias("j")))).alias("t"))
    tile = F.xxhash64("key", "t.i", "t.j").alias("tile")
    return tiles.select(tile, "id", "label").join(sets, "id").select("tile", "id", "label", "grams").groupBy("tile").applyInArrow(lambda t: _compare(t, hundredths), "a long, b long")


def _compare(tile: pa.Table, hundredths: int, block: int = 8192) -> pa.Table:
    """The links among a tile's sets. Shingles of one set only are left out; the others form the incidence matrix's columns."""
    ids, labels = tile["id"].to_numpy(), tile["label"].to_numpy()
    lists = tile["grams"].combine_chunks()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    grams, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1 if len(grams) else new
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    both = np.zeros((len(n), len(n)), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        i, j = np.searchsorted(column, (a, a + block))
        part = np.zeros((len(n), block), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        both += part @ part.T
    like = 100 * both >= hundredths * (n[:, None] + n[None, :] - both)
    x, y = np.nonzero(like & (labels[:, None] != labels[None, :]) & (ids[:, None] < ids[None, :]))
    return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})


def _verified(sets: DataFrame, pairs: DataFrame, hundredths: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    found = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("of_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("of_a")), "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return scratch.keep(found.filter(100 * both >= hundredths * (F.size("of_a") + F.size("of_b") - both)).select("a", "b").distinct())
