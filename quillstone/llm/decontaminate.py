"""Benchmark decontamination by greedy string tiling.

A word is a run of letters and digits, A-Z lower-cased. Karp-Rabin hashes of all runs of ``seed`` words are looked up among those of
the benchmark's items; a text and an item that share one are tiled: seeds grow to maximal matches, the longest is marked in both,
what overlaps it is cut down to its unmarked parts, and so on until no match of ``seed`` words is left. The marked share of the
item's words is its coverage. As tiles need not be in order, a passage whose sentences were moved about is still covered.

The benchmark is a set of queries against all texts: it is read in blocks of bounded size, each broadcast in turn, so texts are never
shuffled, and a passage that many texts share costs each of them its own tiling only.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import small_batches

_APART = np.array([not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128) for c in range(256)])
_BITS = 22


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return _text.mix64(out)


def tiles(text: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, length), longest first; of equal ones, the first in the item, then the text.

    hits: (i, j) where seed words of the text from i and of the item from j are equal.
    """
    diagonals = defaultdict(list)
    for i, j in hits:
        diagonals[i - j].append(j)
    queue = []
    for d, starts in diagonals.items():
        starts.sort()
        begin = last = starts[0]
        for j in [*starts[1:], None]:
            if j is None or j > last + 1:
                queue.append((-(last - begin + seed), begin, begin + d))
                begin = j
            last = j
    heapq.heapify(queue)
    marked_item, marked_text, out = np.zeros(len(item), bool), set(), []
    while queue:
        size, j, i = heapq.heappop(queue)
        size = -size
        free = [not marked_item[j + x] and i + x not in marked_text for x in range(size)]
        if all(free):
            marked_item[j : j + size] = True
            marked_text.update(range(i, i + size))
            out.append((i, j, size))
            continue
        x = 0
        while x < size:
            y = x
            while y < size and free[y]:
                y += 1
            if y - x >= seed:
                heapq.heappush(queue, (-(y - x), j + x, i + x))
            x = max(y, x + 1)
    return out


class _Seeds:
    """The runs of ``seed`` words of some items, in hash order."""

    def __init__(self, words: np.ndarray, first: np.ndarray, items: np.ndarray, seed: int):
        self.seed = seed
        found = [_runs(words[first[i] : first[i + 1]], seed) for i in items.tolist()]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(items, [len(x) for x in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, runs: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen[(runs >> np.uint64(64 - _BITS)).astype(np.int64)])


class _Block:
    """Items of one block. Those of fewer than ``seed`` words are sought whole: their own length is their seed."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in items]
        data, at = _text.buffers(pa.array([t for _, t in items], pa.large_string()))
        self.words, self.first = words(data, at)
        n = np.minimum(np.diff(self.first), seed)
        self.seeds = [_Seeds(self.words, self.first, np.flatnonzero(n == k), k) for k in np.unique(n[n > 0]).tolist()]

    def covers(self, seeds: _Seeds, text: np.ndarray, runs: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """(item, coverage, tiles) of each item that shares a seed with the text; at: where runs may be seeds."""
        left, right = np.searchsorted(seeds.hashes, runs[at], "left"), np.searchsorted(seeds.hashes, runs[at], "right")
        hits = defaultdict(list)
        for i, a, b in zip(at.tolist(), left.tolist(), right.tolist()):
            for x in range(a, b):
                hits[int(seeds.item[x])].append((i, int(seeds.place[x])))
        for item, pairs in hits.items():
            own = self.words[self.first[item] : self.first[item + 1]]
            found = tiles(text, own, pairs, seeds.seed)
            yield item, sum(n for _, _, n in found) / len(own), len(found)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = _text.spans(data, at, _APART)
    return _text.hash_spans(data, starts, ends), first


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, threshold: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """(id, item, coverage, n_tiles), a row for each text and item whose coverage reaches ``threshold``.

    Items of fewer than ``seed`` words are sought whole; null ones and those without a word match nothing, and so do null and empty
    texts. Repeated rows and items each count for themselves; null ids are kept, items without an id left out. Items longer than ``block_chars`` form blocks of their own. An empty table on either side gives no rows.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    small_batches(df.sparkSession)
    data = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def one(k: int) -> DataFrame:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        block = _Block([(r["item"], r["text"]) for r in mine.orderBy("item", "text").collect()], seed)
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for big in batches:
                for b in _text.slices(big, 1):
                    h, first = words(*_text.buffers(b.column(1)))
                    out = []
                    for seeds in block.seeds:
                        runs = _runs(h, seeds.seed)
                        at = seeds.candidates(runs)
                        row = np.searchsorted(first, at, side="right") - 1
                        inside = at + seeds.seed <= first[row + 1]
                        at, row = at[inside], row[inside]
                        for r in np.unique(row).tolist():
                            a, z = int(first[r]), int(first[r + 1])
                            mine = at[row == r] - a
                            out += [(b.column(0)[r].as_py(), block.ids[i], c, n) for i, c, n in block.covers(seeds, h[a:z], runs[a:z], mine) if c >= threshold]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["id", "item", "coverage", "n_tiles"])

        return data.mapInArrow(run, "id long, item long, coverage double, n_tiles long")

    found = reduce(DataFrame.unionByName, [one(k) for k in range(blocks)])
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "n_tiles")
