"""Language-model scoring by Elias-Fano n-gram tries.

Every word has its own n-grams: it is named by its hash. The most frequent words, a bounded table that is broadcast, only have short
codes on the way; the counts of all others are sent to the shards that ask for them. Trigrams (u, v, w) are counted over all training
texts and divided among shards by v, a frequent v further by w. A shard holds everything that begins with its v: a trie whose levels are Elias-Fano sequences in a memory-mapped file: the
roots v, the successors w of each v, the contexts u of each v, and for each context the ranks of its words among the successors of
v (context-relative identifiers). Pointers are monotone, probabilities quantised. A query finds w among v's successors, u among its
contexts, and then the rank within the context's range.

Smoothing is hierarchical: each level is shrunk toward the one below as if by ``mu`` prior observations, so every level sums to one.
The texts' n-grams meet the counts in one shuffle, packed by batch and shard; only sums by text come back.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch

RARE, BEGIN, FREQUENT = 65534, 65535, 65534
_END = np.uint64(0x5EED0F7E57E4D000)
_STEP = 4096.0
_BLOCK = 1 << 12
#: In place of a batch, for rows that bring counts of words.
COUNTS = (1 << 63) - 1


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as compressed bytes."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    # bytes of equal weight stand together, which compresses well
    body = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values())
    return zstandard.compress(len(head).to_bytes(4, "little") + head + body, 1)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out[name] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().reshape(-1).view(kind)
        at += n * size
    return out


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, and the place of every 4096th element. Only blocks that can hold
    what is asked for are decoded."""

    def __init__(self, n: int, bits: int, low, high, samples):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples
        #: a block's first high part: what its first place leaves without the ones before it
        self.heads = np.asarray(samples) - np.arange(len(samples)) * _BLOCK

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        most = int(values[-1]) + 1 if n else 1
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return n, bits, low, np.packbits(high, bitorder="little"), places[::_BLOCK]

    def block(self, a: int, b: int) -> np.ndarray:
        """Elements a (a multiple of 4096) to b."""
        begin = int(self.samples[a // _BLOCK])
        end = int(self.samples[b // _BLOCK]) if b < self.n else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) :][: b - a]
        out = (ones - np.arange(a, b)).astype(np.int64) << self.bits
        if self.bits:
            at = a * self.bits
            raw = np.unpackbits(self.low[at // 8 : -(-(b * self.bits) // 8)], bitorder="little")[at % 8 :][: (b - a) * self.bits]
            out |= raw.reshape(-1, self.bits).astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted value stands, or -1; values are distinct in the sequence. By successor search: the heads tell the first
        block that can hold a value; the search goes on in the next one while its values are too small."""
        out = np.full(len(wanted), -1, np.int64)
        order = np.argsort(wanted, kind="stable")
        ordered, at = wanted[order], 0
        # a value stands before the first block whose head is above its own high part, and not before the last whose head is below
        high = ordered >> self.bits
        begins = np.maximum(np.searchsorted(self.heads, high, side="left") - 1, 0)
        block = 0
        while at < len(ordered) and self.n:
            block = max(block, int(begins[at]))
            a = block * _BLOCK
            if a >= self.n:
                break
            values = self.block(a, min(a + _BLOCK, self.n))
            z = int(np.searchsorted(ordered, values[-1], side="right"))
            if z > at:
                i = np.searchsorted(values, ordered[at:z])
                out[order[at:z]] = np.where(values[i] == ordered[at:z], i + a, -1)
                at = z
            block += 1
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The elements at some places."""
        out = np.zeros(len(places), np.int64)
        order = np.argsort(places, kind="stable")
        ordered = places[order]
        blocks, cut = np.unique(ordered // _BLOCK, return_index=True)
        for k, i, j in zip(blocks.tolist(), cut, [*cut[1:], len(ordered)]):
            a = k * _BLOCK
            out[order[i:j]] = self.block(a, min(a + _BLOCK, self.n))[ordered[i:j] - a]
        return out

    def all(self) -> np.ndarray:
        return self.at(np.arange(self.n))


def quantise(p: np.ndarray) -> np.ndarray:
    """log10 probabilities in steps of 1/4096, down to -16."""
    return np.minimum(np.round(-np.log10(p) * _STEP), 65535).astype(np.uint16)


class Trie:
    """The levels of one shard, in a memory-mapped file of the worker's own folder that is unlinked as soon as it is open."""

    def __init__(self, trigrams: np.ndarray, words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, context_counts: np.ndarray, unigram: np.ndarray, before: np.ndarray, mu: tuple[float, float]):
        """trigrams, words: v << 32 | u and w of each, sorted; contexts: sorted v << 32 | u, a superset of theirs; unigram: probability
        by id; before: how many training tokens follow each id."""
        v, low, self.width = trigrams >> np.uint64(32), np.uint64(0xFFFFFFFF), len(unigram)
        bigrams, which = np.unique(v << np.uint64(32) | words.astype(np.uint64), return_inverse=True)
        bigram_counts = np.bincount(which, counts, len(bigrams))
        bv, bw = (bigrams >> np.uint64(32)).astype(np.int64), (bigrams & low).astype(np.int64)
        cv = (contexts >> np.uint64(32)).astype(np.int64)
        roots = np.unique(cv)
        p2 = (bigram_counts + mu[0] * unigram[bw]) / (before[bv] + mu[0])
        of = np.searchsorted(contexts, trigrams)
        p3 = (counts + mu[1] * p2[which]) / (context_counts[of] + mu[1])
        first = np.searchsorted(bv, roots)
        rank = which - first[np.searchsorted(roots, v.astype(np.int64))]
        self.stride = int(rank.max()) + 1 if len(rank) else 1
        parts, self.at = [], {}
        for name, values in (("roots", roots), ("first", first), ("successors", np.searchsorted(roots, bv) * self.width + bw), ("contexts", np.searchsorted(roots, cv) * self.width + (contexts & low).astype(np.int64)), ("ranks", of * self.stride + rank)):
            n, bits, *arrays = EliasFano.encode(np.asarray(values))
            self._put(parts, name, arrays, (n, bits))
        for name, codes in (("p2", quantise(p2)), ("back", quantise(mu[1] / (context_counts + mu[1]))), ("p3", quantise(p3))):
            self._put(parts, name, [codes], ())
        self.unigram, self.back2 = np.log10(unigram), np.log10(mu[0] / (before + mu[0]))
        self.file = tempfile.TemporaryFile()
        self.file.write(b"".join(parts) or b"\0")
        self.file.flush()
        self.bytes = self.file.tell()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def _put(self, parts: list[bytes], name: str, arrays: list[np.ndarray], more: tuple) -> None:
        places = []
        for a in arrays:
            offset = sum(map(len, parts))
            raw = a.tobytes()
            parts.append(raw + b"\0" * (-len(raw) % 8))
            places.append((offset, len(a), a.dtype.str))
        self.at[name] = (more, places)

    def _get(self, name: str):
        more, places = self.at[name]
        arrays = [np.frombuffer(self.map, kind, n, offset) for offset, n, kind in places]
        return EliasFano(*more, *arrays) if more else arrays[0]

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probabilities of w after u v."""
        root = self._get("roots").find(v)
        there = root >= 0
        successor, context, ranked = (np.full(len(v), -1, np.int64) for _ in range(3))
        successor[there] = self._get("successors").find(root[there] * self.width + w[there])
        context[there] = self._get("contexts").find(root[there] * self.width + u[there])
        both = (successor >= 0) & (context >= 0)
        first = self._get("first").at(root[both])
        ranked[both] = self._get("ranks").find(context[both] * self.stride + successor[both] - first)
        known = lambda codes, at: -codes[np.maximum(at, 0)].astype(float) / _STEP if len(codes) else np.zeros(len(at))
        two = np.where(successor >= 0, known(self._get("p2"), successor), self.back2[v] + self.unigram[w])
        return np.where(ranked >= 0, known(self._get("p3"), ranked), two + np.where(context >= 0, known(self._get("back"), context), 0.0))


@dataclass
class Vocabulary:
    """The most frequent words in hash order with their codes; counts in training and in all texts by code; and totals of training:
    N tokens, V distinct. every: tokens of all texts."""

    hashes: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    tokens: int
    distinct: int
    every: int
    shards: int

    def __post_init__(self):
        self.base = np.log10(self.probability(self.counts))
        self.base[RARE:] = 0.0
        # a word that holds more than a shard's share goes to several
        self.parts = np.maximum(1, np.ceil(self.totals * self.shards / max(self.every, 1))).astype(np.int64)
        self.home = (_text.mix64(np.arange(65536, dtype=np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        self.spread = (_text.mix64(np.arange(65536, dtype=np.uint64) + np.uint64(99991)) >> np.uint64(1)).astype(np.int64)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def classify(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), RARE, np.uint16)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.classes[i], RARE).astype(np.uint16)

    def number(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, ids, names): a word without a code has the id 65536 + its place among names, the sorted hashes of such words."""
        code = self.classify(h)
        rare = np.flatnonzero(code == RARE)
        names, which = np.unique(h[rare], return_inverse=True)
        ids = code.astype(np.int32)
        ids[rare] = 65536 + which
        return code, ids, names

    def place(self, one: np.ndarray, w: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The shards of w after one."""
        home = np.concatenate([self.home, (_text.mix64(names) % np.uint64(self.shards)).astype(np.int64)])
        spread = np.concatenate([self.spread, (_text.mix64(names + np.uint64(99991)) >> np.uint64(1)).astype(np.int64)])
        parts = np.concatenate([self.parts, np.ones(len(names), np.int64)])
        return (home[one] + spread[w] % parts[one]) % self.shards


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each, first of each row) with an end after every text."""
    h, first = _text.words(column)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    out = np.full(len(h) + len(n), _END, np.uint64)
    out[np.arange(len(h)) + row] = h
    start = first[:-1] + np.arange(len(n))
    return out, np.repeat(np.arange(len(n)), n + 1), np.append(start, len(out))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        h, where = np.unique(np.concatenate([a for a, _, _ in held]), return_inverse=True)
        c, t = (np.bincount(where, np.concatenate([x[k] for x in held])).astype(np.int64) for k in (1, 2))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(t)], ["h", "c", "t"])

    for big in batches:
        for b in _text.slices(big, 1):
            if b.num_rows:
                h, row, _ = tokens(b.column(1))
                train = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
                h, where = np.unique(h, return_inverse=True)
                held.append((h, np.bincount(where, train[row], len(h)), np.bincount(where, minlength=len(h))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    yield merged()
    if held:
        yield merged()


def learn_vocabulary(data: DataFrame, scratch: Scratch, per_shard: int = 700_000) -> tuple[Vocabulary, DataFrame]:
    """Counts every token, in training and in all; only totals and the FREQUENT most frequent words (a bound) reach the driver. The
    table (h, c, t) of all words stays where it is."""
    vocab = scratch.keep(data.select("train", "text").mapInArrow(_counts, "h long, c long, t long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    r = vocab.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c", "t")), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    rows = data.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("c"), F.count("*").alias("t")).first()
    top = vocab.orderBy(F.desc("t"), "h").limit(FREQUENT).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    counts, totals = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for x, name in ((counts, "c"), (totals, "t")):
        x[: len(h)] = top[name].to_numpy()
        x[BEGIN] = rows[name]
    order = np.argsort(h)
    return Vocabulary(h[order], order.astype(np.uint16), counts, totals, int(r["c"]), int(r["v"]), int(r["t"]), max(64, -(-int(r["t"]) // per_shard))), vocab


def _asked(v: Vocabulary):
    """(h, shard): the words without a code whose counts a shard needs, each once for a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _text.slices(big, 0):
                if not b.num_rows:
                    continue
                h, _, first = tokens(b.column(0))
                _, w, names = v.number(h)
                one = np.roll(w, 1)
                one[first[:-1]] = BEGIN
                rare = np.flatnonzero(w >= 65536)
                pairs = np.unique((w[rare].astype(np.int64) - 65536) * v.shards + v.place(one[rare], w[rare], names))
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs // v.shards].view(np.int64)), pa.array((pairs % v.shards).astype(np.int32))], ["h", "shard"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (shard, h, c) by shard."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        shard, h, c = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        held.clear()
        order = np.argsort(shard, kind="stable")
        found, at = np.unique(shard[order], return_index=True)
        return _rows([(int(s), COUNTS, pack(h=h[i], c=c[i])) for s, i in zip(found, np.split(order, at[1:]))])

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) > 4_000_000:
                yield packed()
    if held:
        yield packed()


def _emit(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part = 0, TaskContext.get().partitionId()
        for big in batches:
            for b in _text.slices(big, 2):
                if not b.num_rows:
                    continue
                batch = part << 32 | seq
                seq += 1
                yield from _emit_batch(v, b, batch)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["shard", "batch", "blob"])


def _emit_batch(v: Vocabulary, b: pa.RecordBatch, batch: int) -> Iterator[pa.RecordBatch]:
    h, row, first = tokens(b.column(2))
    train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
    code, w, names = v.number(h)
    one, two = np.roll(w, 1), np.roll(w, 2)
    start = first[:-1]
    one[start] = two[start] = BEGIN
    inner = start + 1
    two[inner[inner < first[1:]]] = BEGIN
    shard = v.place(one, w, names).astype(np.uint16 if v.shards < 65536 else np.int64)
    order = np.argsort(np.where(one < 65536, one, RARE).astype(np.uint16), kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    cut = np.searchsorted(shard[order], np.arange(v.shards + 1))
    # contexts of divided words, for each of their shards; these have codes
    several = np.flatnonzero((v.parts[np.minimum(one, BEGIN)] > 1) & (one < 65536) & train[row])
    pairs, count = np.unique(one[several].astype(np.int64) << 32 | two[several], return_counts=True)
    parts = v.parts[pairs >> 32]
    copies = np.repeat(np.arange(len(pairs)), np.minimum(parts, v.shards))
    nth = np.arange(len(copies)) - np.repeat(np.cumsum(np.minimum(parts, v.shards)) - np.minimum(parts, v.shards), np.minimum(parts, v.shards))
    to = (v.home[pairs[copies] >> 32] + nth) % v.shards
    by = np.argsort(to, kind="stable")
    copies = copies[by]
    copy_cut = np.searchsorted(to[by], np.arange(v.shards + 1))
    flags, kind = np.packbits(train), np.uint16 if b.num_rows < 65536 else np.uint32
    out = []
    for s in range(v.shards):
        i, c = order[cut[s] : cut[s + 1]], copies[copy_cut[s] : copy_cut[s + 1]]
        if len(i) or len(c):
            ids = np.concatenate([one[i], two[i], w[i], pairs[c] >> 32, pairs[c] & 0xFFFFFFFF])
            rare = ids >= 65536
            mine, at = np.unique(ids[rare], return_inverse=True)
            ids[rare] = RARE
            out.append((s, batch, pack(code=ids.astype(np.uint16), at=at.astype(np.uint16 if len(mine) < 65536 else np.uint32), names=names[mine - 65536], row=row[i].astype(kind), pair_n=count[c].astype(np.uint32), flags=flags)))
    yield _rows(out)
    n = np.diff(first)
    yield _rows([(batch % v.shards, -1 - batch, _meta(b.column(0), train, n, np.bincount(row, v.base[code], b.num_rows), np.bincount(row, (code != RARE) & (v.counts[code] > 0), b.num_rows).astype(np.int64)))])


def _meta(ids: pa.Array, train: np.ndarray, n: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    table = pa.table({"id": ids, "train": train, "n": n, "base": base, "known": known})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def _score(v: Vocabulary, mu: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        counts: dict[int, list[bytes]] = defaultdict(list)
        for b in batches:
            for s, batch, blob in zip(*(c.to_pylist() for c in b.columns)):
                if batch < 0:
                    yield _rows([(-1, -1 - batch, blob)])
                elif batch == COUNTS:
                    counts[s].append(blob)
                else:
                    shards[s].append((batch, blob))
        for s in sorted(shards):
            yield from _score_shard(v, mu, s, sorted(shards.pop(s)), counts.pop(s, []))
            pa.default_memory_pool().release_unused()

    return run


def _score_shard(v: Vocabulary, mu: tuple[float, float], shard: int, blobs: list[tuple[int, bytes]], known_counts: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts = [unpack(blob) for _, blob in blobs]
    size = [len(p["flags"]) * 8 for p in parts]
    shift = np.concatenate(([0], np.cumsum(size)))
    train = np.concatenate([np.unpackbits(p["flags"]) for p in parts]).astype(bool)
    row = np.concatenate([p["row"].astype(np.int64) + o for p, o in zip(parts, shift)])
    # ids of this shard: the codes, then its words without one in hash order
    names, named = np.unique(np.concatenate([p["names"] for p in parts]), return_inverse=True)
    begin, fields = 0, [[] for _ in range(5)]
    for p in parts:
        ids, n, c = p["code"].astype(np.uint64), len(p["row"]), len(p["pair_n"])
        ids[p["code"] == RARE] = 65536 + named[begin : begin + len(p["names"])][p["at"]]
        begin += len(p["names"])
        for field, x in zip(fields, np.split(ids, [n, 2 * n, 3 * n, 3 * n + c])):
            field.append(x)
    one, two, word, pair_v, pair_u = map(np.concatenate, fields)
    pair_n = np.concatenate([p["pair_n"] for p in parts])
    del parts, fields
    told = [unpack(blob) for blob in known_counts]
    told_h, at = np.unique(np.concatenate([p["h"] for p in told]).view(np.uint64), return_index=True) if told else (np.zeros(0, np.uint64), [])
    rare_counts = np.zeros(len(names), np.int64)
    if len(told_h):
        i = np.minimum(np.searchsorted(told_h, names), len(told_h) - 1)
        rare_counts = np.where(told_h[i] == names, np.concatenate([p["c"] for p in told])[at][i], 0)
    del told
    word_counts = np.concatenate([v.counts, rare_counts])
    unigram = v.probability(word_counts)
    is_rare = np.flatnonzero(word >= 65536)
    rare_row, rare_word = row[is_rare], word[is_rare].astype(np.int64)
    # by context and word: wider than one key
    pairs, of = np.unique(one << np.uint64(32) | two, return_inverse=True)
    queries, where = np.unique(of.astype(np.uint64) << np.uint64(32) | word, return_inverse=True)
    del one, two, word, of
    pair_of, w = (queries >> np.uint64(32)).astype(np.int64), (queries & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.bincount(where, train[row], len(queries))
    seen = counts > 0
    context_counts = np.bincount(pair_of, counts, len(pairs))
    contexts, context_counts = pairs[context_counts > 0], context_counts[context_counts > 0]
    # all that follows a word without a code is in its one shard
    before = np.bincount((pairs[pair_of] >> np.uint64(32)).astype(np.int64), counts, len(unigram))
    before[:65536] = v.counts
    if len(pair_n):
        pair, of = np.unique(pair_v << np.uint64(32) | pair_u, return_inverse=True)
        n = np.bincount(of, pair_n, len(pair))
        holder = (contexts >> np.uint64(32)).astype(np.int64)
        own = (holder >= 65536) | (v.parts[np.minimum(holder, BEGIN)] == 1)
        contexts, context_counts = np.concatenate([contexts[own], pair]), np.concatenate([context_counts[own], n])
        order = np.argsort(contexts)
        contexts, context_counts = contexts[order], context_counts[order]
    trie = Trie(pairs[pair_of[seen]], w[seen], counts[seen], contexts, context_counts, unigram, before, mu)
    asked = trie.score((pairs[pair_of] >> np.uint64(32)).astype(np.int64), (pairs[pair_of] & np.uint64(0xFFFFFFFF)).astype(np.int64), w)
    # numpy counts in integers where there is nothing to weigh
    score = np.bincount(row, asked[where], shift[-1]).astype(float)
    touched = np.bincount(row, minlength=shift[-1]) > 0
    base = np.bincount(rare_row, np.log10(unigram[rare_word]), shift[-1]).astype(float)
    known = np.bincount(rare_row, word_counts[rare_word] > 0, shift[-1])
    rare = np.bincount(rare_row, minlength=shift[-1]) > 0
    for (batch, _), a, z in zip(blobs, shift, shift[1:]):
        i, j = np.flatnonzero((touched | rare)[a:z]), np.flatnonzero(rare[a:z])
        yield _rows([(shard, batch, pack(i=i.astype(np.uint32), score=score[a:z][i].astype(np.float32), j=j.astype(np.uint32), base=base[a:z][j], known=known[a:z][j].astype(np.uint32)))])


def _gather(total: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["shard"].to_pylist(), group["blob"].to_pylist()))
        meta = pa.ipc.open_stream(zstandard.decompress(rows[0][1])).read_all()
        base, known, score = meta["base"].to_numpy().copy(), meta["known"].to_numpy().copy(), np.zeros(meta.num_rows)
        for _, blob in rows[1:]:
            p = unpack(blob)
            score[p["i"]] += p["score"]
            base[p["j"]] += p["base"]
            known[p["j"]] += p["known"]
        return pa.table({"id": meta["id"], "train": meta["train"], "n_tokens": meta["n"], "n_known": known, "train_tokens": np.full(meta.num_rows, total), "base_score": base, "score": score})

    return run


def language_model_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: tuple[float, float] = (1000.0, 30.0)) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows for which ``train`` is true.

    A null or empty text is one end token. Null ids stay; a null ``train`` counts as false; each of repeated rows is scored, and
    counted in training. Without training rows, every probability is one. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "ngram")
    data = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    v, vocab = learn_vocabulary(data, scratch)
    held = df.sparkSession.sparkContext.broadcast(v)
    kind = "shard int, batch long, blob binary"
    asked = data.select("text").mapInArrow(lambda it: _asked(held.value)(it), "h long, shard int")
    told = asked.join(vocab, "h").select("shard", "h", "c").mapInArrow(_answered, kind)
    sent = data.mapInArrow(lambda it: _emit(held.value)(it), kind).unionByName(told).repartitionById(v.shards, F.col("shard"))
    sums = sent.mapInArrow(lambda it: _score(held.value, mu)(it), kind)
    out = sums.groupBy("batch").applyInArrow(_gather(v.tokens), "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
