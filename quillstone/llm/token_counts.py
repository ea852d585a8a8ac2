"""Token counts by a map-side lookup in two tiers.

Tier one is a broadcast table from frequent pre-tokens to their token counts: the most frequent pre-tokens of a bounded sample
(at most ``frequent`` entries, so its size has a bound). Tier two is a cache in each worker: a pre-token that misses is encoded
once and kept, up to ``cache`` entries. Both tiers only spare work: whatever they hold, the count of every text is exact, and no
pre-token is ever shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import small_batches

#: The rule of the byte-level pre-tokenizer, for files that name it; white space by its Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_workers: dict = {}


def merger(path: str):
    """A function from pre-token to number of tokens. Where the file's merges stand in the order of their products' ids, merging by
    rank gives the library's tokens, several times faster; else the library encodes."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    if [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and all(c in byte for w in vocab for c in w):
        import tiktoken

        ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
        plain = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return library, lambda piece: len(plain.encode_ordinary(piece))
    return library, lambda piece: len(library.encode(piece, add_special_tokens=False).ids)


def byte_level(path: str) -> bool:
    """Whether the file cuts texts by the byte-level rule and nothing else: no normalizer, no added space, and added tokens that stand as
    they are. Texts of other tokenizers are encoded whole by the library."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cut = said.get("pre_tokenizer") or {}
    whole = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) or not t.get("content") for t in said.get("added_tokens", []))
    return said.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and whole


class Counts(dict):
    """Pre-token to token count; a miss is encoded and kept."""

    def __init__(self, path: str, known: dict[str, int], cache: int):
        super().__init__(known)
        self.library, self.encode = merger(path)
        library, self.plain = self.library, byte_level(path)
        self.known, self.most = known, cache + len(known)
        self.special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        self[piece] = n = self.encode(piece)
        return n

    def count(self, text: str) -> int:
        if not self.plain:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.split is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.pieces.findall(text)))
        return sum(map(self.count_plain, self.split.split(text))) + len(self.split.findall(text))

    def count_plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces.findall(text)))


def counter(path: str, known: dict[str, int], cache: int) -> Counts:
    """One for each worker process and tokenizer."""
    if path not in _workers:
        _workers[path] = Counts(path, known, cache)
    return _workers[path]


def frequent_pieces(df: DataFrame, text: str, path: str, frequent: int, sample: int) -> dict[str, int]:
    """The table of tier one, fitted on about ``sample`` rows drawn from all partitions, whole; it cannot change any count."""
    c, seen, rows = Counts(path, {}, 1 << 20), Counter(), df.count()
    for row in df.select(text).sample(min(1.0, sample / max(rows, 1)), seed=11).limit(2 * sample).toLocalIterator():
        seen.update(c.pieces.findall(row[0] or ""))
    return {p: c[p] for p, _ in seen.most_common(frequent)}


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = 50_000, sample: int = 2_000, cache: int = 400_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``df``.

    Special strings inside a text count as the tokenizer's default has it: one token each. A null text counts as empty (0, 0,
    false); a null id stays null; repeated rows each give a row; other columns are not read. An empty table gives no rows.
    ``tokenizer`` is the path of a byte-level .json tokenizer, present on every worker.
    """
    spark: SparkSession = df.sparkSession
    known = spark.sparkContext.broadcast(frequent_pieces(df, text_col, tokenizer, frequent, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, known.value, cache)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(df.sparkSession)
    data = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
