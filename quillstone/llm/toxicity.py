"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary text. A text is cut into windows of a
few words, each window is compressed under both, and the difference of the lengths is its evidence. A logistic curve over a text's
differences, calibrated on rows that the dictionaries have not seen, gives the probability.

Most windows of a toxic text are ordinary prose, so training goes in rounds: the rows are dealt into two folds, each fold's windows are
compared under the dictionaries of the other, and only windows that the toxic dictionary shortens, of both classes, train the next and
smaller dictionaries. Both stand before one base of ordinary prose, a trained dictionary as well, so that common words cost the
same under both. Of three settings, the one with the better calibration is kept: large
bases need many labelled rows.

The rounds go where most toxic windows lead, and may lose what is rarer, such as the insults of one of several languages. So a second
pair of dictionaries learns from those toxic texts only that the first leaves unexplained, and one curve reads the evidence of both.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import small_batches

_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_LEVEL, _WIDTH, _LEAST = 5, 6, 1024
#: A second pair of dictionaries costs as much scoring as the first, and stays if it lowers the calibration loss by this share.
_PASSES, _GAIN = 2, 0.03
#: Ends every window and the base, as the compressor seeks no match in an input's last bytes. Plain words hold none of these bytes.
_TAIL = bytes(range(1, 13))


@dataclass(frozen=True)
class Setting:
    """Sizes of the base and of a class's first dictionary, which halves each round; rounds; length of the segments that are picked."""

    base: int
    own: int
    rounds: int
    segment: int


SETTINGS = (Setting(32768, 8192, 3, 16), Setting(98304, 8192, 3, 16), Setting(8192, 8192, 3, 16))


def windows(text: str | None) -> list[bytes]:
    """The distinct windows of a text, in order: runs of six words in lower case, letters and digits only."""
    w = text.encode("utf-8", "replace").translate(_PLAIN).split() if text else []
    return list(dict.fromkeys(b" " + b" ".join(w[i : i + _WIDTH]) + b" " + _TAIL for i in range(0, len(w), _WIDTH)))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of the samples; where they are too few for the trainer, the last of the samples themselves."""
    bare = [x[: -len(_TAIL)] for x in samples]
    try:
        return zstandard.train_dictionary(size, bare, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(bare)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def differences(ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    """By how many bytes the toxic dictionary shortens each window more than the ordinary one."""
    o, t = ordinary.compress, toxic.compress
    return np.array([len(o(x)) - len(t(x)) for x in parts], float)


@dataclass
class ToxicityModel:
    """``pairs`` are the (ordinary, toxic) dictionaries' contents (their sizes are bounded by the setting), ``weights`` the curve."""

    pairs: list[tuple[bytes, bytes]]
    weights: list[float]
    _tools: list | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def evidence(self, text: str | None) -> list[float]:
        """Of each pair: the greatest difference, the mean of the three greatest, and the logs of how many reach 1, 2 and 3 bytes and
        of how many windows there are; differences are taken from their median. Zeros without words."""
        if self._tools is None:
            self._tools = [tuple(map(compressor, pair)) for pair in self.pairs]
        parts = windows(text)
        if not parts:
            return [0.0] * 6 * len(self.pairs)
        out = []
        for tools in self._tools:
            d = np.sort(differences(*tools, parts))[::-1]
            d -= d[len(d) // 2]
            out += [d[0] / 4, float(d[:3].mean()) / 4, *(math.log1p(int((d >= k).sum())) for k in (1, 2, 3)), math.log1p(len(d)) / 4]
        return out

    def score(self, text: str | None) -> float:
        x = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


Fold = tuple[list[list[bytes]], list[list[bytes]]]


def _dictionaries(folds: list[Fold], base: bytes, how: Setting) -> tuple[tuple[bytes, bytes], list[tuple[bytes, bytes]]]:
    """(ordinary, toxic) contents from folds of (toxic, ordinary) documents, each its windows; and those of each fold alone."""
    size = how.own

    def contents(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
        # of one length, so that the base lies equally far from a window
        return tuple(trained(x, size, how.segment)[-size:].rjust(size, b"\0") + base for x in (ordinary, toxic))

    whole = [tuple([x for doc in part for x in doc] for part in fold) for fold in folds]
    kept = whole
    for _ in range(how.rounds):
        tools = [tuple(map(compressor, contents(*x))) for x in kept]
        kept = [tuple([x for x, d in zip(part, differences(*tools[1 - i], part)) if d >= 1] for part in whole[i]) for i in (0, 1)]
        size = max(_LEAST, size // 2)
    return contents(kept[0][0] + kept[1][0], kept[0][1] + kept[1][1]), [contents(*x) for x in kept]


def _unexplained(folds: list[Fold], alone: list[tuple[bytes, bytes]]) -> list[Fold]:
    """The folds without the toxic documents whose greatest difference, under the dictionaries of the other fold, is above that of nine
    in ten ordinary ones."""
    out = []
    for i, (toxic, ordinary) in enumerate(folds):
        tools = tuple(map(compressor, alone[1 - i]))
        top = [np.array([differences(*tools, doc).max(initial=0) for doc in part]) for part in (toxic, ordinary)]
        least = np.quantile(top[1], 0.9) if len(top[1]) else 0
        out.append(([doc for doc, d in zip(toxic, top[0]) if d <= least], ordinary))
    return out


def fit_toxicity(rows: list[tuple[str | None, int]], shares: tuple[float, float] = (1.0, 1.0), settings: tuple[Setting, ...] = SETTINGS) -> ToxicityModel:
    """Fits on (text, label) rows. shares: by how much the rows of label 0 and 1 stand for more rows than themselves.

    Even rows train the dictionaries, odd rows calibrate the curve and choose among the settings and how many pairs stay. Without rows of both labels in
    either, the score is the share of toxic rows, or one half without any rows.
    """
    half, other = rows[::2], rows[1::2]
    cut = {k: [windows(text) for text, label in half if label == k] for k in (0, 1)}
    folds = [tuple(cut[k][i::2] for k in (1, 0)) for i in (0, 1)]
    y = np.array([label for _, label in other], float)
    weight = np.where(y > 0, shares[1], shares[0])

    best: tuple | None = None
    if len(set(y.tolist())) == 2 and all(any(x) for x in cut.values()):
        bases = {size: _TAIL + trained([x for _, ordinary in folds for doc in ordinary for x in doc], size, 64) + _TAIL for size in {s.base for s in settings}}
        known = np.zeros((len(other), 0))
        pairs: list[tuple[bytes, bytes]] = []
        for _ in range(_PASSES):
            tried = []
            for how in settings:
                pair, alone = _dictionaries(folds, bases[how.base], how)
                only = ToxicityModel([pair], [])
                x = np.column_stack([known, [only.evidence(text) for text, _ in other]])
                w = _logistic(x, y, weight)
                p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                loss = -float((weight * np.log(np.where(y > 0, p, 1 - p))).sum())
                tried.append((loss, ToxicityModel([*pairs, pair], w), alone, x))
            now = min(tried, key=lambda t: t[0])
            if best is not None and now[0] > (1 - _GAIN) * best[0]:
                break
            best, pairs, known = now, now[1].pairs, now[3]
            folds = _unexplained(folds, now[2])
            if not all(toxic for toxic, _ in folds):
                break
    if best is not None:
        return best[1]
    total = sum(shares[label] for _, label in rows)
    share = sum(shares[1] for _, label in rows if label) / total if total else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return ToxicityModel([(_TAIL, _TAIL)], [math.log(share / (1 - share))] + [0.0] * 6)


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[list[tuple[str | None, int]], tuple[float, float]]:
    """At most ``most`` labelled rows of each class with their whole texts, in an order drawn from their ids, and what each row stands
    for. The driver holds these texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
    rows = sorted((r["order"], r["text"] or "", r["label"]) for r in picked.select(F.xxhash64("id", F.lit(7)).alias("order"), "text", "label").collect())
    found = Counter(label for _, _, label in rows)
    return [(text, label) for _, text, label in rows], tuple(count.get(k, 0) / max(found[k], 1) for k in (0, 1))


def scorer(df: DataFrame, model: ToxicityModel):
    """A function of a text column: the probability that each whole text is toxic. Only texts go to Python, and only numbers come back.
    Null and empty texts get the score of a text without evidence."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for texts in parts:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return score


def toxicity(df: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, most: int = 3000) -> DataFrame:
    """(id, score, predicted) of every row; learns from the labelled rows whose id meets ``train`` (all, if None).

    The fit takes at most ``most`` rows of each class, drawn by hash, whole. A label other than 0 and 1, or null, is not used; of several
    labels of one id, 1 counts. Null and empty texts get the score of a text without evidence; null ids and repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    model = fit_toxicity(*labelled_sample(df, labels if train is None else labels.filter(train), id_col, text_col, label_col, most))
    scored = df.select(F.col(id_col), scorer(df, model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
