"""Quality by hierarchical empirical Bayes.

A document classifier reads a text's shape and common words. Hosts, and paths within hosts, get posteriors: a site's labelled rows
and its rows' classifier evidence are grouped, and shrunk toward the level above with a strength that is itself estimated from how
much sites differ (a beta prior by moments). Sparse sites stay near the global prior. A row's probability combines its classifier
odds with its path's posterior odds against the global prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch, small_batches
from .toxicity import _logistic, labelled_sample

_LETTER = np.array([65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in range(256)])
_DIGIT = np.array([48 <= c < 58 for c in range(256)])
_UPPER = np.array([65 <= c < 91 for c in range(256)])
_END = np.array([c in b".!?" for c in range(256)])
_STOPS = "the of and to in a is that for it on de la le les et un une des du que en el los y der die und das zu von den ist mit auf".split()
FEATURES = 12


def features(text: str | None) -> np.ndarray:
    """Length, shares of letters, digits, capitals, signs, sentence ends, mean word length, share of distinct words, of the commonest
    word, of common words, and of repeated lines; all bounded."""
    raw = text.encode("utf-8", "replace") if text else b""
    if not raw.strip():
        return np.zeros(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    starts, ends, _ = _text.spans(data, np.array([0, n]))
    h = _text.hash_spans(data, starts, ends)
    if not len(h):
        return np.zeros(FEATURES)
    values, counts = np.unique(h, return_counts=True)
    letters, digits = _LETTER[data].sum() / n, _DIGIT[data].sum() / n
    signs = 1 - letters - digits - len(starts) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = np.isin(values, _stop_hashes())
    return np.array([
        1.0, math.log1p(len(h)) / 10, letters, digits, _UPPER[data].sum() / n * 5, max(0.0, signs) * 5, min(1.0, _END[data].sum() / len(h) * 5),
        min(2.0, (ends - starts).mean() / 10), len(values) / len(h), counts.max() / len(h), counts[common].sum() / len(h), 1 - len(set(lines)) / len(lines),
    ])


_stops: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _stops:
        _stops.append(_text.words(pa.array(_STOPS))[0])
    return _stops[0]


@dataclass
class QualityModel:
    weights: list[float]
    base: float

    def log_odds(self, text: str | None) -> float:
        return float(self.weights[0] + np.dot(self.weights[1:], features(text)))


def fit_quality(rows: list[tuple[str | None, int]], shares: tuple[float, float]) -> QualityModel:
    """A logistic classifier of (text, label) rows; shares: what a row of each label stands for."""
    weight = np.array([shares[label] for _, label in rows])
    good = sum(w for w, (_, label) in zip(weight, rows) if label)
    base = min(max((good + 1) / (weight.sum() + 2), 1e-6), 1 - 1e-6) if len(rows) else 0.5
    if len({label for _, label in rows}) < 2:
        return QualityModel([math.log(base / (1 - base))] + [0.0] * FEATURES, base)
    x = np.array([features(t) for t, _ in rows])
    return QualityModel(_logistic(x, np.array([label for _, label in rows], float), weight, ridge=0.05), base)


def posteriors(scored: DataFrame, base: float) -> tuple[DataFrame, float, float]:
    """((host, path, n, s, hn, hs), a, b): rows and summed evidence of each path and of its host, by grouped aggregation from rows (host,
    path, p, e), e the evidence; and the strengths by which hosts are shrunk toward the base, and paths toward hosts."""
    evidence = F.col("e")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(evidence).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def strength(level: DataFrame, mean: Column) -> float:
        """Prior rows that a site's own rows are weighed against: m(1-m)/v - 1, v the sites' variance beyond sampling."""
        r = level.filter("n >= 2").agg(F.count("*").alias("k"), F.avg(F.pow(F.col("s") / F.col("n") - mean, 2)).alias("v"), F.avg(1 / F.col("n")).alias("e")).first()
        if not r["k"] or r["k"] < 2:
            return 50.0
        noise = base * (1 - base)
        between = max(r["v"] - noise * r["e"], 1e-6)
        return float(min(max(noise / between - 1, 2.0), 1e4))

    a = strength(hosts, F.lit(base))
    host = hosts.select(F.col("host").alias("of"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(host, F.col("host").eqNullSafe(F.col("of"))).select("host", "path", "n", "s", "hn", "hs")
    return both, a, strength(both, (F.col("hs") + a * base) / (F.col("hn") + a))


def left_out(base: float, a: float, b: float) -> Column:
    """The posterior of a row's path without the row itself, so that no label is used to score its own row."""
    host = (F.col("hs") - F.col("e") + a * base) / (F.col("hn") - 1 + a)
    return (F.col("s") - F.col("e") + b * host) / (F.col("n") - 1 + b)


def quality(df: DataFrame, labels: DataFrame, host: Column, path: Column, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, most: int = 3000, site_weight: float = 0.5) -> DataFrame:
    """(id, doc_score, site_prior, score, kept) of every row.

    doc_score is the classifier's probability, score combines it with the posterior of the row's path; kept: score >= threshold. The
    classifier learns from at most ``most`` rows of each label. Null hosts and paths form sites of their own; null and empty texts
    have no features and the classifier's intercept; null ids and repeated rows stay; an empty table gives no rows; without labels
    every score is one half and every row is kept.
    """
    known = labels if train is None else labels.filter(train)
    model = fit_quality(*labelled_sample(df, known, id_col, text_col, label_col, most))
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    data = df.select(F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            odds = np.array([m.log_odds(t.as_py()) for t in b.column(3)], float)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], ["id", "host", "path", "p"])

    scored = Scratch(df.sparkSession, "quality").keep(data.mapInArrow(run, "id long, host string, path string, p double"))
    truth = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    scored = scored.join(truth, "id", "left").withColumn("e", F.coalesce(F.col("label").cast("double"), F.col("p")))
    sites, a, b = posteriors(scored, model.base)
    joined = scored.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    logit = lambda c: F.log(c / (1 - c))
    prior = F.least(F.greatest(left_out(model.base, a, b), F.lit(1e-6)), F.lit(1 - 1e-6))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    score = 1 / (1 + F.exp(-(logit(p) + site_weight * (logit(prior) - math.log(model.base / (1 - model.base))))))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("doc_score"), prior.alias("site_prior"), score.alias("score")).withColumn("kept", F.col("score") >= threshold)
