"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, sole

BUCKETS = 1 << 22
#: Prefixes of a word that are features besides the word.
PREFIXES = (3, 4, 5, 6, 7)
#: A word or prefix found this often in a text, or oftener, is a feature of its own for each number.
OFTEN = (1,)
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_/\\~`^+=@…«»“”‘’¿¡"


def _buckets(word: str) -> tuple[int, ...]:
    bare = word.strip(_EDGES)
    kinds = {bare, *(bare[:n] + "\x00" for n in PREFIXES if len(bare) > n)} if bare else ()
    return tuple(xxhash.xxh3_64_intdigest(k) % BUCKETS for k in kinds)


class WordFeatures(dict):
    """Feature buckets of a white-space separated, lower-cased word: itself and its prefixes."""

    limit = 150_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = _buckets(word)
        return got


_features = WordFeatures()


def _often(counts: dict[int, int]) -> list[int]:
    return [(b + i * 1_000_003) % BUCKETS for b, n in counts.items() for i, least in enumerate(OFTEN) if n >= least]


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text."""
    counts: dict[int, int] = {}
    features = sole(_features)
    for w, n in Counter((text or "").lower().split()).items():
        for b in features[w]:
            counts[b] = counts.get(b, 0) + n
    return np.unique(np.array(_often(counts), np.uint32))


@dataclass(frozen=True)
class PUConfig:
    #: About how many confirmed toxic and how many unlabelled documents the classifier is fitted on.
    positives: int = 3000
    unlabelled: int = 6000
    #: A feature must be more frequent in toxic than in unlabelled text, by a G statistic of at least this
    #: (40 is a chance of less than 1 in a thousand million), in so many toxic documents.
    g: float = 40.0
    least: int = 4
    most_features: int = 2000
    rounds: int = 800
    rate: float = 0.05
    l2: float = 1e-5
    #: Class prior; null: the share of toxic labels among the labelled training rows.
    prior: float | None = None


@dataclass(frozen=True)
class PUModel:
    weights: dict[int, float]
    bias: float
    prior: float

    def score(self, buckets) -> float:
        z = self.bias + sum(self.weights.get(b, 0.0) for b in buckets)
        return float(1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z)))))


def _without_copies(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The first of the sets that agree on one of eight bands of three min-hashes."""
    seeds = mix(np.arange(1, 25, dtype=np.uint64))
    seen: set[tuple] = set()
    kept, blank = [], False
    for x in rows:
        if not len(x):
            kept += [] if blank else [x]
            blank = True
            continue
        low = [int(mix(x.astype(np.uint64) ^ s).min()) for s in seeds]
        bands = [(i, *low[i : i + 3]) for i in range(0, 24, 3)]
        if not any(b in seen for b in bands):
            kept.append(x)
        seen.update(bands)
    return kept


def _g_statistic(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio statistic of a in n against b in m having one rate."""

    def part(k, total, rate):
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return k * np.log(rate) + (total - k) * np.log1p(-rate)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, cfg: PUConfig = PUConfig()) -> PUModel:
    """A linear classifier of the presence of selected features, with logistic loss.

    The risk is ``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``; where the second term is
    negative, a step leads back up (Kiryo et al. 2017). Copies and near copies count once, since they are
    no independent evidence.
    """
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return PUModel({}, start, prior)

    def counted(rows):
        return np.unique(np.concatenate(rows), return_counts=True)

    names, n_p = counted(positive)
    names_u, n_u = counted(unlabelled)
    at = np.minimum(np.searchsorted(names_u, names), len(names_u) - 1)
    u = np.where(names_u[at] == names, n_u[at], 0)
    big_p, big_u = len(positive), len(unlabelled)
    # Unlabelled text holds toxic documents too: what they explain isn't held against a feature.
    u = np.maximum(u - prior * big_u * n_p / big_p, 0.5)
    g = _g_statistic(n_p, big_p, u, big_u) * (n_p / big_p > u / big_u)
    order = np.argsort(-g, kind="stable")[: min(cfg.most_features, int(((g >= cfg.g) & (n_p >= cfg.least)).sum()))]
    chosen = np.sort(names[order])
    if not len(chosen):
        return PUModel({}, start, prior)

    def matrix(rows):
        m = np.zeros((len(rows), len(chosen)), np.float32)
        for line, x in zip(m, rows):
            k = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)
            line[k[chosen[k] == x]] = 1
        return m

    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(chosen), np.float32), np.float32(start)
    moments = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]

    def sigmoid(v):
        return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))

    for t in range(1, cfg.rounds + 1):
        fp, fu = xp @ w + b, xu @ w + b
        sp, su = sigmoid(fp), sigmoid(fu)
        # Derivatives of log(1 + exp(-f)) and log(1 + exp(f)).
        d_pos, d_neg_p, d_neg_u = (sp - 1) / len(fp), sp / len(fp), su / len(fu)
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if rest >= 0:
            gp, gu = prior * d_pos - prior * d_neg_p, d_neg_u
        else:
            gp, gu = prior * d_neg_p, -d_neg_u
        grad = np.append(xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + cfg.l2 * w, gp.sum() + gu.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = cfg.rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return PUModel({int(c): float(v) for c, v in zip(chosen, w)}, float(b), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _share(doc_id: Column, share: float) -> Column:
    """A fixed random share of the ids."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("sample")), F.lit(1_000_003)) < F.lit(int(min(1.0, share) * 1_000_003))


def _feature_rows(docs: DataFrame) -> list[np.ndarray]:
    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([text_features(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["f"])

    # Only the feature sets of the bounded sample come to the driver; ordered, so that a fit can be repeated.
    return [np.frombuffer(r.f, np.uint32) for r in docs.select("text").mapInArrow(run, "f binary").orderBy(F.xxhash64("f")).collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, cfg: PUConfig = PUConfig(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> PUModel:
    """Fit on about ``cfg.positives`` confirmed toxic and ``cfg.unlabelled`` other documents (labels unseen), neither held out."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).filter(~held_out(F.col("i")) & F.col("i").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    toxic = toxic or 0
    prior = cfg.prior if cfg.prior is not None else min(0.5, max(1e-3, toxic / n if n else 0.01))
    source = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).filter(~held_out(F.col("i")))
    chosen = known.filter("y = 1").filter(_share(F.col("i"), cfg.positives / max(1, toxic))).select("i")
    total = docs.count()
    positive = _feature_rows(source.join(F.broadcast(chosen), "i", "left_semi"))  # about cfg.positives ids
    unlabelled = _feature_rows(source.filter(_share(F.col("i"), cfg.unlabelled * 1.5 / max(1, total))))
    return fit_nnpu(positive, unlabelled, prior, cfg)


def score_toxicity(docs: DataFrame, model: PUModel, text: str = "text") -> Column:
    """A column with the score of the whole text, between 0 and 1; null and empty texts get that of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m = shared.value

        class Known(dict):
            """Of a word's buckets, those that can lead to a weight."""

            bases = {(b - i * 1_000_003) % BUCKETS for b in m.weights for i in range(len(OFTEN))}

            def __missing__(self, word):
                if len(self) >= WordFeatures.limit:
                    self.clear()
                got = self[word] = tuple(b for b in _buckets(word) if b in self.bases)
                return got

        global _scored
        if _scored[0] is not m:
            _scored = (m, Known())
        known = sole(_scored[1])
        out = []
        for t in texts:
            counts: dict[int, int] = {}
            for w, n in Counter(t.lower().split()).items() if t else ():
                for b in known[w]:
                    counts[b] = counts.get(b, 0) + n
            out.append(m.score(sorted(set(_often(counts)))))
        return pd.Series(out, dtype="float64")

    return score(F.col(text))


#: The model a worker scored with last, and the features of words that it knows.
_scored: tuple = (None, None)


def toxicity(docs: DataFrame, labels: DataFrame, cfg: PUConfig = PUConfig(), threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of a text without features; repeated rows equal scores. Null
    ids are never learnt from as examples. Without toxic labels, all scores are the prior; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, cfg, doc_id, text, label)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score_toxicity(docs, model, text).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: PUConfig = PUConfig(), threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows that score below ``threshold``, with their columns as they are; no join, no shuffle."""
    model = fit_toxicity(docs, labels, cfg, doc_id, text, label)
    return docs.filter(score_toxicity(docs, model, text) < threshold)
