"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled web
text. A small network over statistics of the whole text is fitted by minimising
the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss. The class prior is estimated from positives and
unlabelled rows alone: a network that tells the two apart is fitted on one half
of them, and on the other half the prior is the least ratio of the shares of
unlabelled and of positive rows above a threshold, each ratio with a margin for
its sample's size ("best bin estimation"). Labels 0 are never used. The fit uses
bounded, documented samples; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_text

#: Most positives and most unlabelled rows that the fit takes (those with the smallest id hashes).
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: The fold of crc32(id as text) mod 4 that is never learnt from.
FOLDS, HELD_OUT = 4, 2
HIDDEN, STEPS, PRIOR_STEPS, BATCH, RATE, DECAY = 24, 1500, 300, 2048, 0.01, 1e-4

#: Chance that the margin of the prior's estimate is too small, and how much of it is added in the choice of a threshold.
DELTA, MARGIN = 0.1, 1.01

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(r"\S+")
_NOISE = re.compile(r"[^\w\s.,;:'\"()?-]")
_DIGIT = re.compile(r"\d")
_TAIL = re.compile(r"\S[^\w\s.,;:'\")?]+(?=\s|$)")


def features(text: str) -> list[float]:
    """Statistics of a whole text that do not grow with its length, but for two log sizes."""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [0.0] * WIDTH
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = Counter(words)
    letters = sum(map(str.isalpha, words))
    upper = len(_UPPER.findall(text))
    lower_words = sum(map(str.islower, words))
    upper_words = sum(map(str.isupper, words))
    noise = _NOISE.findall(text)
    marks = Counter(noise)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    spaced = n - sum(map(len, words))
    alone = sum(len(x) == 1 and not x.isalnum() for x in words)
    top = [c for _, c in kinds.most_common(3)] + [0, 0]
    return [
        np.log1p(w),
        np.log1p(n),
        upper / n,
        upper_words / w,
        lower_words / w,
        letters / w,
        len(noise) / n,
        len(noise) / w,
        max(marks.values(), default=0) / w,
        len(_TAIL.findall(text)) / w,
        repeats / w,
        len(kinds) / w,
        np.log(len(kinds)) / np.log(w + 1),
        top[0] / w,
        (top[0] + top[1] + top[2]) / w,
        alone / w,
        spaced / w,
        (n - spaced) / w,
        len(_DIGIT.findall(text)) / n,
        len(set(lines)) / len(lines),
        len(lines) / w,
        text.count(".") / w,
        text.count(",") / w,
        text.count("|") / w,
        text.count("!") / w,
        1.0,
    ]


WIDTH = 26


class Network:
    """Standardised inputs, one hidden layer, one logit."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x):
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _trained(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> Network:
    """Logistic loss, Adam. With a prior the non-negative PU risk, whose bracket is climbed instead of followed where it
    is negative; without one, positives are told from unlabelled rows."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    std = lambda x: np.clip((x - mean) / scale, -6, 6)
    p, u = std(positive), std(unlabelled)
    d = p.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    net = Network(mean, scale, weights)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    steps = STEPS if prior is not None else PRIOR_STEPS
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        hp, hu = net.hidden(xp), net.hidden(xu)
        zp, zu = hp @ weights[2] + weights[3], hu @ weights[2] + weights[3]
        if prior is None:
            gp, gu = -sigmoid(-zp) / BATCH, sigmoid(zu) / BATCH
        else:
            bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            sign = 1.0 if bracket >= 0 else -1.0
            gp = prior * (-sigmoid(-zp) * (sign > 0) - sign * sigmoid(zp)) / BATCH
            gu = sign * sigmoid(zu) / BATCH
        x, h, g = np.vstack([xp, xu]), np.vstack([hp, hu]), np.r_[gp, gu]
        back = np.outer(g, weights[2]) * (1 - h * h)
        rate = RATE * (1 - step / (steps + 1))
        for k, grad in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum())):
            grad = grad + DECAY * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives among unlabelled rows, from these two samples alone."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    net = _trained(positive[::2], unlabelled[::2], None, seed)
    p, u = np.sort(net.logits(positive[1::2])), np.sort(net.logits(unlabelled[1::2]))
    cuts = np.unique(np.r_[p, u])
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    cuts = above_p > 0
    above_p, above_u = above_p[cuts], above_u[cuts]
    margin = sum((np.log(4 / DELTA) / (2 * len(x))) ** 0.5 for x in (p, u))
    best = int(np.argmin((above_u + MARGIN * margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 7) -> Network:
    """The network of least non-negative PU risk; the prior is estimated where none is given."""
    return _trained(positive, unlabelled, class_prior(positive, unlabelled, seed) if prior is None else prior, seed)


def held_out_fold(id_col: str):
    """Whether a row is held out: crc32 of the id as text leaves ``HELD_OUT`` modulo ``FOLDS``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> Network | None:
    """The network, fitted on at most ``fit_rows`` positives and as many unlabelled rows (those with the smallest id hashes)."""
    learnt = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("quality").alias("q")).where("id is not null and q is not null")
    learnt = learnt.where(~held_out_fold("id")).groupBy("id").agg(F.min("q").alias("q"))
    learnt = learnt.where("q > 0")
    some = lambda df: df.select("id").orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    source = keyed_text(docs, id_col, text_col)
    chosen = some(learnt).withColumn("p", F.lit(True)).union(some(source.where("id is not null").select("id").distinct()).withColumn("p", F.lit(False)))
    chosen = chosen.groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("only_p"))  # at most 2 * fit_rows ids: the bound of the broadcast
    kind = docs.schema[id_col].dataType.simpleString()
    picked = source.join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["id", "p", "only_p", "x"])

    made = picked.select("id", "text", "p", "only_p").mapInArrow(run, f"id {kind}, p boolean, only_p boolean, x array<double>")
    # rows that share an id are one row of the fit, so that it stays within its bound
    table = made.groupBy("id", "p", "only_p").agg(F.min("x").alias("x")).toArrow().sort_by("id")
    if not table.num_rows:
        return None
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    p, only = (table.column(c).to_numpy().astype(bool) for c in ("p", "only_p"))
    return fit(x[p], x[~only]) if p.any() and (~only).any() else None


def _scores(net: Network | None, texts: list[str]) -> np.ndarray:
    if net is None or not texts:
        return np.full(len(texts), 0.5)
    return net.scores(np.array([features(t) for t in texts], np.float64).reshape(-1, WIDTH))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score (0 to 1), predicted (score >= ``threshold``).

    Only labels outside the held-out fold are learnt from; of several labels of
    one document the lowest counts, and null labels are no labels. At most
    ``fit_rows`` positives and as many unlabelled documents enter the fit; rows
    that share an id enter it as one, the one with the least statistics.
    Without any learnable positive every score is 0.5. Null texts score like
    empty ones; repeated rows are kept; other columns are ignored; an empty
    table gives an empty result.
    """
    net = _fit_on(docs, labels, id_col, text_col, fit_rows)
    source = keyed_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(net, batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    scored = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out_fold("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they are; where nothing can be learnt, all rows."""
    net = _fit_on(docs, labels, id_col, text_col, fit_rows)
    if net is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(_scores(net, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
