"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is fitted in numpy from confirmed toxic
texts (positive) and texts whose label is not looked at (unlabelled, a mixture with the
class prior of toxic texts). Its risk is

    prior * mean loss of positives as toxic
    + max(0, mean loss of unlabelled as clean - prior * mean loss of positives as clean)

and where the second term would fall below zero, its gradient is turned round, so that
the classifier does not fit the positives away from the unlabelled.

The fit uses about ``MOST_POSITIVE`` positives and ``MOST_UNLABELLED`` unlabelled texts
where there are more, chosen by hash of the id; the class prior comes from all labelled rows; every text is
scored whole.

Defined results: a null or empty text has no features and gets the score of the bias; with
no positive or no unlabelled row every score is the class prior (0 without labels);
labels that are null or whose text is missing are not used; several labels of one id count
as toxic if one of them is. Repeated rows are answered each and, where the sample takes
their id, all learned from; texts of equal features have equal scores; an empty table gives
an empty one. ``score`` puts its columns in place of columns of the same names (in any case)
and keeps all others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append
from tidemark.llm.hashing import as_bytes, byte_values, mix, prefix_sums, spans_hash, word_spans

MOST_POSITIVE = 6_000
MOST_UNLABELLED = 12_000
BUCKETS = 1 << 18
STEMS = (4, 5, 6)
EPOCHS = 40
BATCHES = 40
RATE = 0.03
SHRINK = 1e-5
THRESHOLD = 0.3
# A bucket is used if at least this share, and this number, of the positives have it, and
# that many times the share of the unlabelled.
LEAST_SHARE = 0.015
LEAST_COUNT = 3
LEAST_LIFT = 3
_WORDS = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and of their first letters, each once."""
    plain = " ".join(_WORDS.findall((text or "").lower())).encode("utf-8", "surrogatepass")
    data = as_bytes(plain)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.int32)
    sums = prefix_sums(byte_values(data))
    parts = [spans_hash(sums, starts, ends)]
    for n in STEMS:
        long = ends - starts >= n
        parts.append(mix(spans_hash(sums, starts[long], starts[long] + n) + np.uint64(n)))
    return np.unique((np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int32))


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(_sigmoid(self.bias + self.weights[features(text)].sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _margins(weights, bias, rows, offsets):
    sums = np.concatenate([[0.0], np.cumsum(weights[rows])])
    return bias + sums[offsets[1:]] - sums[offsets[:-1]]


def _telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Buckets worth a weight: common enough in positives, and more so than elsewhere."""
    in_p, in_u = (np.bincount(np.concatenate(some), minlength=BUCKETS) for some in (positive, unlabelled))
    common = (in_p >= LEAST_COUNT) & (in_p >= LEAST_SHARE * len(positive))
    return common & (in_p * len(unlabelled) >= LEAST_LIFT * (in_u + 1) * len(positive))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> ToxicityModel:
    """Minibatch Adam on the non-negative risk with the logistic loss."""
    if not positive or not unlabelled or not 0 < prior < 1:
        edge = min(max(prior, 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(edge / (1 - edge))))
    chosen = _telling(positive, unlabelled)
    used, place = np.flatnonzero(chosen), np.cumsum(chosen) - 1
    positive, unlabelled = ([place[rows[chosen[rows]]] for rows in some] for some in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    step = 0
    batches = max(1, min(BATCHES, len(positive), len(unlabelled)))
    for _ in range(EPOCHS):
        for some_p, some_u in zip(
            np.array_split(rng.permutation(len(positive)), batches),
            np.array_split(rng.permutation(len(unlabelled)), batches),
            strict=True,
        ):
            grad = np.zeros(len(used) + 1)
            held = []
            for chosen, of in ((some_p, positive), (some_u, unlabelled)):
                texts = [of[i] for i in chosen]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                rows = np.concatenate(texts).astype(np.int64)
                held.append((rows, offsets, _margins(weights, bias, rows, offsets)))
            (rows_p, off_p, at_p), (rows_u, off_u, at_u) = held
            clean = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
            # Slopes of the risk in the margins of either kind.
            as_toxic = -prior * _sigmoid(-at_p) / len(at_p)
            as_clean_p = -prior * _sigmoid(at_p) / len(at_p)
            as_clean_u = _sigmoid(at_u) / len(at_u)
            if clean >= 0:
                slope_p, slope_u = as_toxic + as_clean_p, as_clean_u
            else:
                slope_p, slope_u = -as_clean_p, -as_clean_u
            for rows, offsets, slope in ((rows_p, off_p, slope_p), (rows_u, off_u, slope_u)):
                np.add.at(grad, rows, np.repeat(slope, np.diff(offsets)))
                grad[-1] += slope.sum()
            grad[:-1] += SHRINK * weights
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights -= move[:-1]
            bias -= move[-1]
    spread = np.zeros(BUCKETS, np.float32)
    spread[used] = weights
    return ToxicityModel(spread, float(bias))


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """Features of the rows of docs with about that many of ids (all, if there are fewer).

    The ids are chosen by hash; their number bounds what is broadcast and collected.
    """
    share = min(1.0, most / max(1, ids.count()))
    chosen = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    made = append(texts, "_features binary", lambda: lambda b: [[features(t).tobytes() for t in b.column("text").to_pylist()]])
    return [np.frombuffer(x, np.int32) for x in sorted(made.select("_features").toArrow().column(0).to_pylist())]


def train(docs: DataFrame, labels: DataFrame, use: Column) -> ToxicityModel:
    """Fits on the rows of docs and labels for whose doc_id ``use`` holds."""
    marked = (
        labels.filter(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
    )
    rate = marked.agg(F.avg(F.col("_toxic").cast("double"))).first()[0]
    pool = docs.filter(use).select("doc_id", "text")
    toxic = marked.filter("_toxic = 1").select("doc_id")
    return fit(_sample(pool, toxic, MOST_POSITIVE), _sample(pool, pool.select("doc_id"), MOST_UNLABELLED), rate or 0.0)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds score and predicted to the rows of docs, from their text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = shared.value.score

        def work(batch):
            scores = [of(text) for text in batch.column("text").to_pylist()]
            return [scores, [int(x >= THRESHOLD) for x in scores]]

        return work

    return append(docs.drop("score", "predicted"), "score double, predicted int", make)
