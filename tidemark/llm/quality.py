"""Quality scores by logistic regression over hashed word n-grams, learned with FTRL.

Tokens are runs of letters and digits and runs of marks. Features are word n-grams of two
kinds, hashed into 2^20 buckets: the words themselves (one and two in a row), and their
shapes (one to three in a row), where a mark is its own shape and a word's shape is its
case, whether it has a digit, and whether the three tokens that begin there came before in
the text. A feature's value is its share of the text's n-grams of its kind, so long and
short texts weigh alike and a score is a sparse dot product.

Weights are learned by follow-the-regularised-leader updates (FTRL-proximal): each text in
turn moves the sums z and n of its own buckets, and a weight is worked out from them when
it is used, zero as long as |z| is below the first-order penalty. Such updates follow each
other, so one task makes them over a bounded sample: about ``MOST_PER_LABEL`` labelled
texts of each label, chosen by hash, all if there are fewer. The sample's share of label 1
is put right afterwards by the share among all labelled rows, which moves the bias. Every
text is scored whole.

Defined results: a null or empty text, or one of white space, has no features and gets the
score of the bias. Labels that are null, of a null or unknown id, or whose text is missing
are not used; of several labels of one id the highest counts; repeated rows are learned
from as often as they occur. Where one of the labels is missing every score is the share of
label 1, 0.5 without any label. Texts of equal features have equal scores. ``score`` puts
its columns in place of columns of the same names (in any case) and keeps all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append, map_arrow
from tidemark.llm.hashing import as_bytes, byte_values, mix, prefix_sums, spans_hash

MOST_PER_LABEL = 3_000
BUCKETS = 1 << 20
WORD_GRAMS = (1, 2)
SHAPE_GRAMS = (1, 2, 3)
AGAIN = 3
EPOCHS = 3
# FTRL-proximal: rate, its smoothing, first and second order penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
# Shares are scaled so that a whole kind of n-grams weighs like this many features of value 1.
SCALE = 10.0
THRESHOLD = 0.5
# Kinds of bytes: 0 white space, 1 marks, 2 letters and digits (all beyond ASCII included).
_KIND = np.ones(256, np.int8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
# Counts capitals in the low half and digits in the high one.
_MARKED = np.zeros(256, np.int64)
_MARKED[65:91], _MARKED[48:58] = 1, 1 << 32
_ODD, _HALF, _REST = np.uint64(0x9E3779B97F4A7C15), np.uint64(32), np.uint64(65 - BUCKETS.bit_length())


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = _KIND[data]
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    # Every edge ends a token, begins one, or both.
    starts = edges[kind[edges + 1] > 0]
    ends = edges[kind[edges] > 0]
    return starts, ends


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each token: a mark's hash, or a word's case, digits and repetition."""
    length = ends - starts
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MARKED[data], out=sums[1:])
    both = sums[ends] - sums[starts]
    upper = both & 0xFFFFFFFF
    shape = np.where((upper == length) & (length > 1), 3, np.minimum(upper, 2)) + 8 * (both >> 32 > 0)
    if len(words) > AGAIN:
        # All but the first of equal windows.
        later = np.ones(len(words) - AGAIN + 1, bool)
        later[np.unique(_grams(words, AGAIN), return_index=True)[1]] = False
        shape[: len(later)] += 16 * later
    return np.where(_KIND[data[starts]] == 2, mix(shape.astype(np.uint64)), words)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes, spread over its high bits."""
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = (out ^ (out >> _HALF)) * _ODD + hashes[k : len(hashes) - n + 1 + k]
    return out


def feature_counts(text: str | None) -> list[np.ndarray]:
    """Buckets of every kind of n-gram, one for each occurrence."""
    data = as_bytes((text or "").encode("utf-8", "surrogatepass"))
    starts, ends = _tokens(data)
    if not len(starts):
        return []
    words = spans_hash(prefix_sums(byte_values(data)), starts, ends)
    shapes = _shapes(data, starts, ends, words)
    kinds = [(words, n, 0) for n in WORD_GRAMS] + [(shapes, n, 16) for n in SHAPE_GRAMS]
    grams = [(_grams(of, n) + np.uint64(n + salt)) * _ODD for of, n, salt in kinds if n <= len(of)]
    return [(g >> _REST).astype(np.int32) for g in grams]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values."""
    kinds = feature_counts(text)
    if not kinds:
        return np.empty(0, np.int32), np.empty(0)
    values = np.repeat([SCALE / len(k) for k in kinds], [len(k) for k in kinds])
    buckets, place = np.unique(np.concatenate(kinds), return_inverse=True)
    return buckets, np.bincount(place, values)


@dataclass(frozen=True)
class QualityModel:
    """Weights of all buckets and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        margin = self.bias + sum(SCALE * self.weights[k].sum(dtype=np.float64) / len(k) for k in feature_counts(text))
        return float(_sigmoid(margin))


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader with a rate for each weight; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0.0  # the bias is not penalised

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(buckets, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (_sigmoid(w @ x) - label) * x
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, the weights and the bias, after EPOCHS over rows in shuffled order."""
    model, rng = Ftrl(BUCKETS), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights()
    used = np.flatnonzero(w[:-1])
    return used, w[used], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality") -> QualityModel:
    """Fits on the rows of docs and labels (doc_id and label, 0 or 1) for whose doc_id ``use`` holds."""
    marked = labels.filter(use & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_label"))
    sizes = dict(marked.groupBy("_label").count().collect())
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.5
    nothing = QualityModel(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if len(sizes) < 2:
        return nothing
    keep = {k: min(1.0, MOST_PER_LABEL / n) for k, n in sizes.items()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) / (1 << 30)
    chosen = marked.filter(drawn < F.when(F.col("_label") == 1, keep[1]).otherwise(keep[0]))
    # Bounded by the sample's size.
    sample = docs.filter(use).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")

    def made():
        def work(batch):
            found = [features(t) for t in batch.column("text").to_pylist()]
            return [[b.tobytes() for b, _ in found], [v.astype(np.float32).tobytes() for _, v in found]]

        return work

    def learn(batches):
        rows = []
        for batch in batches:
            for b, v, y in zip(*(batch.column(c).to_pylist() for c in ("_buckets", "_values", "_label")), strict=True):
                rows.append((np.frombuffer(b, np.int32), np.frombuffer(v, np.float32).astype(np.float64), y))
        ones = sum(r[2] for r in rows)
        used, weights, bias = fit(rows) if 0 < ones < len(rows) else (np.empty(0, np.int32), np.empty(0), None)
        yield pa.RecordBatch.from_pydict(
            {
                "used": pa.array([used.tolist()], pa.list_(pa.int32())),
                "weights": pa.array([weights.tolist()], pa.list_(pa.float64())),
                "bias": pa.array([bias], pa.float64()),
                "odds": pa.array([ones / (len(rows) - ones) if bias is not None else None], pa.float64()),
            }
        )

    # Features are made in parallel; the updates follow each other in one task, in a fixed order.
    ready = append(sample.withColumn("_order", F.xxhash64("doc_id", "text")), "_buckets binary, _values binary", made)
    ready = ready.select("_order", "_label", "_buckets", "_values").repartition(1).sortWithinPartitions("_order", "_label")
    found = map_arrow(ready, learn, "used array<int>, weights array<double>, bias double, odds double").first()
    if found is None or found["bias"] is None:
        return nothing
    weights = np.zeros(BUCKETS, np.float32)
    weights[np.array(found["used"], np.int64)] = found["weights"]
    return QualityModel(weights, found["bias"] + float(np.log(share / (1 - share) / found["odds"])))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Adds score and predicted to the rows of docs, from their text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = shared.value.score

        def work(batch):
            scores = [of(text) for text in batch.column("text").to_pylist()]
            return [scores, [int(x >= THRESHOLD) for x in scores]]

        return work

    clash = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    return append(docs.drop(*clash), "score double, predicted int", make)
