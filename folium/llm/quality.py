"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled as good; unlabelled web text is any
document.  A small network on statistics of the text minimises the
non-negative unbiased risk (Kiryo et al. 2017)

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the class prior estimated from the labelled rows.  Training takes bounded
samples (at most SAMPLE rows of each kind, a parameter), drawn by chance; every document is scored, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of each kind that training takes.
SAMPLE = 12_000
EPOCHS, BATCH, HIDDEN, RATE, DECAY = 60, 512, 24, 0.01, 1e-4
SEED = 11

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#*$%&@^~_=+<>{}[]\\/", b"\"'()-:;", bytes(range(128, 256))), 1):
    _CLASSES[list(_chars)] = _k
_N_CLASSES = 12


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(N_FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=_N_CLASSES)
    share = counts[counts > 0] / len(data)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = data.split(b"\n")
    distinct = set(words)
    first = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    pairs = len(set(zip(words, words[1:], strict=False)))
    n = len(words)
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    out = [
        *np.sqrt(kinds / len(data)),
        np.log(n),
        lengths.mean(),
        np.log1p(lengths.std()),
        len(distinct) / n**0.75,
        len(distinct) / n,
        pairs / n,
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        ((first >= 65) & (first <= 90)).mean(),
        (_CLASSES[last] == 5).mean(),
        (_CLASSES[last] == 6).mean(),
        ((_CLASSES[last] >= 7) & (_CLASSES[last] <= 9)).mean(),
        np.log1p(line_lengths.mean()),
        len(set(lines)) / len(lines),
        -(share * np.log(share)).sum(),
        n / (1 + kinds[5]),
    ]
    return np.nan_to_num(np.array(out))


N_FEATURES = _N_CLASSES + 16


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w, b, v, c = self.weights
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ w + b) @ v + c, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Network:
    """The network of least non-negative risk, by Adam on batches of both
    kinds.  Where the negative part of a batch falls below 0, the step goes
    against it, as the method asks."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    norm = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = norm(positive), norm(unlabelled)
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        batches = max(1, min(len(u), 12 * BATCH * 4) // BATCH)
        for part_p, part_u in zip(np.array_split(order_p, batches), np.array_split(order_u, batches), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            x = np.concatenate([p[part_p], u[part_u]])
            is_p = np.arange(len(x)) < len(part_p)
            hidden = np.tanh(x @ weights[0] + weights[1])
            g = np.clip(hidden @ weights[2] + weights[3], -30, 30)
            down = 1 / (1 + np.exp(-g))  # d softplus(g) / dg
            loss_minus = np.logaddexp(0, g)
            negative = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
            grad_plus = np.where(is_p, prior * (down - 1) / len(part_p), 0)
            grad_minus = np.where(is_p, -prior * down / len(part_p), down / len(part_u))
            grad = grad_plus + grad_minus if negative >= 0 else -grad_minus
            back = np.outer(grad, weights[2]) * (1 - hidden**2)
            slopes = [x.T @ back + DECAY * weights[0], back.sum(0), hidden.T @ grad + DECAY * weights[2], np.array([grad.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for w, d, (m, v) in zip(weights, slopes, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, weights, prior)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("turn")], names=["x", "turn"])


def _scored(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.score(x), pa.float64())], names=["doc_id", "score"])

    return run


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def _matrix(rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of at most so many rows (text, turn), those of the lowest
    turns among some drawn by chance.  What comes to the driver is of fixed width and number, however
    long the texts are and however often one row is repeated."""
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.rand(SEED) < 1.5 * most / n)  # copies each on its own
    made = rows.mapInArrow(_featurised, "x array<double>, turn bigint").orderBy("turn", "x").limit(most)
    return np.array(made.toArrow().column("x").to_pylist()).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """The classifier of documents and labels (doc_id, quality); only rows
    given here are learnt from."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    prior = min(max((good or 0) / n if n else 0.5, 0.05), 0.95)
    texts = docs.select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("turn"))
    chosen = known.where("quality = 1").select("doc_id").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)
    positive = _matrix(texts.join(F.broadcast(chosen), "doc_id").select("text", "turn"), sample)
    unlabelled = _matrix(texts.select("text", "turn"), sample)
    if not len(positive) or not len(unlabelled):
        return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([np.log(prior / (1 - prior))])], prior)
    return fit(positive, unlabelled, prior)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of docs.

    Labels are learnt from rows only whose crc32 of the id modulo folds isn't
    held_out; id, language and source are no inputs of a score.

    Defined results: null and empty texts, and those of white space, get the
    score of all statistics 0; without labelled positives or documents the
    score is the prior; a document labelled twice counts as good if one label
    says so; repeated rows give repeated results; a null id is no label's; an
    empty table gives no rows; other columns are not looked at."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    learn = remainder(F.col("doc_id"), folds) != held_out
    network = train(docs.where(learn), labels.where(learn), sample)
    scored = docs.mapInArrow(_scored(network), "doc_id bigint, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
