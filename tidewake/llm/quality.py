"""Quality by positive-unlabelled learning with the non-negative risk.

Texts become a few shares and counts (marks, capitals, repeated words, ...) computed once per text
in Arrow batches.  Trusted positives and unlabelled texts, each a bounded sample by hash, train a
small network on the non-negative unbiased risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the logistic loss, so that its output is a probability.  The class prior is estimated first:
the least ratio of unlabelled to positive texts above a threshold of a first model's score, on
rows that model has not seen, with a margin for the sample's size (best-bin estimation).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm import textcore

#: Bounds of the samples the model is fitted on, unless fit() is given others.
POSITIVES = 6000
UNLABELLED = 12000
HIDDEN = 12
EPOCHS = 400

FEATURES = (
    "log_words", "log_bytes_per_word", "upper_share", "digit_share", "end_mark_share", "bang_share", "symbol_share", "bar_share",
    "other_mark_share", "high_byte_share", "space_share", "line_share", "repeat_share", "distinct_share", "top_word_share", "longest_repeat",
    "worst_block_marks", "worst_block_repeats",
)
_CLASS = np.zeros(256, np.int64)
for _bytes, _kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (".,;:?'\"()-", 3), ("!", 4), ("*#$%&@^~=+_<>\\/", 5), ("|", 6), ("[]{}`", 7), (" \t", 9), ("\n\r\x0b\x0c", 10)):
    _CLASS[[ord(c) for c in _bytes]] = _kind
_CLASS[128:] = 8
BLOCK = 32


def features(data: np.ndarray) -> np.ndarray:
    """The values FEATURES names of one text's bytes; an empty text has zeros."""
    out = np.zeros(len(FEATURES))
    if not len(data):
        return out
    count = np.zeros(11)
    for a in range(0, len(data), textcore.SEGMENT):
        count += np.bincount(_CLASS[data[a : a + textcore.SEGMENT]], minlength=11)
    words = textcore.word_hashes(data)
    n = len(words)
    share = count / len(data)
    out[0] = np.log1p(n)
    out[1] = np.log((len(data) - count[9] - count[10] + 1) / (n + 1))
    out[2:12] = share[1:11]
    if n:
        same = words[1:] == words[:-1]
        _, times = np.unique(words, return_counts=True)
        out[12] = same.sum() / n
        out[13] = len(times) / n
        out[14] = times.max() / n
        if same.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
            out[15] = np.log1p((edges[1::2] - edges[::2]).max())
            blocks = np.add.reduceat(same, np.arange(0, len(same), BLOCK))
            out[17] = blocks.max() / BLOCK
        marks = np.isin(_CLASS[data], (4, 5, 6))
        if marks.any():
            step = max(1, BLOCK * len(data) // n)
            out[16] = np.add.reduceat(marks, np.arange(0, len(data), step)).max() / step
    return out


def feature_table(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep's columns and ``features``, an array in the order of FEATURES, of every whole text.

    Null and empty texts have zeros; null keys and repeated rows stay, one row each; very long texts
    are read whole; other columns do not matter, whatever their names; an empty table gives an empty one.
    """
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([slim.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in textcore.text_bytes(batch.column(len(keep)))]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], values], [*keep, "features"])

    return slim.mapInArrow(textcore.lean(compute), schema)


@dataclass
class Network:
    """A hidden layer of tanh units over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Minimise the non-negative risk at a prior; with none, plain logistic loss of positive against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    x = net.inputs(both)
    pos = np.arange(len(both)) < len(positive)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ params[0] + params[1])
        f = hidden @ params[2] + params[3][0]
        s = _sigmoid(f)
        # Derivatives of l(f) = log(1 + exp(-f)) and of l(-f).
        up, down = s - 1, s
        grad = np.zeros(len(f))
        if prior is None:
            grad[pos], grad[~pos] = up[pos] / pos.sum(), down[~pos] / (~pos).sum()
        else:
            loss_down = np.logaddexp(0, f)
            rest = loss_down[~pos].mean() - prior * loss_down[pos].mean()
            sign = 1.0 if rest >= 0 else -1.0  # below zero: step back from over-fitted negatives
            grad[pos] = (prior * up[pos] if sign > 0 else 0) - sign * prior * down[pos]
            grad[pos] /= pos.sum()
            grad[~pos] = sign * down[~pos] / (~pos).sum()
        back = grad[:, None] * params[2] * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ grad + 1e-4 * params[2], np.array([grad.sum()])]
        rate = 0.03 * (1 - 0.9 * epoch / EPOCHS)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    net.b2 = float(params[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> float:
    """The share of positives among the unlabelled, by the best bin of a held-back half's scores."""
    rng = np.random.default_rng(seed)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    if min(half_p, half_u) < 10:
        return 0.5
    net = train_network(positive[:half_p], unlabelled[:half_u], None)
    p, u = np.sort(net.value(positive[half_p:])), np.sort(net.value(unlabelled[half_u:]))
    cuts = np.quantile(p, np.linspace(0, 0.99, 100))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + margin) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def hashed_sample(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About ``most`` rows, all where there are fewer, chosen by a hash of their key: no sort, nothing gathered."""
    total = rows.count()
    share = min(1.0, most / max(1, total))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))


def _matrix(rows: DataFrame, key: str) -> np.ndarray:
    found = rows.select(F.col(key).cast("string").alias("k"), "features").toArrow().sort_by("k")
    return found.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(table: DataFrame, positives: DataFrame, key: str = "doc_id", trusted_most: int = POSITIVES, unlabelled_most: int = UNLABELLED) -> tuple[Network | None, float]:
    """The network and the prior, from a feature table and the keys of trusted positives.

    About ``trusted_most`` trusted and ``unlabelled_most`` of all rows are fitted on, chosen by hash of
    their key; rows without a key are left out, of rows with the same key one is trusted.  Without
    positives, or with an empty table, there is no network.  Columns beyond key and features do not matter.
    """
    known = hashed_sample(positives.select(key).filter(F.col(key).isNotNull()).distinct(), key, trusted_most, "t")
    keyed = table.select(key, "features").filter(F.col(key).isNotNull())
    p = _matrix(keyed.join(F.broadcast(known), key, "left_semi").dropDuplicates([key]), key)
    u = _matrix(hashed_sample(keyed, key, unlabelled_most, "u"), key)
    if len(p) < 2 or len(u) < 2:
        return None, 0.5
    prior = estimate_prior(p, u)
    return train_network(p, u, prior), prior


def score_table(table: DataFrame, net: Network | None, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns and ``score`` (0..1, higher: positive likelier); without a network 0.5.

    One row each, null keys and repeats too; an empty table gives an empty one.
    """
    schema = T.StructType([table.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            found = _sigmoid(net.value(x)) if net is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.float64())], [*keep, "score"])

    return table.select(*keep, "features").mapInArrow(score, schema)
