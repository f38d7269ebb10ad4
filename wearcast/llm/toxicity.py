"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled texts, spell each word
byte by byte, every byte given the ``ORDER - 1`` bytes before it in the word
and the word's end given its last bytes. Both share all lower orders:
continuation counts (after how many different bytes a string occurs), pooled
over both classes. A rare expression thus backs off to the same figure in both
models and says little, while the stem of a family of rare words counts even
in a form never seen. A text's score compares the two log-likelihoods,
normalised by the number of words, in two ways: the mean difference over all
words, and the mean of what single words exceed ``MARGIN`` by (small
differences of many words reflect the topic or language, large ones of few
words an expression). A logistic curve over both, fitted on labelled texts that
the models have not seen, gives the probability.

Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased. Where
neither class knows a string, the shared part is equal on both sides and drops
out of the difference, so a model is two sorted tables of differences.

Scale: only a bounded sample of labelled rows is learned from (``SAMPLE_ROWS``
rows a class, those with the smallest hashes of their ids), so the counts fit
the driver and the model can be broadcast; ``max_model_bytes`` checks it.
Counting and scoring run distributed, scoring without any shuffle.

Defined cases: null text is the empty text; a text without words gets the
curve's value at differences of 0; labels that are null are left out, repeated
labels of one id count once (the highest wins); with labels of one class only
the score is 1.0 or 0.0 throughout, without labels 0.0; repeated documents are
scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.packs import join_text, split_text
from wearcast.llm.words import PUNCTUATION, Tokens, slices

SLICE_BYTES = 512 << 10  # of text at a time: its strings take some hundred bytes a byte
SAMPLE_ROWS = 4000
MAX_MODEL_BYTES = 256 << 20
ORDER = 5  # bytes in a string, the predicted one included; at most 8
DISCOUNT = 0.75
MARGIN = 2.0  # nats
CALIBRATION_SHARE = 4  # every so many-th sample row fits the curve


class Spelled:
    """The distinct words of a column as byte strings of one order, oldest byte lowest; 0x20 ends a word, 0 is before it."""

    def __init__(self, column: pa.Array, order: int):
        t = Tokens(column, lower=True, between=PUNCTUATION)
        self.bounds = t.bounds
        _, first, self.word = np.unique(t.hashes(), return_index=True, return_inverse=True)
        start, size = t.starts[first], t.ends[first] - t.starts[first] + 1  # with the end
        self.begin = np.cumsum(size) - size
        self.of = np.repeat(np.arange(len(first)), size)
        offset = np.arange(size.sum()) - np.repeat(self.begin, size)
        at = np.repeat(start, size) + offset
        data = np.concatenate([np.zeros(order - 1, np.uint8), t.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
        gram = lanes[at] & np.uint64((1 << 8 * (order - 1)) - 1)  # the order - 1 bytes before
        newest = np.where(offset == np.repeat(size, size) - 1, np.uint8(0x20), data[at + order - 1]).astype(np.uint64)
        outside = (np.maximum(order - 1 - offset, 0) * 8).astype(np.uint64)  # bits before the word's first byte
        self.grams = (gram >> outside << outside) | newest << np.uint64(8 * (order - 1))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _contexts(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * (order - 1)) - 1)


@dataclass
class Model:
    """Differences log p(toxic) - log p(ordinary) of known strings, and of any other string after a known context."""

    order: int
    grams: np.ndarray
    known: np.ndarray
    contexts: np.ndarray
    other: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of both differences and of 1

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.grams, self.known, self.contexts, self.other))

    def differences(self, column: pa.Array) -> np.ndarray:
        """[row, 2]: mean difference of a row's words, mean excess over the margin; 0 for a row without words."""
        s = Spelled(column, self.order)
        if not len(s.grams):
            return np.zeros((len(column), 2))
        at = _find(self.grams, s.grams)
        x = np.zeros(len(at))
        x[at >= 0] = self.known[at[at >= 0]]
        todo = np.flatnonzero(at < 0)
        at = _find(self.contexts, _contexts(s.grams[todo], self.order))
        x[todo[at >= 0]] = self.other[at[at >= 0]]
        word = np.add.reduceat(x, s.begin)
        both = np.stack([word, np.maximum(word - MARGIN, 0)], 1)[s.word]
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(both, 0)])
        return (total[s.bounds[1:]] - total[s.bounds[:-1]]) / np.maximum(np.diff(s.bounds), 1)[:, None]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.differences(column) @ self.weights[:2] + self.weights[2], -50, 50)))


def count_rows(column: pa.Array, label: np.ndarray, order: int) -> pa.RecordBatch:
    """Counts of the strings in labelled rows: gram, class, n."""
    s = Spelled(column, order)
    out = []
    for k in (0, 1):
        own = np.repeat(label == k, np.diff(s.bounds))
        times = np.bincount(s.word[own], minlength=len(s.begin))[s.of]
        grams, at = np.unique(s.grams[times > 0], return_inverse=True)
        out.append((grams, np.full(len(grams), k, np.int8), np.bincount(at, times[times > 0], len(grams)).astype(np.int64)))
    gram, cls, n = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch([pa.array(gram.view(np.int64)), pa.array(cls), pa.array(n)], ["gram", "class", "n"])


def shared_part(keys: np.ndarray, order: int, discount: float) -> np.ndarray:
    """Kneser-Ney probability of each sorted distinct key's newest byte after one byte less, by continuation counts."""
    if order == 1:
        return np.full(len(keys), 1 / 256)
    shorter, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    follows = np.bincount(at).astype(float)  # different oldest bytes
    _, group = np.unique(_contexts(shorter, order - 1), return_inverse=True)
    total, kinds = np.bincount(group, follows)[group], np.bincount(group)[group]
    p = (np.maximum(follows - discount, 0) + discount * kinds * shared_part(shorter, order - 1, discount)) / total
    return p[at]


def estimate(counts: pa.Table, order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The two models' differences from summed counts."""
    gram, cls, n = (counts.column(c).to_numpy() for c in ("gram", "class", "n"))
    keys, at = np.unique(gram.view(np.uint64), return_inverse=True)
    c = np.stack([np.bincount(at[cls == k], n[cls == k], len(keys)) for k in (0, 1)], 1)
    contexts, group = np.unique(_contexts(keys, order), return_inverse=True)
    total = np.stack([np.bincount(group, c[:, k], len(contexts)) for k in (0, 1)], 1)
    kinds = np.stack([np.bincount(group, c[:, k] > 0, len(contexts)) for k in (0, 1)], 1)
    back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    lower = shared_part(keys, order, discount)
    p = np.maximum(c - discount, 0) / np.maximum(total[group], 1) + back[group] * lower[:, None]
    return Model(order, keys, np.log(p[:, 1] / p[:, 0]).astype(np.float32), contexts, np.log(back[:, 1] / back[:, 0]).astype(np.float32))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic curve over the columns of x and 1, by Newton's method with a slight pull towards 0."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    scale = np.append(np.where(x.std(0) > 0, x.std(0), 1.0), 1.0)
    a = np.column_stack([x, np.ones(len(x))]) / scale
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, fits_curve) of at most ``rows`` labelled documents a class; labelled ids by class."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spot = F.xxhash64("doc_id")
    picked = None
    for k in sizes:  # orderBy + limit keeps the smallest of each task only
        one = own.filter(F.col("toxic") == k).withColumn("spot", spot).orderBy("spot", "doc_id").limit(rows)
        picked = one if picked is None else picked.union(one)
    if picked is None:
        picked = own.withColumn("spot", spot)
    picked = picked.withColumn("fits_curve", F.pmod(F.shiftright("spot", 7), F.lit(CALIBRATION_SHARE)) == 0).drop("spot")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic", "fits_curve"), sizes  # at most 2 x rows ids


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER,
        max_model_bytes: int = MAX_MODEL_BYTES) -> Model | float:
    """The fitted model, or a constant score if the labels show fewer than two classes."""
    chosen, sizes = sample(docs, labels, rows)
    if len(sizes) < 2:
        return float(max(sizes, default=0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                yield count_rows(part.column(0), part.column(1).to_numpy(zero_copy_only=False), order)

    counted = chosen.filter("not fits_curve").select("text", "toxic").mapInArrow(count, "gram long, class byte, n long")
    model = estimate(counted.groupBy("gram", "class").agg(F.sum("n").alias("n")).toArrow(), order)
    if model.nbytes() > max_model_bytes:
        raise ValueError(f"the model takes {model.nbytes()} bytes, more than {max_model_bytes}; lower the number of sample rows")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                x = sent.value.differences(part.column(0))
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), part.column(1)], ["mean", "excess", "toxic"])

    # at most 2 x rows numbers; ordered, so that the fit does not depend on the order of tasks
    seen = chosen.filter("fits_curve").select("text", "toxic").mapInArrow(compare, "mean double, excess double, toxic int").toArrow()
    mean, excess, y = (seen.column(c).to_numpy().astype(float) for c in ("mean", "excess", "toxic"))
    order_of = np.lexsort((y, excess, mean))
    x, y = np.stack([mean, excess], 1)[order_of], y[order_of]
    weight = np.ones(len(y))
    for k in (0, 1):  # the classes count as they occur among all labelled rows
        weight[y == k] = sizes[k] / sum(sizes.values()) * len(y) / max(1, (y == k).sum())
    model.weights = fit_curve(x, y, weight)
    return model


def score(docs: DataFrame, model: Model | float, carry: str = "doc_id") -> DataFrame:
    """The carried column and ``score``, 0 to 1, of every row's whole text."""
    own = docs.select(F.col(carry), F.col("text").cast("string").alias("text"))
    if isinstance(model, float):
        return own.select(carry, F.lit(model).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                yield pa.record_batch([part.column(0), pa.array(sent.value.probabilities(part.column(1)))], [carry, "score"])

    return own.mapInArrow(run, f"{carry} {own.schema[carry].dataType.simpleString()}, score double")


def remove_toxic(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns; a text travels once, beside its row."""
    if isinstance(model, float):
        return docs if model < threshold else docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = split_text(docs).select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                yield part.filter(pa.array(sent.value.probabilities(part.column("text")) < threshold))

    return join_text(rows.mapInArrow(run, rows.schema), docs)
