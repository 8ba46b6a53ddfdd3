"""Quality classifier: a linear support vector machine on n-grams scaled by naive Bayes ratios.

Features are the distinct byte n-grams (1 to 4 bytes) of a text, its distinct word n-grams (1 and 2 words) and whether it
has n-grams of one repeated word, hashed into FEATURES indicators. Each indicator is scaled by the log-count ratio of its feature between good and bad texts; on the
scaled, length-normalised vectors a hinge-loss model is fitted by dual coordinate descent. Scores become probabilities by a
logistic fit on part of the sample that the model has not seen.

The model is fitted on a bounded sample: the SAMPLE_ROWS labelled rows with the smallest hash of their doc_id (all of
them, if there are fewer). It is one vector of FEATURES weights, so the scoring of all whole texts is one pass without a
shuffle. Labels of the held-out fold (crc32 of the doc_id as text, modulo 5, is 0) are never read; label, language,
source and doc_id are no features.

Defined cases: NULL texts count as empty; an empty text scores as the model's intercept says; missing labels, labels
without text and labels that are not 0 or 1 are left out; of several labels of one doc_id the larger counts; without
any label of one class every text scores the share of label 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.llm.common import small_batches, stored, text_or_empty, unused
from tsforge.llm.words import mix, word_hashes, words

FEATURES = 1 << 18
SAMPLE_ROWS = 6_000
CALIBRATION_PART = 5  # one of so many sample rows is kept for the logistic fit
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12
CUT = 0.3
FOLDS = 5
CHUNK = 1 << 16
#: Lengths of n-grams that repeat one word.
SAME_WORD = (3, 4, 6, 8)


def features(text: str | None, size: int = FEATURES) -> np.ndarray:
    """Sorted numbers of the features that the text has."""
    flags = np.zeros(size, bool)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint32(32 - int(size).bit_length() + 1)
    for n in range(1, 5):
        for at in range(0, len(raw) - n + 1, CHUNK):  # bounded pieces, overlapping by n - 1 bytes
            part = raw[at : at + CHUNK + n - 1].astype(np.uint32)
            m = len(part) - n + 1
            code = part[:m].copy()
            for i in range(1, n):
                code = (code << np.uint32(8)) | part[i : i + m]
            code = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA6B)
            flags[code >> shift] = True
    found = words(text)
    if found:
        one = word_hashes().of(found)
        mask = np.uint64(size - 1)
        flags[(one & mask).astype(np.int64)] = True
        two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        flags[(two & mask).astype(np.int64)] = True
        # An n-gram of one word over and over, whatever the word: one feature per length.
        same = np.concatenate(([0], np.flatnonzero(one[1:] != one[:-1]) + 1, [len(one)]))
        longest = int(np.diff(same).max())
        for n in SAME_WORD:
            if longest >= n:
                flags[int(mix(np.array([n], np.uint64))[0] & mask)] = True
    return np.flatnonzero(flags).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int = FEATURES) -> np.ndarray:
    good = np.full(size, SMOOTHING)
    bad = np.full(size, SMOOTHING)
    for row, label in zip(rows, labels):
        (good if label else bad)[row] += 1
    return np.log((good / good.sum()) / (bad / bad.sum()))


def _values(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[row]
    norm = math.sqrt(float(x @ x))
    return (x / norm if norm else x).astype(np.float32)


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int = FEATURES,
    penalty: float = PENALTY, epochs: int = EPOCHS,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model; classes weigh alike in the loss."""
    signs = np.where(labels > 0, 1.0, -1.0)
    share = labels.mean()
    most = np.where(labels > 0, penalty / (2 * share), penalty / (2 * (1 - share)))
    weights, bias = np.zeros(size), 0.0
    duals = np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1.0 for v in values])  # the intercept is a feature of value 1
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(duals[i] - gradient / squares[i], 0.0), most[i])
            step = new - duals[i]
            if step:
                duals[i] = new
                weights[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * margin + b))) fits the labels; smoothed targets, Newton steps."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()
        haa, hab, hbb = (w * margins**2).sum() + 1e-3, (w * margins).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = FEATURES) -> tuple[np.ndarray, float, float, float]:
    """Log-count ratios, weights and intercept; the last two are scaled so that the margin is a log-odds."""
    part = np.arange(len(rows)) % CALIBRATION_PART == 0
    if len(set(labels[part])) < 2 or len(set(labels[~part])) < 2:
        part = np.zeros(len(rows), bool)
    learn = [r for r, p in zip(rows, part) if not p]
    ratios = log_count_ratios(learn, labels[~part], size)
    weights, bias = dual_coordinate_descent(learn, [_values(r, ratios) for r in learn], labels[~part], size)
    check = [r for r, p in zip(rows, part) if p] or learn
    margins = np.array([float(weights[r] @ _values(r, ratios)) + bias for r in check])
    a, b = logistic(margins, labels[part] if part.any() else labels)
    return ratios, a * weights, a * bias + b


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())],
                                         ["order", "label", "row"])


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded sample, in one task and one order -> the model."""
    taken = [x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    taken.sort()
    labels = np.array([x[1] for x in taken], np.int64)
    ratios, weights, bias = np.zeros(FEATURES), np.zeros(FEATURES), 0.0
    if len(set(labels.tolist())) == 2:
        ratios, weights, bias = fit([np.frombuffer(x[2], np.int32) for x in taken], labels)
    elif len(labels):
        bias = 40.0 if labels[0] else -40.0
    parts = (ratios.astype("<f4").tobytes(), weights.astype("<f4").tobytes())
    yield pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.binary()) for x in parts), pa.array([float(bias)])], ["ratios", "weights", "bias"]
    )


def held_out() -> Column:
    """Of the held-out fold; rows without doc_id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows: int = SAMPLE_ROWS) -> dict:
    """The model, from at most `rows` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    given = given.groupBy("doc_id").agg(F.max(label).cast("long").alias("label"))
    sample = given.withColumn("order", F.xxhash64(F.col("doc_id").cast("long"))).orderBy("order", "doc_id").limit(rows)
    sample = stored(sample, "labelled-sample")
    # At most `rows` narrow rows: small by definition.
    texts = docs.select("doc_id", text_or_empty(text).alias("_text")).join(F.broadcast(sample), "doc_id")
    found = texts.dropDuplicates(["doc_id"]).select("order", "_text", "label")
    numbered = stored(found.mapInArrow(_feature_batches, "order long, label long, row binary"), "labelled-features")
    model = numbered.repartition(1).mapInArrow(_fit_batches, "ratios binary, weights binary, bias double").first()
    if model is None:  # no labelled row at all
        return {"ratios": bytes(4 * FEATURES), "weights": bytes(4 * FEATURES), "bias": 0.0}
    return {"ratios": bytes(model["ratios"]), "weights": bytes(model["weights"]), "bias": model["bias"]}


def _scorer(model: dict, text: str, names: list[str], score: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = np.frombuffer(model["ratios"], "<f4").astype(np.float64)
        weights = np.frombuffer(model["weights"], "<f4").astype(np.float64)
        for batch in batches:
            scores = []
            for value in batch.column(text):
                row = features(value.as_py())
                margin = float(weights[row] @ _values(row, ratios)) + model["bias"]
                scores.append(1 / (1 + math.exp(-min(max(margin, -40.0), 40.0))))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, score])

    return run


def scored(docs: DataFrame, model: dict, text: str = "text", score: str = "_score") -> DataFrame:
    """docs with a column `score`, the probability of label 1."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields]).add(score, T.DoubleType())
    return docs.mapInArrow(_scorer(model, text, docs.columns, score), schema)


def keep_good(docs: DataFrame, model: dict, cut: float = CUT, text: str = "text") -> DataFrame:
    score = unused(docs, "_score")
    return scored(docs, model, text, score).filter(F.col(score) >= cut).select(*docs.columns)
