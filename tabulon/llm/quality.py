"""Operator 4: quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of raw text (all
documents); the logarithm of their ratio is a document's weight, and Gumbel top-k draws documents by weight without
replacement.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import cut_lineage, fresh, slices
from tabulon.llm.counting import CHUNK, summed
from tabulon.llm.words import CHAIN, STEP, hashed, mixed, spans

#: Hash buckets of word n-grams and of shape n-grams.
BUCKETS = CHUNK * 4
#: Labelled documents that the target model and the cut are learned from, at most; chosen by hash of the key.
LABELLED_ROWS = 20_000
#: Scale of the Gumbel noise against log weights. 1 draws in proportion to weight; less keeps short good documents surer.
TEMPERATURE = 0.05
#: Grid of keys for the selection of the k-th: keys are rounded to 2^-20 and held within 2^20.
KEY_SCALE, KEY_BOUND = 1 << 20, 1 << 20
#: Weight of a bucket's own counts against none, in n-grams.
SMOOTHING = 4.0

#: Byte classes for word shapes: lower, upper, digit, letter beyond ASCII, and each ASCII sign by itself.
CLASS = np.arange(256, dtype=np.uint64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 97, 65, 48, 128


@dataclass
class Model:
    """Log ratios of target to raw text for word and shape buckets, and the log weight from which a document is good."""

    ratios: np.ndarray
    cut: float


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, four to a word, and the number of words before each text.

    Single words and pairs of neighbours tell the vocabulary; shapes (byte classes at both ends, and whether the word
    repeats the one before) and pairs of shapes tell how the text is written, also for words never seen.
    """
    data, first, last, before = spans(column)
    if not len(first):
        return np.zeros((0, 4), np.int64), before
    own = hashed(data, first, last)
    inside = np.ones(len(first), bool)
    inside[before[:-1][before[:-1] < len(first)]] = False
    previous = np.where(inside, np.roll(own, 1), np.uint64(0))
    end = lambda back: CLASS[data[np.maximum(last - back, first)]]
    shape = ((CLASS[data[first]] * STEP + end(1)) * STEP + end(2)) * STEP + end(3)
    shape = mixed(shape + (own == previous).astype(np.uint64) * CHAIN)
    pair = np.where(inside, np.roll(shape, 1), np.uint64(0))
    size = np.uint64(BUCKETS)
    all_ = np.column_stack([own % size, mixed(previous * STEP + own) % size, size + shape % size, size + mixed(pair * STEP + shape) % size])
    return all_.astype(np.int64), before


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = LABELLED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Keys in rising order and labels of at most ``most`` labelled documents; null labels and keys don't count."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("v"))
    few = rows.groupBy("k").agg(F.max("v").alias("v")).orderBy(F.xxhash64("k"), "k").limit(most).toPandas()
    few = few.sort_values("k")
    return few["k"].to_numpy(np.int64), few["v"].to_numpy(np.int64)


def find(keys: np.ndarray, wanted: pa.Array) -> np.ndarray:
    """Place of each value among ``keys``, -1 where absent or null."""
    values = wanted.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where((keys[at] == values) & wanted.is_valid().to_numpy(zero_copy_only=False), at, -1)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED_ROWS) -> Model:
    """Counts n-grams of all documents and of the sample of good ones, then finds the cut on the sample."""
    keys, values = labelled(labels, key, label, most)
    docs = df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch], total: np.ndarray) -> None:
        for batch in batches:
            at = find(keys, batch.column(0))
            good = (at >= 0) & (values[at] == 1) if len(keys) else np.zeros(len(at), bool)
            for a, b in slices(batch.column(1)):
                found, before = grams(batch.column(1).slice(a, b - a))
                total[: 2 * BUCKETS] += np.bincount(found.ravel(), minlength=2 * BUCKETS)
                own = np.repeat(good[a:b], np.diff(before))
                total[2 * BUCKETS :] += np.bincount(found[own].ravel(), minlength=2 * BUCKETS)

    counts = summed(docs, 4 * BUCKETS, count).reshape(4, BUCKETS).astype(float)
    raw, target = counts[:2], counts[2:]
    if not target.sum():
        return Model(np.zeros(2 * BUCKETS), -np.inf)
    share = raw / np.maximum(raw.sum(1, keepdims=True), 1)
    # buckets that the small target sample hardly shows lean to the raw share, so rare words neither help nor harm
    ratio = (target + SMOOTHING * share * BUCKETS) / (target.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    ratios = np.log(np.maximum(ratio, 1e-12) / np.maximum(share, 1e-12))
    ratios[raw == 0] = 0.0
    model = Model(ratios.ravel(), 0.0)
    here = docs.where(F.col("doc_id").isin([])) if not len(keys) else weighted(docs, model, keep=keys)
    sample = here.select("doc_id", "log_weight").toPandas()
    at = np.searchsorted(keys, sample["doc_id"].to_numpy(np.int64))
    model.cut = best_cut(sample["log_weight"].to_numpy(), values[at])
    return model


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest wrong labels; without both labels nothing is cut."""
    if not (good == 1).any() or not (good != 1).any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order] == 1
    wrong = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum((~g)[::-1])[::-1], [0]))
    edges = np.concatenate(([w[0] - 1.0], w, [w[-1] + 1.0]))
    least = np.flatnonzero(wrong == wrong.min())
    gap = edges[least + 1] - edges[least]
    i = least[int(gap.argmax())]
    return float((edges[i] + edges[i + 1]) / 2)


def weighted(df: DataFrame, model: Model, text: str = "text", keep: np.ndarray | None = None, key: str = "doc_id") -> DataFrame:
    """All columns of ``df`` and log_weight; with ``keep`` only rows of these keys."""
    (name,) = fresh(df, "log_weight")
    ratios = model.ratios
    at_text, at_key = df.columns.index(text), df.columns.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if keep is not None:
                batch = batch.filter(pa.array(find(keep, batch.column(at_key)) >= 0))
            out = np.zeros(batch.num_rows)
            for a, b in slices(batch.column(at_text)):
                found, before = grams(batch.column(at_text).slice(a, b - a))
                each = np.concatenate(([0.0], np.cumsum(ratios[found].sum(1))))
                out[a:b] = each[before[1:]] - each[before[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def draw_key(weight: Column, key: Column, text: Column, temperature: float, seed: int) -> Column:
    """Log weight plus Gumbel noise from a hash of the row, so reruns agree, on a grid of whole numbers."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    noisy = weight - F.log(-F.log(u)) * temperature
    return F.round(F.greatest(F.least(noisy, F.lit(float(KEY_BOUND))), F.lit(-float(KEY_BOUND))) * KEY_SCALE).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the whole numbers ``draw``; by counts of leading digits, then of the next within one of them."""
    low = None
    for shift in (27, 13, 0):
        digit = F.floor(F.col("draw") / F.lit(1 << shift)).cast("long")
        rows = keys if low is None else keys.where(F.floor(F.col("draw") / F.lit(1 << last)).cast("long") == low)
        for row in rows.groupBy(digit.alias("digit")).count().orderBy(F.col("digit").desc()).toLocalIterator():
            if k <= row["count"]:
                low, last = row["digit"], shift
                break
            k -= row["count"]
        else:
            return None
    return low


def resample(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", k: int | None = None, temperature: float = TEMPERATURE, seed: int = 5) -> DataFrame:
    """key, log_weight, draw, kept: the k documents with the largest noisy log weights are kept.

    ``k`` is by default the number of documents above the model's cut. ``draw`` is the noisy log weight times 2^20, as a
    whole number; rows that tie with the k-th are all kept. Null and empty texts have log weight 0. Null and repeated
    keys are rows like others; repeated rows draw alike. No labels, or one label only: all are kept. An empty table
    gives no rows.
    """
    rows = cut_lineage(draws(df, model, key, text, temperature, seed))
    least = threshold(rows, model, k)
    return rows.select(F.col("doc_id").alias(key), "log_weight", "draw", (F.col("draw") >= least).alias("kept"))


def threshold(rows: DataFrame, model: Model, k: int | None) -> int:
    """The smallest draw that is kept."""
    nothing = -KEY_BOUND * KEY_SCALE
    if k is None:
        k = rows.where(F.col("log_weight") > F.lit(model.cut)).count()
    if k <= 0:
        return KEY_BOUND * KEY_SCALE + 1
    found = kth_largest(rows, k)
    return nothing if found is None else found


def good_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE, seed: int = 5) -> DataFrame:
    """The rows of ``df`` that ``resample`` keeps, with their columns; no text is shuffled."""
    model = fit(df, labels, key, text)
    least = threshold(cut_lineage(draws(df, model, key, text, temperature, seed)), model, None)
    scored = weighted(df, model, text, key=key)
    weight = scored.columns[-1]
    draw = draw_key(F.col(weight), F.col(key), F.xxhash64(F.col(text).cast("string")), temperature, seed)
    return scored.where(draw >= least).drop(weight)


def draws(df: DataFrame, model: Model, key: str, text: str, temperature: float, seed: int) -> DataFrame:
    named = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    scored = weighted(named, model)
    return scored.select("doc_id", "log_weight", draw_key(F.col("log_weight"), F.col("doc_id"), F.xxhash64("text"), temperature, seed).alias("draw"))
