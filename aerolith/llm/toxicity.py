"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - c_k): all thresholds c_k share the weights w. The model is fitted on a
bounded sample of labelled rows, whose features are counted by Spark, and then scores every row of the table in its
own task, with weights of a fixed size. Labels say only whether a text is toxic, so the grades are 0 for texts that
are not, and 1 or 2 for toxic ones that hold fewer or more marker words than the median; markers are the words that
labelled toxic texts use far more often than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove_all, text_of, written

LETTERS = re.compile(r"[^\W\d_]+")
#: At most so many labelled rows are used to fit the model (in order of a hash of doc_id).
MAX_LABELLED = 8_000
#: Words whose features a task remembers.
CACHE_WORDS = 200_000
#: Lengths of word beginnings that count as features beside whole words.
STARTS = (4, 5)


def features(text: str | None) -> Counter[str]:
    """Counts of lower-case words and of their beginnings (marked by a star)."""
    words = Counter(LETTERS.findall(text.lower())) if text else Counter()
    found: Counter[str] = Counter()
    for w, n in words.items():
        found[w] += n
        for k in STARTS:
            if len(w) >= k:
                found[w[:k] + "*"] += n
    return found


@dataclass
class OrdinalModel:
    """Weights by feature, and one threshold for each grade above 0."""

    weights: dict[str, float]
    cuts: list[float]


class Scorer(dict):
    """Places of a word's features among the weights, so that a batch of texts is scored at once; most words have none."""

    def __init__(self, model: OrdinalModel):
        self.at = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.array(list(model.weights.values()))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(self.at[f] for f in (word, *(word[:k] + "*" for k in STARTS if len(word) >= k)) if f in self.at)
        return found

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Sum of the weights of what each text holds, each by the logarithm of its count."""
        held = [list(chain.from_iterable(map(self.__getitem__, LETTERS.findall(t.lower())))) if t else [] for t in texts]
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        if not sizes.sum():
            return np.zeros(len(texts))
        key = np.repeat(np.arange(len(texts)), sizes) * len(self.weights) + np.fromiter(chain.from_iterable(held), np.int64, int(sizes.sum()))
        key, n = np.unique(key, return_counts=True)
        return np.bincount(key // len(self.weights), self.weights[key % len(self.weights)] * (1.0 + np.log(n)), len(texts))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, least: float = 2.5, seen: int = 5) -> OrdinalModel:
    """The model of at most ``most`` labelled documents, one row each, those with the smallest hash of doc_id.

    Of rows that repeat a doc_id the first text in order counts. What reaches the driver are the counts of markers,
    features that at least ``seen`` toxic texts hold and whose log odds are ``least`` or more; texts never do. Without
    toxic or without other documents among the labels no text is toxic (or all are): the thresholds say so.
    """
    paths: list[str] = []
    marks = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "tox-chosen", paths)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most ``most``

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, y, t in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("text"), strict=True):
                found = features(t.as_py()) or Counter({"": 0})  # a text without features is a row too
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int64()), pa.array([y] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["doc_id", "toxic", "feature", "n"])

    held = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(count, "doc_id long, toxic int, feature string, n long"), "tox-features", paths)
    texts = held.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("k")).orderBy("doc_id").collect()
    y = {r["doc_id"]: int(r["toxic"]) for r in texts}
    n_toxic, n_other = sum(y.values()), len(y) - sum(y.values())
    if not n_toxic or not n_other:
        remove_all(docs.sparkSession, paths)
        far = -30.0 if n_toxic else 30.0
        return OrdinalModel({}, [far, 30.0])
    per = held.where("feature <> ''").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= seen)
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_other + 1))
    markers = written(per.where(odds >= least).select("feature"), "tox-markers", paths)
    found = held.join(markers, "feature", "left_semi").select("doc_id", "feature", "n").orderBy("doc_id", "feature").collect()
    remove_all(docs.sparkSession, paths)
    at = {d: i for i, d in enumerate(y)}
    return solved(list(y.values()), [(at[r["doc_id"]], r["feature"], r["n"]) for r in found])


def solved(toxic: list[int], counts: list[tuple[int, str, int]], penalty: float = 1e-3, steps: int = 400) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by gradient descent with momentum, from (row, marker, count)."""
    y_toxic, m = np.array(toxic, dtype=int), len(toxic)
    names = sorted({f for _, f, _ in counts})
    at = {f: i for i, f in enumerate(names)}
    r, c = np.array([i for i, _, _ in counts], dtype=int), np.array([at[f] for _, f, _ in counts], dtype=int)
    v = 1.0 + np.log(np.array([n for _, _, n in counts], dtype=float))
    held = np.bincount(r, [n * (not f.endswith("*")) for _, f, n in counts], m) if counts else np.zeros(m)
    y = np.where(y_toxic == 1, np.where(held > np.median(held[y_toxic == 1]), 2, 1), 0)
    w, cuts = np.zeros(len(names)), np.array([2.0, 4.0])
    move_w, move_c = np.zeros_like(w), np.zeros_like(cuts)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    squares = np.zeros_like(w) + 1e-8
    squares_c = np.zeros_like(cuts) + 1e-8
    # toxic rows are few: each side counts half
    share = np.where(y_toxic == 1, 0.5 / (y_toxic == 1).sum(), 0.5 / (y_toxic == 0).sum())
    for _ in range(steps):
        z = np.bincount(r, v * w[c], m)
        upper = np.stack([np.ones(m), sigmoid(z - cuts[0]), sigmoid(z - cuts[1]), np.zeros(m)], 1)
        p = np.maximum(upper[np.arange(m), y] - upper[np.arange(m), y + 1], 1e-12)
        slope = upper * (1 - upper)
        d_z = (slope[np.arange(m), y] - slope[np.arange(m), y + 1]) / p * share
        d_w = -np.bincount(c, v * d_z[r], len(w)) + penalty * w / max(1, len(names))
        hit = lambda k: (np.where(y == k, slope[:, k] / p, 0) - np.where(y == k - 1, slope[:, k] / p, 0)) * share
        d_c = np.array([hit(1).sum(), hit(2).sum()])
        move_w, move_c = 0.9 * move_w + 0.1 * d_w, 0.9 * move_c + 0.1 * d_c
        squares, squares_c = 0.99 * squares + 0.01 * d_w**2, 0.99 * squares_c + 0.01 * d_c**2
        w -= 0.03 * move_w / np.sqrt(squares)
        cuts -= 0.03 * move_c / np.sqrt(squares_c)
        w = np.maximum(w, 0)  # markers only ever raise the severity
        cuts[1] = max(cuts[1], cuts[0] + 1e-3)
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-3}, [float(x) for x in cuts])


def margin_of(docs: DataFrame, model: OrdinalModel):
    """A function of the text column: the margin of each text, in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the markers of MAX_LABELLED documents
    scorers: list[Scorer] = []

    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(shared.value))
        parts = [scorers[0].margins(texts.slice(low, 500).to_pylist()) for low in range(0, len(texts), 500)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return margin


def severity(docs: DataFrame, model: OrdinalModel, rejected_at: float = 0.5) -> DataFrame:
    """One row a document: doc_id, p_grade1 and p_grade2 (at least that grade), severity, grade, toxic.

    severity is the expected grade, grade the median one: the highest that the text reaches with a probability of a
    half or more. Null and empty texts score like a text without
    any feature, rows may repeat, and an empty table gives an empty result; other columns are ignored.
    """
    def above(cut: float) -> Column:
        return 1 / (1 + F.exp(-(F.col("margin") - F.lit(cut))))

    scored = docs.select("doc_id", margin_of(docs, model)(text_of()).alias("margin"))
    scored = scored.withColumns({"p_grade1": above(model.cuts[0]), "p_grade2": above(model.cuts[1])})
    best = F.when(F.col("p_grade2") >= 0.5, 2).when(F.col("p_grade1") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", "p_grade1", "p_grade2", (F.col("p_grade1") + F.col("p_grade2")).alias("severity"), best.alias("grade"), (F.col("p_grade1") >= rejected_at).alias("toxic"))


def clean(docs: DataFrame, model: OrdinalModel, rejected_at: float = 0.5) -> DataFrame:
    """The documents that are not rejected as toxic, with their own columns.

    Null and empty texts stay, rows that repeat are judged alike, and an empty table gives an empty one.
    """
    limit = model.cuts[0] + float(np.log(rejected_at / (1 - rejected_at)))
    return docs.where(margin_of(docs, model)(text_of()) < F.lit(limit))
