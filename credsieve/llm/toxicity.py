"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words in lower case and their beginnings, each counted once
and hashed.  The machine scores
    bias + sum w_i + sum over pairs <v_i, v_j>
through a logistic function; the factors v let it learn that two terms together mean more,
or less, than each alone.

It is fitted on a bounded sample of labelled rows (``rows_per_class`` of each class, chosen
by a hash of the id); rows are weighted so that the scores are shares of all labelled rows.
Terms come from the sample by a chi-square test; at most ``TERMS`` are kept.

Defined results: a null or empty text has no terms and gets the score of the bias; without
labelled rows, or with one class only, every score is the share of toxic rows (0 without
any); several labels of an id count as toxic if one is; rows are scored one by one, so
repeated rows get equal scores; a very long text is a set of terms like any other, whole; an
empty table gives an empty result.  Columns of the documents stay, whatever their names,
but for those of the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_CLASS = 2500
SPACE_BITS = 20
TERMS = 4096
FACTORS = 8
STEPS = 250
BEGINNINGS = (3, 4, 5, 6)
# Words whose kept terms a task remembers.
REMEMBERED = 200_000
THRESHOLD = 0.3

WORDS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    top = (1 << SPACE_BITS) - 1
    found = [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) & top]
    for n in BEGINNINGS:
        if len(word) >= n:
            found.append(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) & top)
    return found


def text_terms(text: str | None) -> np.ndarray:
    terms: set[int] = set()
    for word in set(WORDS.findall((text or "").lower())):
        terms.update(word_terms(word))
    return np.array(sorted(terms), np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    kept: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str | None) -> float:
        rows: set[int] = set()
        for word in set(WORDS.findall((text or "").lower())):
            own = self.known.get(word)
            if own is None:
                own = tuple(self.kept[t] for t in word_terms(word) if t in self.kept)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = own
            if own:
                rows.update(own)
        at = np.fromiter(sorted(rows), np.int64, len(rows))
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _chosen_terms(rows: list[np.ndarray], labels: np.ndarray) -> dict[int, int]:
    """The terms that tell the classes apart best, by chi-square with a continuity correction."""
    size = 1 << SPACE_BITS
    toxic, clean = np.zeros(size), np.zeros(size)
    for terms, label in zip(rows, labels):
        (toxic if label else clean)[terms] += 1
    n1, n0 = max(1.0, float(labels.sum())), max(1.0, float((1 - labels).sum()))
    seen = toxic + clean
    expected = seen * n1 / (n1 + n0)
    away = np.maximum(0, np.abs(toxic - expected) - 0.5)
    rest = np.maximum(1.0, n1 + n0 - seen)
    chi = np.where(seen >= 3, away**2 * (n1 + n0) ** 3 / (np.maximum(seen, 1) * rest * n1 * n0), 0)
    order = np.lexsort((np.arange(size), -chi))[:TERMS]
    return {int(t): i for i, t in enumerate(order) if chi[t] > 3.84}


def train(rows: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray) -> FactorizationMachine:
    """Fit by full-batch Adam; ``rows`` are arrays of term hashes."""
    share = float((labels * row_weights).sum() / max(1e-12, row_weights.sum())) if len(labels) else 0.0
    flat = FactorizationMachine(
        float(np.log((share + 1e-9) / (1 - share + 1e-9))), {}, np.zeros(0), np.zeros((0, FACTORS))
    )
    if len(set(labels.tolist())) < 2:
        return flat
    kept = _chosen_terms(rows, labels)
    if not kept:
        return flat
    lists = [np.array([kept[t] for t in terms.tolist() if t in kept], np.int64) for terms in rows]
    sizes = np.array([len(x) for x in lists])
    term = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), sizes)
    n, m = len(lists), len(kept)
    draw = np.random.default_rng(7)
    theta = np.concatenate([[flat.bias], np.zeros(m), draw.normal(0, 0.01, m * FACTORS)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    weights = row_weights / row_weights.sum()

    def per_row(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x, n)

    for step in range(1, STEPS + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(FACTORS, m)
        z = theta[0] + per_row(w[term])
        sums = []
        for f in range(FACTORS):
            picked = v[f][term]
            sums.append(per_row(picked))
            z += 0.5 * (sums[f] ** 2 - per_row(picked**2))
        error = weights * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        grad = np.empty_like(theta)
        grad[0] = error.sum()
        at = error[row]
        grad[1 : m + 1] = np.bincount(term, at, m) + 1e-5 * w
        for f in range(FACTORS):
            part = np.bincount(term, at * (sums[f][row] - v[f][term]), m)
            grad[1 + m + f * m : 1 + m + (f + 1) * m] = part + 1e-4 * v[f]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(
        float(theta[0]), kept, theta[1 : m + 1].copy(), theta[m + 1 :].reshape(FACTORS, m).T.copy()
    )


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, rows_per_class: int = ROWS_PER_CLASS
) -> FactorizationMachine:
    """Learn from the rows of ``docs`` whose ``doc_id`` meets ``training`` and has a label."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(training)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, rows_per_class / max(1, sizes.get(1, 0))).otherwise(
        rows_per_class / max(1, sizes.get(0, 0))
    )
    # about rows_per_class ids of each class, whatever the number of labels
    sample = F.broadcast(known.where(draw < share).withColumnRenamed("toxic", "_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [text_terms(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["label", "terms"]
            )

    text = F.col("text").cast("string").alias("text")
    rows = docs.select("doc_id", text).join(sample, "doc_id").select("_label", "text")
    got = rows.mapInArrow(run, "label int, terms array<int>").toArrow()
    pairs = sorted(((t.as_py(), y.as_py()) for y, t in zip(got["label"], got["terms"])), key=lambda p: (p[1], p[0]))
    y = np.array([p[1] for p in pairs], np.float64)
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([sizes.get(int(c), 1) / drawn[int(c)] for c in y])
    return train([np.array(p[0], np.int64) for p in pairs], y, weights)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with score and predicted; same-named columns are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TERMS rows of factors at most

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = sent.value
        for texts in batches:
            yield pd.Series([machine.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
