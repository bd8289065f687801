"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (one to three characters, letters in lower
case, everything else one blank), weighted by tf-idf and normalised.  Each language has
several centroids, found by spherical k-means among labelled texts of that language; a
text gets the language of the centroid with the largest cosine.

Document frequencies come from all labelled texts.  The centroids are fitted on a sample
bounded by ``per_language``, chosen by a hash of the row.

N-grams that no labelled text of the sample has are kept apart from those that share a
feature with them: they add to the length of a vector and to no cosine.

Rejection by distance: a text whose best cosine lies below the bound of its language and
length is near no centroid; the bound is a fraction of a low quantile of the best cosines
of fitted texts of that language and about that length.  A text without letters has no
vector and is rejected as ``und``.

Defined results: null, empty and letterless texts are ``und`` with score 0; of equal
cosines the alphabetically first language wins; rows are independent, so repeated rows
get equal results; with no labelled text at all everything is ``und``; a very long text is
read in slices, whole; an empty table gives an empty result.  Columns of the documents stay,
whatever their names, but for those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import fresh

UNKNOWN = "und"
FEATURES = 1 << 13
PER_LANGUAGE = 600
CENTROIDS = 4
ROUNDS = 8
# Share of the low quantile of similarities of fitted texts below which a text is rejected.
REJECT_SHARE = 0.2
REJECT_QUANTILE = 0.01
# Fitted texts a quantile is taken from at least.
REJECT_TEXTS = 20
# N-grams are known or not by so many bits of their hash.
KNOWN_BITS = 24
# Characters turned into n-grams at a time.
BLOCK = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _ngram_slots(text: str) -> Iterator[np.ndarray]:
    """The first KNOWN_BITS bits of the hashes of n-grams, in parts; nothing without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return
    clean = np.where(is_letter, points, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    clean = np.concatenate([[32], clean[keep], [32]]).astype(np.uint32)
    for low in range(0, len(clean) - 1, BLOCK):
        part = clean[low : low + BLOCK + 2]
        ones = part[: min(BLOCK, len(part))] * np.uint32(0x9E3779B1)
        twos = part[:-1] * np.uint32(0x85EBCA77) + part[1:] * np.uint32(0xC2B2AE3D)
        threes = twos[:-1] * np.uint32(0x27D4EB2F) + part[2:] * np.uint32(0x165667B1)
        for grams in (ones, twos[:BLOCK], threes[:BLOCK]):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield mixed >> np.uint32(32 - KNOWN_BITS)


def ngram_counts(text: str, known: np.ndarray | None = None) -> np.ndarray | None:
    """Counts of hashed n-grams, None for a text without letters.

    With ``known`` (by slot) those of unknown n-grams come after those of known ones.
    """
    counts = None
    for slots in _ngram_slots(text):
        features = (slots >> np.uint32(KNOWN_BITS - 13)).astype(np.int64)
        if known is not None:
            features += np.where(known[slots], 0, FEATURES)
        found = np.bincount(features, minlength=FEATURES * (1 if known is None else 2))
        counts = found if counts is None else counts + found
    return counts


def length_class(n_grams: int) -> int:
    return int(n_grams).bit_length()


@dataclass
class Centroids:
    """What predicts: one row of ``vectors`` per centroid, ``languages`` beside it."""

    languages: list[str]
    vectors: np.ndarray
    idf: np.ndarray
    new: float  # weight of an n-gram that is not known
    slots: np.ndarray  # of the known n-grams
    bounds: dict[str, np.ndarray]  # of each language by length class

    @cached_property
    def known(self) -> np.ndarray:
        out = np.zeros(1 << KNOWN_BITS, bool)
        out[self.slots] = True
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text, self.known) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        at = np.flatnonzero(counts[:FEATURES])
        weights = np.log1p(counts[at]) * self.idf[at]
        others = np.log1p(counts[FEATURES:][counts[FEATURES:] > 0]) * self.new
        norm = np.sqrt(weights @ weights + others @ others)
        cosines = (self.vectors[:, at] @ weights) / norm
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        bound = self.bounds[self.languages[best]][length_class(counts.sum())]
        return self.languages[best], score, bool(score < bound)


def _counts_of_documents(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram occurs, over all of ``labelled``; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    seen += counts > 0
                    n += 1
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())],
                names=["feature", "n"],
            )

    rows = labelled.select("text").mapInArrow(run, "feature int, n long")
    sums = rows.groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    seen, n = np.zeros(FEATURES), 0
    for row in sums:
        if row["feature"] < 0:
            n = row["n"]
        else:
            seen[row["feature"]] = row["n"]
    return seen, n


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` texts of each language, chosen by a hash of the row."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    share = F.lit(float(per_language)) / F.col("_n")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(sizes), "lang").where(draw < share).select("lang", "text")


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from texts far apart from each other."""
    chosen = [0]
    for _ in range(1, min(k, len(vectors))):
        nearest = (vectors @ vectors[chosen].T).max(1)
        chosen.append(int(np.argmin(nearest)))
    centres = vectors[sorted(set(chosen))]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T, 1)
        sums = np.stack([vectors[own == c].sum(0) for c in range(len(centres)) if (own == c).any()])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _bounds(cosines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosines below which texts are rejected, for each length class."""
    classes = np.array([length_class(n) for n in sizes])
    out = np.zeros(65)
    for c in range(65):
        near, reach = np.abs(classes - c) <= 1, 1
        while near.sum() < min(REJECT_TEXTS, len(classes)):
            reach += 1  # shorter texts first, whose cosines are smaller
            near = (classes <= c + 1) & (classes >= c - reach) if reach <= 64 else classes >= 0
        low = np.quantile(cosines[near], REJECT_QUANTILE)
        # the cosines of texts shorter than any fitted one fall with the root of their length
        out[c] = REJECT_SHARE * low * 2.0 ** (-max(0, classes[near].min() - c) / 2)
    return np.minimum.accumulate(out[::-1])[::-1]


def fit(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS
) -> Centroids:
    """Learn from ``labelled`` (doc_id, text, lang; rows with nulls in text or lang are left out)."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    seen, n = _counts_of_documents(labelled)
    if not n:
        return Centroids([], np.zeros((0, FEATURES)), np.zeros(FEATURES), 0.0, np.zeros(0, np.int64), {})
    idf = np.log((1 + n) / (1 + seen)) + 0.05

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, features, counts = [], [], []
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = ngram_counts(text.as_py())
                if found is not None:
                    at = np.flatnonzero(found)
                    langs.append(lang.as_py())
                    features.append(at.astype(np.int32))
                    counts.append(found[at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(features, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["lang", "features", "counts"],
            )

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                for slots in _ngram_slots(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots).astype(np.int32))], names=["slot"])

    texts = _sample(labelled, per_language)
    # different n-grams of the sample, bounded by its texts and by 2 ** KNOWN_BITS
    slots = texts.mapInArrow(slots_of, "slot int").distinct().toArrow()["slot"].to_numpy()
    # bounded by per_language texts of FEATURES numbers for each language
    sample = texts.mapInArrow(
        run, "lang string, features array<int>, counts array<long>"
    ).toArrow()
    by_language: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, list[int]] = {}
    order = sorted(range(sample.num_rows), key=lambda i: (sample["lang"][i].as_py(), sample["features"][i].as_py()))
    for i in order:
        vector = np.zeros(FEATURES, np.float32)
        at = np.asarray(sample["features"][i].as_py())
        vector[at] = np.log1p(np.asarray(sample["counts"][i].as_py())) * idf[at]
        by_language.setdefault(sample["lang"][i].as_py(), []).append(vector / np.linalg.norm(vector))
        sizes.setdefault(sample["lang"][i].as_py(), []).append(sum(sample["counts"][i].as_py()))
    names, rows, bounds = [], [], {}
    for lang in sorted(by_language):
        vectors = np.stack(by_language.pop(lang))
        centres = _cluster(vectors, centroids)
        names += [lang] * len(centres)
        rows.append(centres)
        bounds[lang] = _bounds((vectors @ centres.T).max(1), np.array(sizes[lang]))
    vectors = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
    return Centroids(names, vectors.astype(np.float64), idf, float(np.log(1 + n) + 0.05), slots, bounds)


def _nearest(docs: DataFrame, model: Centroids) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes, bounded by the model

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [sent.value.nearest(t) for t in texts], columns=["lang_pred", "score", "rejected"]
            )

    return nearest(F.col("text").cast("string"))


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine) and rejected; same-named columns are replaced."""
    found = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in found]
    own = fresh(docs, "_found")
    return docs.withColumn(own, _nearest(docs, model)).select(*kept, *[f"{own}.{c}" for c in found])


def drop_unknown(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns."""
    own = fresh(docs, "_found")
    found = docs.withColumn(own, _nearest(docs, model))
    return found.where(~F.col(f"{own}.rejected")).select(*docs.columns)
