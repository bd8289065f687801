"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on ``PROJECTIONS`` random lines, and the projections are sorted.  Two
vectors collide on a line if the second lies in the window of half-width ``WINDOW`` centred
on the first, a range of the sorted order.  Collisions are counted per pair.  At the cosine of
the threshold a line collides with a known probability, which gives the smallest number of
collisions that loses at most ``MISSED`` of such pairs; only pairs with as many are verified
by their exact cosine.

So that not every pair need be counted, the lines of each of ``TABLES`` tables are cut at
their median into cells.  A vector is at home in one cell and visits every cell its window
reaches, so a pair is met where one is at home and the other visits; it is counted in the
first table where they meet.  The number of cut lines follows the number of vectors, and how
far a visitor reaches follows the number of cut lines: ``reach`` is the smallest half-width
at which the tables together lose at most ``MISSED`` of the pairs at the threshold, for
vectors as far from the mean as those of the sample.  Cells and count together lose at most
twice ``MISSED``.

A cell with more vectors than ``HOME`` or ``VISITORS`` is dealt over several tasks, each of
which compares a part of the homes with a part of the visitors.  A task returns numbers of
links and a spanning forest of what it linked, never the pairs.

The splits are medians of a bounded sample; every vector is indexed.

Defined results: vectors that are null, zero or hold null or non-finite components, or
whose label is null, link with nothing.  Vectors of different lengths never link.  Equal
vectors of a label are one class, linked with each other without being compared; rows that
repeat a vec_id are vectors of their own.  An empty table gives an empty result; other columns
are left behind, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, erfc, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.components import components
from credsieve.storage import Steps

COSINE = 0.98
PROJECTIONS = 64
TABLES = 3
# Half-width of a window, in units of the distance of two vectors at the threshold.
WINDOW = 1.5
MISSED = 1e-7
# Vectors a cell should have, and the rows one task compares.
CELL = 512
HOME = 1024
VISITORS = 8192
SAMPLE = 4096
# Pairs verified at a time.
PAIRS = 1 << 16


def radius(cosine: float) -> float:
    """Distance of two unit vectors at that cosine."""
    return sqrt(max(0.0, 2 - 2 * cosine))


@lru_cache(1)
def needed_collisions() -> int:
    """The largest count that pairs at the threshold miss with probability MISSED at most."""
    p = erf(WINDOW / sqrt(2))
    below = 0.0
    for n in range(PROJECTIONS + 1):
        below += comb(PROJECTIONS, n) * p**n * (1 - p) ** (PROJECTIONS - n)
        if below > MISSED:
            return n
    return PROJECTIONS


def reach(bits: int, spread: np.ndarray, cosine: float = COSINE) -> float:
    """Half-width of the cuts at which visitors at these distances from the mean miss MISSED at most.

    On a random line a visitor is normal around the cut with its distance as deviation, and its
    partner normal around it with the radius.  A cut loses the pair if the visitor is beyond the
    half-width and the partner across; a table if one of its cuts does.
    """
    if not bits:
        return WINDOW * radius(cosine)
    r = max(radius(cosine), 1e-9)
    at = np.linspace(0, 6, 301)  # places of visitors in radii; twice one side of the cut
    across = np.array([erfc(x / sqrt(2)) / 2 for x in at])
    width = np.maximum(spread, 1e-9)[:, None] / r
    near = 2 * np.exp(-((at / width) ** 2) / 2) / (width * sqrt(2 * pi)) * across * (at[1] - at[0])
    lost = np.minimum(1.0, near[:, ::-1].cumsum(1)[:, ::-1])  # beyond each place
    # no density can make a cut lose more than the partners that are as far away
    lost = np.minimum(lost, 2 * across)
    total = ((1 - (1 - lost) ** bits) ** TABLES).mean(0)
    return max(WINDOW * r, float(at[np.argmax(total <= MISSED)] * r))


@lru_cache(16)
def lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20 + dimensions).standard_normal((dimensions, PROJECTIONS))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their class, and (node, kind, embedding, n, least) per class.

    ``kind`` is the label and the number of dimensions.  Rows that cannot link have no class.
    """
    e = F.col("embedding")
    sound = (
        F.col("label").isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    kind = F.concat_ws(":", F.col("label").cast("string"), F.size(e).cast("string"))
    rows = vectors.select(
        "vec_id", e.alias("embedding"), F.when(F.coalesce(sound, F.lit(False)), kind).alias("kind")
    ).withColumn("node", F.when(F.col("kind").isNotNull(), F.xxhash64("kind", "embedding", F.hash("embedding"))))
    found = (
        rows.where("node IS NOT NULL")
        .groupBy("node", "kind")
        .agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    )
    return rows.select("vec_id", "node"), found


def cuts(vectors: np.ndarray, bits: int, cosine: float) -> tuple[np.ndarray, float]:
    """Median of every line over these unit vectors, and how far visitors reach from it."""
    spread = np.sqrt(((vectors - vectors.mean(0)) ** 2).sum(1))
    return np.median(vectors @ lines(vectors.shape[1]), axis=0), reach(bits, spread, cosine)


def _splits(reps: DataFrame, bits: int, cosine: float) -> dict[int, tuple[np.ndarray, float]]:
    """The cuts from a bounded sample, for each number of dimensions."""
    some = reps.select("embedding").orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()
    out = {}
    for size, part in some.groupby(some["embedding"].map(len)):
        out[int(size)] = cuts(unit(_stack(part["embedding"])), bits, cosine)
    return out


def _placed(reps: DataFrame, bits: int, cosine: float) -> DataFrame:
    """Every class at home in one cell per table, and in all cells it reaches."""
    splits = _splits(reps, bits, cosine)
    # a number of dimensions that the sample does not have
    unknown = np.zeros(PROJECTIONS), max(reach(bits, np.full(1, s), cosine) for s in np.linspace(0.1, 2, 20))
    schema = "node long, kind string, n long, embedding array<double>, signs long, far long, tab int, cell long, home boolean"

    def run(batches):
        for batch in batches:
            for size, part in batch.groupby(batch["embedding"].map(len)):
                vectors = unit(_stack(part["embedding"]))
                split, half = splits.get(int(size), unknown)
                places = vectors @ lines(int(size)) - split
                powers = np.uint64(1) << np.arange(PROJECTIONS, dtype=np.uint64)
                signs = ((places >= 0) * powers).sum(1, dtype=np.uint64).view(np.int64)
                far = ((np.abs(places) > half) * powers).sum(1, dtype=np.uint64).view(np.int64)
                rows = []
                for i, (node, kind, n) in enumerate(zip(part["node"], part["kind"], part["n"])):
                    own = (node, kind, n, vectors[i], int(signs[i]), int(far[i]))
                    for t in range(TABLES):
                        first = t * (PROJECTIONS // TABLES)
                        at = places[i, first : first + bits]
                        cell = sum(1 << b for b in range(bits) if at[b] >= 0)
                        rows.append((*own, t, cell, True))
                        reached = [cell]
                        for b in range(bits):
                            if abs(at[b]) <= half:
                                reached += [c ^ (1 << b) for c in reached]
                        rows += [(*own, t, c, False) for c in reached]
                        if len(rows) > 4000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    columns = ["node", "kind", "n", "embedding", "signs", "far", "tab", "cell", "home"]
    return reps.select("node", "kind", "n", "embedding").mapInPandas(run, schema)


def _dealt(placed: DataFrame) -> DataFrame:
    """Cells cut into parts of homes times parts of visitors."""
    name = ["kind", "tab", "cell"]
    sizes = placed.groupBy(*name).agg(
        F.ceil(F.count_if("home") / HOME).alias("h"), F.ceil(F.count_if(~F.col("home")) / VISITORS).alias("v")
    )
    # cells without a home compare nothing; large ones are at most rows / HOME
    large = F.broadcast(sizes.where("h > 1 OR v > 1"))
    rows = placed.join(large, name, "left")
    h, v = F.coalesce("h", F.lit(1)), F.coalesce("v", F.lit(1))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), h).otherwise(v))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), v).otherwise(h) - 1)
    return (
        rows.withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .withColumn("hp", F.when(F.col("home"), F.col("_own")).otherwise(F.col("_other")))
        .withColumn("vp", F.when(F.col("home"), F.col("_other")).otherwise(F.col("_own")))
        .drop("_own", "_other", "h", "v")
    )


def linked(a: pd.DataFrame, b: pd.DataFrame, table: int, bits: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of homes ``a`` and visitors ``b``, first met in ``table``."""
    x, y = _stack(a["embedding"]), _stack(b["embedding"])
    half = WINDOW * radius(cosine)
    p, q = x @ lines(x.shape[1]), y @ lines(y.shape[1])
    # every projection of the homes sorted once: a home has a rank on each line
    ordered = np.sort(p, axis=0)
    ranks = np.empty(p.shape, np.int32)
    np.put_along_axis(ranks, np.argsort(p, axis=0, kind="stable"), np.arange(len(p), dtype=np.int32)[:, None], 0)
    nodes_a, nodes_b = a["node"].to_numpy(), b["node"].to_numpy()
    signs_a, signs_b = a["signs"].to_numpy(), b["signs"].to_numpy()
    far_b = b["far"].to_numpy()
    least = needed_collisions()
    out_a, out_b = [], []
    for low in range(0, len(b), 1024):
        part = slice(low, low + 1024)
        open_ = nodes_a[:, None] < nodes_b[None, part]
        apart = (signs_a[:, None] ^ signs_b[None, part]) & far_b[None, part]
        for t in range(table):
            mask = ((1 << bits) - 1) << (t * (PROJECTIONS // TABLES))
            open_ &= (apart & np.int64(mask)) != 0  # else they met there
        # on each line a visitor's window is a range of ranks; the homes in it collide
        collisions = np.zeros(open_.shape, np.uint8)
        for j in range(PROJECTIONS):
            first = np.searchsorted(ordered[:, j], q[part, j] - half, "left").astype(np.int32)
            past = np.searchsorted(ordered[:, j], q[part, j] + half, "right").astype(np.int32)
            # a rank before the window is a very large number without its sign
            collisions += (ranks[:, j, None] - first[None]).view(np.uint32) < (past - first).view(np.uint32)[None]
        at, bt = np.nonzero(open_ & (collisions >= least))
        bt = bt + low
        for cut in range(0, len(at), PAIRS):
            i, j = at[cut : cut + PAIRS], bt[cut : cut + PAIRS]
            close = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            out_a.append(i[close])
            out_b.append(j[close])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) with the components of the pairs (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, steps: Steps | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    steps = steps or Steps(vectors.sparkSession)
    rows, reps = classes(vectors)
    reps = steps.write(reps)
    largest = reps.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(0, min(PROJECTIONS // TABLES - 1, int(np.ceil(np.log2(max(1, largest) / CELL)))))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        homes, visitors = group[group["home"]], group[~group["home"]]
        empty = pd.DataFrame({"node": [], "other": [], "links": []}, dtype="int64")
        if homes.empty or visitors.empty:
            return empty
        homes, visitors = homes.reset_index(drop=True), visitors.reset_index(drop=True)
        i, j = linked(homes, visitors, int(key[1]), bits, cosine)
        if not len(i):
            return empty
        a, b = homes["node"].to_numpy(), visitors["node"].to_numpy()
        na, nb = homes["n"].to_numpy(), visitors["n"].to_numpy()
        for_a = np.bincount(i, nb[j], len(a)).astype("int64")
        for_b = np.bincount(j, na[i], len(b)).astype("int64")
        u, v = forest(a[i], b[j])
        return pd.concat(
            [
                pd.DataFrame({"node": a[for_a > 0], "other": a[for_a > 0], "links": for_a[for_a > 0]}),
                pd.DataFrame({"node": b[for_b > 0], "other": b[for_b > 0], "links": for_b[for_b > 0]}),
                pd.DataFrame({"node": u, "other": v, "links": np.zeros(len(u), "int64")}),
            ]
        )

    dealt = _dealt(_placed(reps, bits, cosine))
    found = steps.write(
        dealt.groupBy("kind", "tab", "cell", "hp", "vp").applyInPandas(compare, "node long, other long, links long")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")), steps)
    known = (
        reps.select("node", "n", "least")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            "node",
            "least",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("node", "n_links", "component_id")
    return rows.join(known, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
