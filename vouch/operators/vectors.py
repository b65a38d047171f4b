"""Search, verification and calibration over tables of embedding vectors."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.functions.vectors import l2_normalized, vec_distance
from vouch.sources.scratch import written

#: Distance up to which two vectors of a model are of one person: fixed values.
THRESHOLDS = {
    "VGG-Face": {"cosine": 0.68, "euclidean": 1.17, "euclidean_l2": 1.17, "angular": 0.39},
    "Facenet": {"cosine": 0.40, "euclidean": 10, "euclidean_l2": 0.80, "angular": 0.33},
    "Facenet512": {"cosine": 0.30, "euclidean": 23.56, "euclidean_l2": 1.04, "angular": 0.35},
    "ArcFace": {"cosine": 0.68, "euclidean": 4.15, "euclidean_l2": 1.13, "angular": 0.39},
    "Dlib": {"cosine": 0.07, "euclidean": 0.6, "euclidean_l2": 0.4, "angular": 0.12},
    "SFace": {"cosine": 0.593, "euclidean": 10.734, "euclidean_l2": 1.055, "angular": 0.36},
    "OpenFace": {"cosine": 0.10, "euclidean": 0.55, "euclidean_l2": 0.55, "angular": 0.11},
    "DeepFace": {"cosine": 0.23, "euclidean": 64, "euclidean_l2": 0.64, "angular": 0.12},
    "DeepID": {"cosine": 0.015, "euclidean": 45, "euclidean_l2": 0.17, "angular": 0.04},
    "GhostFaceNet": {"cosine": 0.65, "euclidean": 35.71, "euclidean_l2": 1.10, "angular": 0.38},
    "Buffalo_L": {"cosine": 0.55, "euclidean": 0.6, "euclidean_l2": 1.1, "angular": 0.45},
}
#: Queries, and vectors of the store, of one cell of the grid in which both sides are compared.
QUERY_BLOCK, STORE_BLOCK = 4096, 4096
#: Distances of a cell that are in memory at once.
DISTANCES = 1 << 20
#: Queries of one cell where each pair becomes a row.
PAIR_QUERIES = 512


def verify_pairs(pairs: DataFrame, model: str, metric: str = "cosine") -> DataFrame:
    """Adds distance, threshold and verified to pairs with vectors a and b; a null vector is never verified."""
    threshold = float(THRESHOLDS[model][metric])
    distance = vec_distance(F.col("a"), F.col("b"), metric)
    return pairs.withColumn("distance", distance).withColumn("threshold", F.lit(threshold)).withColumn("verified", F.coalesce(F.col("distance") <= threshold, F.lit(False)))


def confidence(distance: Column, verified: Column, w: float, b: float, normalizer: float, true_range: tuple[float, float], false_range: tuple[float, float]) -> Column:
    """Calibrated confidence in percent: 51 to 100 for the same person, 0 to 49 for different ones.

    w and b are the logistic coefficients, the ranges are the confidences that occurred for each class.
    """
    raw = 100 / (1 + F.exp(-(w * (distance / normalizer if normalizer > 1 else distance) + b)))

    def moved(low: float, high: float, to_low: float, to_high: float) -> Column:
        return (raw - low) / (high - low) * (to_high - to_low) + to_low

    same = F.greatest(moved(*true_range, max(51.0, true_range[0]), 100.0), F.lit(51.0))
    other = F.least(moved(*false_range, 0.0, float(min(49, int(false_range[1])))), F.lit(49.0))
    return F.round(F.least(F.greatest(F.when(verified, same).otherwise(other), F.lit(0.0)), F.lit(100.0)), 2)


def plain_confidence(verified: Column) -> Column:
    """Confidence where a model or metric has no fitted coefficients: just above or just below the middle."""
    return F.when(verified, 51.0).otherwise(49.0)


def assert_dims(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Number of vectors of each length; more than one row means that lengths are mixed."""
    return df.groupBy(F.size(column).alias("dimensions")).agg(F.count(F.lit(1)).alias("vectors"))


def _cells(queries: DataFrame, store: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Both sides dealt into a grid of blocks, each row once for every cell of its row or column, and the number of cells.

    A cell has about `block` queries (QUERY_BLOCK) and STORE_BLOCK vectors, so any number of either is compared in tasks of one
    size, none of which passes through the driver.
    """
    rows = max(1, -(-queries.count() // (block or QUERY_BLOCK)))
    columns = max(1, -(-store.count() // STORE_BLOCK))
    along = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asked = queries.withColumn("cell", F.explode(F.transform(along(columns), lambda c: c + F.pmod(F.xxhash64("query_id"), F.lit(rows)) * columns)))
    held = store.withColumn("cell", F.explode(F.transform(along(rows), lambda r: r * columns + F.pmod(F.xxhash64("vec_id"), F.lit(columns)))))
    return asked, held, rows * columns


def _distances(queries: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries to all vectors by one matrix product, rounded; not finite where a zero vector has none."""
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    if metric in ("cosine", "angular"):
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - unit @ (x / length).T
        if metric == "angular":
            d = np.arccos(np.clip(1 - d, -1, 1)) / np.pi
    else:
        if metric == "euclidean_l2":
            x, queries = x / np.maximum(length, 1e-10), unit
        squares = (queries**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * queries @ x.T
        d = np.sqrt(np.maximum(squares, 0))
    return np.round(d, 6)


def compare(queries: DataFrame, store: DataFrame, reduce: Callable, schema: str, metric: str = "cosine", add: Callable | None = None, finish: Callable | None = None) -> DataFrame:
    """What reduce(d, queries, vectors) makes of each cell of the grid: d are the distances of its queries to its vectors.

    A cell's queries are taken some at a time, so that about DISTANCES distances are there at once. What reduce makes of
    them are rows; with `add` it is anything that add(a, b) puts together, and finish makes the cell's rows of it.
    queries has query_id, embedding and what else reduce reads, store vec_id and embedding. Null vectors and those of
    another length than the query's are left out; distances that do not exist are infinite.
    """
    usable = F.col("embedding").isNotNull()
    # New names for the columns of one side, as both may come from one table.
    asked, held, _ = _cells(queries.filter(usable), store.filter(usable).toDF(*store.columns))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        sizes, other = left["embedding"].map(len), right["embedding"].map(len)
        for size in sorted(set(sizes) & set(other)):
            q, v = left[sizes == size].reset_index(drop=True), right[other == size].reset_index(drop=True)
            x, step = np.stack(v["embedding"].to_numpy()).astype(float), max(1, DISTANCES // len(v))
            for a in range(0, len(q), step):
                some = q[a : a + step].reset_index(drop=True)
                d = _distances(np.stack(some["embedding"].to_numpy()).astype(float), x, metric)
                d[~np.isfinite(d)] = np.inf
                new = reduce(d, some, v)
                made = [add(made[0], new)] if add and made else [*made, new]
        if not made:
            return empty.copy()
        return finish(made[0]) if finish else pd.concat(made, ignore_index=True)

    empty = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
    return asked.groupBy("cell").cogroup(held.groupBy("cell")).applyInPandas(run, schema)


def search_exact(queries: DataFrame, store: DataFrame, metric: str = "cosine", threshold: float | None = None, k: int | None = None, others: bool = False, similarity: bool = False) -> DataFrame:
    """query_id, vec_id, distance and rank of the store's vectors within the threshold, or the k nearest of them.

    With `similarity` the threshold does not count: look-alikes are asked for, so k must be given. With `others` a
    vector of the query's own number is left out. Queries and store are compared in a grid of blocks; each cell
    gives at most k vectors of each query, ties included. Null vectors, those of another length and zero vectors
    under cosine are left out. Ties rank by vec_id.
    """
    if similarity and k is None:
        raise ValueError("a search for look-alikes needs k")
    limit = np.inf if threshold is None or similarity else threshold

    def nearest(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if others:
            d[q["query_id"].to_numpy()[:, None] == v["vec_id"].to_numpy()[None]] = np.inf
        keep = np.isfinite(d) & (d <= limit)
        if k is not None and d.shape[1] > k:
            # Of this cell only the k nearest of each query can be among the k nearest of all; ties stay.
            keep &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero(keep)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[a], "vec_id": v["vec_id"].to_numpy()[b], "distance": d[a, b]})

    found = compare(queries.select(F.col("query_id").cast("long"), "embedding"), store.select("vec_id", "embedding"), nearest, "query_id long, vec_id long, distance double", metric)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked


def match_counters(queries: DataFrame, store: DataFrame, matched: float, low: float) -> DataFrame:
    """For each query how many vectors there are, how many match (similarity from `matched` on), and how many nearly (from `low` on)."""

    def count(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        near, there = 1 - d, np.isfinite(d)
        rows = [there, there & (near >= matched), there & (near < matched) & (near >= low), there & (near < low)]
        return pd.DataFrame({"query_id": q["query_id"], **{n: r.sum(axis=1) for n, r in zip(("found", "matched", "low_confidence", "not_matched"), rows)}})

    names = ["found", "matched", "low_confidence", "not_matched"]
    cells = compare(queries, store, count, "query_id long, " + ", ".join(f"{n} long" for n in names))
    return cells.groupBy("query_id").agg(*[F.sum(n).alias(n) for n in names]).filter("found > 0")


def distance_counts(queries: DataFrame, store: DataFrame, decimals: int = 6) -> DataFrame:
    """distance, same and n: how many pairs lie at each distance, by whether their labels agree. Both sides have a label.

    Distances are rounded, so there are at most 2 x 10^decimals x 2 rows whatever the number of pairs.
    """

    scale = 10**decimals

    def count(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        same = q["label"].to_numpy()[:, None] == v["label"].to_numpy()[None]
        there = np.isfinite(d)
        # A cosine distance lies between 0 and 2.
        steps = np.clip(np.rint(d[there] * scale).astype(np.int64), 0, 2 * scale)
        return np.bincount(2 * steps + same[there], minlength=4 * scale + 2)

    def counted(n: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(n)
        return pd.DataFrame({"distance": at // 2 / scale, "same": at % 2 == 1, "n": n[at]})

    labelled = store.select("vec_id", "embedding", "label")
    asked = queries.select("query_id", "embedding", "label")
    cells = compare(asked, labelled, count, "distance double, same boolean, n long", add=lambda a, b: a + b, finish=counted)
    return cells.groupBy("distance", "same").agg(F.sum("n").alias("n"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest distances of each query, with their rank; ties by vec_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_match(queries: DataFrame, store: DataFrame, threshold: float) -> DataFrame:
    """For each query the newest vector within the threshold, how many were looked at until then, and the best similarity of those.

    store has vec_id, embedding and arrival; without a match all vectors were looked at. The newest match is found
    in one pass over the grid, what lies before it is counted in a second; neither lists the pairs.
    """

    def hit(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((v["vec_id"].to_numpy(), v["arrival"].to_numpy()))[::-1]
        within = d[:, order] <= threshold
        at, rows = order[within.argmax(axis=1)], np.flatnonzero(within.any(axis=1))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "arrival": v["arrival"].to_numpy()[at[rows]], "vec_id": v["vec_id"].to_numpy()[at[rows]]})

    def before(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        arrival, number = v["arrival"].to_numpy()[None], v["vec_id"].to_numpy()[None]
        stop, last = q["stop"].to_numpy()[:, None], q["last"].to_numpy()[:, None]
        seen = np.isfinite(d) & ((arrival > stop) | ((arrival == stop) & (number >= last)))
        return pd.DataFrame({"query_id": q["query_id"], "checked": seen.sum(axis=1), "nearest": np.where(seen, d, np.inf).min(axis=1)})

    first = compare(queries, store, hit, "query_id long, arrival long, vec_id long").groupBy("query_id").agg(F.max(F.struct("arrival", "vec_id")).alias("m"))
    none = F.lit(-(2**63))
    asked = queries.join(first, "query_id", "left").select("query_id", "embedding", F.coalesce("m.arrival", none).alias("stop"), F.coalesce("m.vec_id", none).alias("last"))
    seen = compare(asked, store, before, "query_id long, checked long, nearest double").groupBy("query_id").agg(F.sum("checked").alias("checked"), F.min("nearest").alias("nearest")).filter("checked > 0")
    return seen.join(first, "query_id", "left").select("query_id", F.col("m.vec_id").alias("vec_id"), "checked", F.round(1 - F.col("nearest"), 4).alias("best_similarity"))


def newest(df: DataFrame, n: int, key: str = "identity") -> DataFrame:
    """The n newest vectors of each identity, by arrival."""
    order = Window.partitionBy(key).orderBy(F.desc("arrival"), F.desc("vec_id"))
    return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


#: Vectors that pivots and directions are taken from at most, and pivots.
FITTED_ROWS, PIVOTS = 20_000, 64


class Space(NamedTuple):
    """Pivots, unit vectors around which others lie, and directions in the order of the variance along them, as columns."""

    pivots: np.ndarray
    directions: np.ndarray


def sampled_units(store: DataFrame, bound: int) -> np.ndarray:
    """Unit vectors of at most `bound` rows, those of the least hashes of vec_id, as long as the first of them."""
    usable = store.filter("embedding is not null").select("vec_id", l2_normalized(F.col("embedding").cast("array<double>")).alias("unit"))
    rows = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).toPandas()
    return np.stack([u for u in rows["unit"] if len(u) == len(rows["unit"].iloc[0])]) if len(rows) else np.zeros((0, 1))


def k_means(x: np.ndarray, cells: int, rng: np.random.Generator, unit: bool, rounds: int = 15) -> np.ndarray:
    """Centres of x; with `unit` of unit vectors, by the angle, and unit vectors themselves."""
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = (x @ centres.T - (0 if unit else (centres**2).sum(axis=1) / 2)).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))[:, None]
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if unit else n
        centres = np.where((n > 0) & (size > 0), sums / np.maximum(size, 1e-300), centres)
    return centres


def fit_space(faces: DataFrame, pivots: int, bound: int = FITTED_ROWS, seed: int = 5) -> Space:
    """Pivots by k-means and directions by the principal axes of at most `bound` vectors; neither changes what a join finds."""
    units = sampled_units(faces, bound)
    if not len(units):
        return Space(np.zeros((0, 1)), np.eye(1))
    _, axes = np.linalg.eigh(np.cov(units.T) if units.shape[1] > 1 and len(units) > 1 else np.eye(units.shape[1]))
    return Space(k_means(units, pivots, np.random.default_rng(seed), True), axes[:, ::-1])


def near_units(x: np.ndarray, y: np.ndarray, least: float, directions: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of unit vectors, by number, whose inner product is `least` or more, and the multiplications that it took.

    Products are summed up along the directions of most variance first. What the rest can add is at most the product
    of both rests' lengths (Cauchy-Schwarz); pairs that cannot reach `least` any more are dropped after each step. A
    pair that may is kept, with a margin for rounding, so the caller's exact check decides.
    """
    x, y = x @ directions, y @ directions
    cuts = np.linspace(0, x.shape[1], min(steps, x.shape[1]) + 1).astype(int)
    rests = [np.sqrt(np.cumsum((z**2)[:, ::-1], axis=1)[:, ::-1]) for z in (x, y)]
    rests = [np.c_[r, np.zeros(len(r))] for r in rests]
    sums, pairs, work = np.zeros((len(x), len(y))), None, 0
    for low, high in zip(cuts[:-1], cuts[1:]):
        if pairs is None:
            sums += x[:, low:high] @ y[:, low:high].T
            work += sums.size * (high - low)
            alive = sums + rests[0][:, high, None] * rests[1][None, :, high] >= least - 1e-7
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                part = sums[pairs]
        else:
            i, j = pairs
            part = part + np.einsum("ij,ij->i", x[i, low:high], y[j, low:high])
            work += len(i) * (high - low)
            keep = part + rests[0][i, high] * rests[1][j, high] >= least - 1e-7
            pairs, part = (i[keep], j[keep]), part[keep]
    i, j = pairs if pairs is not None else np.nonzero(alive)
    return i, j, work


def dealt_blocks(faces: DataFrame, space: Space, block: int) -> DataFrame:
    """faces with cell (the nearest pivot, -1 for vectors of another length), angle to it, and part: blocks of about `block` vectors of a model and pivot."""
    shared = faces.sparkSession.sparkContext.broadcast(space.pivots)

    def run(frames):
        pivots = shared.value
        for frame in frames:
            cell, angle = np.full(len(frame), -1, dtype=np.int32), np.full(len(frame), np.pi)
            same = np.array([len(v) == pivots.shape[1] for v in frame["embedding"]], dtype=bool) & (len(pivots) > 0)
            if same.any():
                x = np.stack(frame["embedding"][same].to_numpy()).astype(float)
                near = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ pivots.T
                cell[same], angle[same] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield frame.assign(cell=cell, angle=angle)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in faces.schema.fields)
    placed = faces.filter("embedding is not null").mapInPandas(run, f"{fields}, cell int, angle double")
    sizes = placed.groupBy("model", "cell", "fresh").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    # As many rows as models times pivots.
    return placed.join(F.broadcast(sizes), ["model", "cell", "fresh"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")


def block_pairs(dealt: DataFrame, space: Space, threshold: float) -> DataFrame:
    """Pairs of blocks of one model that may hold a pair within the threshold and are not both of old vectors, each once, with their numbers of vectors.

    By the triangle inequality of angles, vectors of two blocks are at least the angle of the pivots, less both
    blocks' widest angles, apart.
    """
    blocks = dealt.groupBy("model", "cell", "part", "fresh").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    a, b = (blocks.select("model", *[F.col(c).alias(f"{c}_{side}") for c in ("cell", "part", "fresh", "n", "radius")]) for side in "ab")
    once = F.struct("fresh_a", "cell_a", "part_a") <= F.struct("fresh_b", "cell_b", "part_b")
    pairs = a.join(b, "model").filter(once & (F.col("fresh_a") | F.col("fresh_b")))
    gaps = np.arccos(np.clip(space.pivots @ space.pivots.T, -1, 1))
    far = dealt.sparkSession.createDataFrame([(i, j, float(gaps[i, j])) for i in range(len(gaps)) for j in range(len(gaps)) if i != j], "cell_a int, cell_b int, gap double")
    widest = float(np.arccos(np.clip(1 - threshold, -1, 1))) + 1e-6
    gap = F.coalesce("gap", F.lit(0.0))  # of one pivot, or of vectors of another length
    return pairs.join(F.broadcast(far), ["cell_a", "cell_b"], "left").filter(gap - F.col("radius_a") - F.col("radius_b") <= widest)


def similar_pairs(faces: DataFrame, threshold: float, block: int = QUERY_BLOCK, space: Space | None = None) -> DataFrame:
    """Pairs of vectors of one model and different identities whose cosine distance is below the threshold: vec_a, vec_b, distance, fresh_a, fresh_b.

    faces has vec_id, identity, model, fresh and embedding; pairs of two that are not fresh are left out. An exact join:
    vectors are dealt into blocks by their nearest pivot, pairs of blocks that lie too far apart are dropped as a
    whole, and in the others a pair is dropped as soon as the dimensions summed up so far rule it out. Each pair
    is given once, the smaller vec_id first. Null vectors and zero vectors have no distance.
    """
    space = space or fit_space(faces, min(PIVOTS, max(1, faces.count() // block)))
    dealt = dealt_blocks(faces.select("vec_id", "identity", "model", "fresh", "embedding"), space, block)
    pairs = block_pairs(dealt, space, threshold).drop("n_a", "n_b", "radius_a", "radius_b", "gap")
    cell = ["model", *[f"{c}_{side}" for side in "ab" for c in ("fresh", "cell", "part")]]

    def side(s: str) -> DataFrame:
        rows = dealt.select("model", *[F.col(c).alias(f"{c}_{s}") for c in ("fresh", "cell", "part")], "vec_id", "identity", "embedding")
        rows = pairs.join(rows, ["model", f"fresh_{s}", f"cell_{s}", f"part_{s}"])
        return rows.toDF(*rows.columns)  # new names, as both sides come from one table

    shared = faces.sparkSession.sparkContext.broadcast(space.directions)
    empty = pd.DataFrame({"vec_a": np.zeros(0, np.int64), "vec_b": np.zeros(0, np.int64), "distance": np.zeros(0), "fresh_a": np.zeros(0, bool), "fresh_b": np.zeros(0, bool)})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = [empty]
        if a.empty or b.empty:
            return empty
        head = a.iloc[0]
        alone = (head["fresh_a"], head["cell_a"], head["part_a"]) == (head["fresh_b"], head["cell_b"], head["part_b"])
        long_a, long_b = a["embedding"].map(len), b["embedding"].map(len)
        for size in set(long_a) & set(long_b):
            x, y = a[long_a == size], b[long_b == size]
            u, v = (np.stack(z["embedding"].to_numpy()).astype(float) for z in (x, y))
            nu, nv = (np.linalg.norm(z, axis=1) for z in (u, v))
            x, u, nu, y, v, nv = x[nu > 0], u[nu > 0], nu[nu > 0], y[nv > 0], v[nv > 0], nv[nv > 0]
            if not len(u) or not len(v):
                continue
            axes = shared.value if len(shared.value) == size else np.eye(size)
            u, v = u / nu[:, None], v / nv[:, None]
            i, j, _ = near_units(u, v, 1 - threshold, axes)
            d = np.round(1 - np.einsum("ij,ij->i", u[i], v[j]), 6)
            ids, others = x["vec_id"].to_numpy()[i], y["vec_id"].to_numpy()[j]
            # In a block with itself each pair comes twice.
            keep = (d < threshold) & (x["identity"].to_numpy()[i] != y["identity"].to_numpy()[j]) & ((ids < others) if alone else (ids != others))
            ids, others, d = ids[keep], others[keep], d[keep]
            less = ids < others
            made.append(pd.DataFrame({"vec_a": np.minimum(ids, others), "vec_b": np.maximum(ids, others), "distance": d, "fresh_a": np.where(less, head["fresh_a"], head["fresh_b"]), "fresh_b": np.where(less, head["fresh_b"], head["fresh_a"])}))
        return pd.concat(made, ignore_index=True).astype(empty.dtypes)

    return side("a").groupBy(*cell).cogroup(side("b").groupBy(*cell)).applyInPandas(run, "vec_a long, vec_b long, distance double, fresh_a boolean, fresh_b boolean")


def duplicate_identities(faces: DataFrame, threshold: float = 0.4, block: int = QUERY_BLOCK) -> DataFrame:
    """Pairs of vectors of one model and different identities whose cosine distance is below the threshold: vec_a, vec_b, distance; see similar_pairs."""
    return similar_pairs(faces.withColumn("fresh", F.lit(True)), threshold, block).select("vec_a", "vec_b", "distance")


def checked_faces(faces: DataFrame, new: DataFrame, threshold: float = 0.4, block: int = QUERY_BLOCK, rounds: int = 1000) -> DataFrame:
    """Every new vector with what comes of it: vec_id, status (accepted, invalid, known, duplicate), of, distance.

    faces and new have vec_id, identity, model and embedding; new vectors come in the order of vec_id. One without
    values, or whose first 20 are all zero, is invalid; one whose vec_id is there is known; one below the threshold of
    a vector of its model and another identity, there or accepted before it, is a duplicate of the nearest such vector. The
    join is of the new vectors with all, never of the store with itself; what new ones do to each other is settled in
    rounds, as many as there are links in a chain of them.
    """
    columns = ["vec_id", "identity", "model", "embedding"]
    coming = new.select(*columns)
    zero = F.forall(F.slice("embedding", 1, 20), lambda v: F.abs(v) < 1e-10)
    told = coming.join(faces.select("vec_id", F.lit(True).alias("there")).distinct(), "vec_id", "left")
    invalid = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.coalesce(zero, F.lit(True))
    told = told.select("vec_id", F.when(invalid, "invalid").when(F.col("there"), "known").alias("status"))
    usable = coming.join(told.filter("status is null").select("vec_id"), "vec_id", "left_semi").withColumn("fresh", F.lit(True))
    pairs = written(similar_pairs(faces.select(*columns).withColumn("fresh", F.lit(False)).unionByName(usable), threshold, block), "faces-near")
    nearest = F.min(F.struct("distance", "of"))
    by_store = pairs.filter("fresh_a <> fresh_b").select(F.when(F.col("fresh_a"), F.col("vec_a")).otherwise(F.col("vec_b")).alias("vec_id"), F.when(F.col("fresh_a"), F.col("vec_b")).otherwise(F.col("vec_a")).alias("of"), "distance")
    out = written(by_store.select("vec_id").distinct(), "faces-out")
    # Links from an earlier new vector to a later one; those of rejected vectors do not count.
    links = pairs.filter("fresh_a and fresh_b").select(F.col("vec_a").alias("of"), F.col("vec_b").alias("vec_id"), "distance")
    left = written(links.join(out, "vec_id", "left_anti").join(out.select(F.col("vec_id").alias("of")), "of", "left_anti"), "faces-left")
    lost = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        # An earlier vector that no undecided link leads to is accepted, and those that it leads to are not.
        gone = left.join(left.select(F.col("vec_id").alias("of")).distinct(), "of", "left_anti").select("vec_id").distinct()
        gone = written(gone, "faces-gone")
        lost = gone if lost is None else lost.unionByName(gone)
        left = written(left.join(gone, "vec_id", "left_anti").join(gone.select(F.col("vec_id").alias("of")), "of", "left_anti"), "faces-left")
    else:
        raise RuntimeError(f"new vectors are not settled in {rounds} rounds")
    rejected = out if lost is None else out.unionByName(lost)
    accepted = links.join(rejected.select(F.col("vec_id").alias("of")), "of", "left_anti")
    dup = by_store.unionByName(accepted.select(by_store.columns)).groupBy("vec_id").agg(nearest.alias("near")).select("vec_id", "near.of", "near.distance")
    return told.join(dup, "vec_id", "left").select("vec_id", F.coalesce("status", F.when(F.col("of").isNotNull(), "duplicate"), F.lit("accepted")).alias("status"), "of", "distance")


def append_faces(faces: DataFrame, new: DataFrame, checked: DataFrame) -> DataFrame:
    """faces with the new vectors that checked_faces has accepted; write its result first, as it is read once more."""
    return faces.unionByName(new.join(checked.filter("status = 'accepted'").select("vec_id"), "vec_id", "left_semi"), allowMissingColumns=True)


def nearest_face(queries: DataFrame, store: DataFrame, threshold: float, scope: str = "any") -> DataFrame:
    """The nearest vector of the query's own model: query_id, vec_id, identity, distance, matched (below the threshold).

    queries has query_id, identity, model and embedding, store has vec_id, identity, model and embedding. The scope is
    `any` identity, the query's `own` one, as for a second picture of a known person, or `others`, as for a
    duplicate. A vector of the query's own number is left out. A query without a vector in its scope is not in the result.
    """
    if scope not in ("any", "own", "others"):
        raise ValueError(f"no scope {scope!r}")

    def nearest(d: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        d[q["model"].to_numpy()[:, None] != v["model"].to_numpy()[None]] = np.inf
        d[q["query_id"].to_numpy()[:, None] == v["vec_id"].to_numpy()[None]] = np.inf
        if scope != "any":
            same = q["identity"].to_numpy()[:, None] == v["identity"].to_numpy()[None]
            d[same if scope == "others" else ~same] = np.inf
        order = np.argsort(v["vec_id"].to_numpy(), kind="stable")
        at = order[d[:, order].argmin(axis=1)]
        rows = np.flatnonzero(np.isfinite(d[np.arange(len(q)), at]))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "vec_id": v["vec_id"].to_numpy()[at[rows]], "identity": v["identity"].to_numpy()[at[rows]], "distance": d[rows, at[rows]]})

    kind = store.schema["identity"].dataType.simpleString()
    cells = compare(queries.select("query_id", "identity", "model", "embedding"), store.select("vec_id", "identity", "model", "embedding"), nearest, f"query_id long, vec_id long, identity {kind}, distance double")
    best = cells.groupBy("query_id").agg(F.min(F.struct("distance", "vec_id", "identity")).alias("best"))
    return best.select("query_id", "best.vec_id", "best.identity", "best.distance", (F.col("best.distance") < threshold).alias("matched"))


class Index(NamedTuple):
    """Centres of lists, unit vectors, and the books of codes: for each stretch of dimensions 256 values or fewer."""

    centres: np.ndarray
    books: np.ndarray


def fit_index(store: DataFrame, cells: int = 64, each: int = 2, bound: int = FITTED_ROWS, seed: int = 3) -> Index:
    """Lists and codes of `each` dimensions a byte, fitted on at most `bound` vectors; every vector is indexed by them.

    Vectors of another length than the first have no list. Codes are of what is left of a unit vector without its centre.
    """
    units = sampled_units(store, bound)
    if not len(units):
        return Index(np.zeros((0, 1)), np.zeros((1, 1, each)))
    rng = np.random.default_rng(seed)
    centres = k_means(units, cells, rng, True)
    rest = _stretches(units - centres[(units @ centres.T).argmax(axis=1)], each)
    books = [k_means(rest[:, m], 256, rng, False, 10) for m in range(rest.shape[1])]
    return Index(centres, np.stack(books))


def _stretches(x: np.ndarray, each: int) -> np.ndarray:
    """Vectors cut into stretches of dimensions, the last filled up with zeros."""
    full = -(-x.shape[1] // each) * each
    return np.pad(x, ((0, 0), (0, full - x.shape[1]))).reshape(len(x), -1, each)


def _usable(frame: pd.DataFrame, centres: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows whose vectors are as long as the centres and not zero, and these as unit vectors."""
    frame = frame[np.array([len(v) == centres.shape[1] for v in frame["embedding"]], dtype=bool) & (len(centres) > 0)]
    if frame.empty:
        return frame, np.zeros((0, centres.shape[1]))
    x = np.stack(frame["embedding"].to_numpy()).astype(float)
    size = np.linalg.norm(x, axis=1)
    return frame[size > 0], x[size > 0] / size[size > 0, None]


def build_index(store: DataFrame, index: Index, table: DataFrame | None = None) -> DataFrame:
    """vec_id, cell and code (a byte for each stretch) of each vector that the index table lacks; append it to the table."""
    if table is not None:
        store = store.join(table.select("vec_id").distinct(), "vec_id", "left_anti")
    shared = store.sparkSession.sparkContext.broadcast(index)

    def run(frames):
        centres, books = shared.value
        for frame in frames:
            frame, x = _usable(frame, centres)
            own = (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            rest = _stretches(x - centres[own], books.shape[2]) if len(x) else np.zeros((0, *books.shape[::2]))
            codes = np.stack([(rest[:, m] @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for m, b in enumerate(books)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy(), "cell": own.astype(np.int32), "code": [c.tobytes() for c in codes]})

    return store.select("vec_id", "embedding").filter("embedding is not null").mapInPandas(run, "vec_id long, cell int, code binary")


def search_candidates(queries: DataFrame, table: DataFrame, index: Index, most: int, probes: int = 8) -> DataFrame:
    """query_id and vec_id of the `most` vectors that come nearest by their codes, of the query's `probes` nearest lists.

    A list is dealt into parts of STORE_BLOCK codes at most, about, and the queries into parts of QUERY_BLOCK, so a
    task's work is bounded whatever the store. For each query a table holds its products with all values of the books; a
    vector's estimate is the sum of the entries that its code names. Of each part only the best `most` go on.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)
    rows = max(1, -(-queries.count() // QUERY_BLOCK))

    def near(frames):
        centres, _ = shared.value
        for frame in frames:
            frame, x = _usable(frame, centres)
            at = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, 0), np.int64)
            each = at.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(frame["query_id"].to_numpy(), each), "cell": at.ravel().astype(np.int32), "unit": [u for u in x for _ in range(each)]})

    # As many rows as there are lists.
    parts = F.broadcast(table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / STORE_BLOCK).cast("int").alias("parts")))
    along = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = queries.select("query_id", "embedding").filter("embedding is not null").mapInPandas(near, "query_id long, cell int, unit array<double>")
    asked = asked.join(parts, "cell").withColumn("part", along(F.col("parts"))).withColumn("row", F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")).drop("parts")
    held = table.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("row", along(F.lit(rows))).drop("parts")

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "near": np.zeros(0)})]
        if len(q) and len(v):
            centres, books = shared.value
            codes = np.frombuffer(b"".join(v["code"]), dtype=np.uint8).reshape(len(v), -1)
            units, ids = np.stack(q["unit"].to_numpy()), q["query_id"].to_numpy()
            for a in range(0, len(q), 256):
                cut = units[a : a + 256]
                table = np.einsum("qmd,mcd->qmc", _stretches(cut, books.shape[2]), books)
                near = np.repeat((cut @ centres[v["cell"].iloc[0]])[:, None], len(v), axis=1)
                for m in range(codes.shape[1]):
                    near += table[:, m, codes[:, m]]
                keep = np.argpartition(-near, most - 1, axis=1)[:, :most] if len(v) > most else np.tile(np.arange(len(v)), (len(cut), 1))
                made.append(pd.DataFrame({"query_id": np.repeat(ids[a : a + 256], keep.shape[1]), "vec_id": v["vec_id"].to_numpy()[keep.ravel()], "near": np.take_along_axis(near, keep, axis=1).ravel()}))
        return pd.concat(made, ignore_index=True)

    cell = ["cell", "part", "row"]
    found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(run, "query_id long, vec_id long, near double")
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")))
    return ranked.filter(F.col("nth") <= most).select("query_id", "vec_id")


def search_ann(queries: DataFrame, store: DataFrame, table: DataFrame, index: Index, k: int, probes: int = 8, rerank: int = 3) -> DataFrame:
    """About the k nearest by cosine: query_id, vec_id, distance, rank, of the `rerank` times k vectors that codes tell as nearest.

    Only for these are whole vectors read, and the distances given are theirs.
    """
    near = search_candidates(queries, table, index, rerank * k, probes)
    both = near.join(store.select("vec_id", F.col("embedding").alias("b")), "vec_id").join(queries.select("query_id", F.col("embedding").alias("a")), "query_id")
    return top_k(both.select("query_id", "vec_id", vec_distance(F.col("a"), F.col("b")).alias("distance")), k)


def make_pairs(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Every stated query (query_id, label) with every vector (vec_id, label) but itself: vec_a, vec_b, and whether the labels agree.

    A pair of two queries is given once, the smaller number first. Both sides are dealt into a grid of blocks.
    """
    asks = queries.select(F.col("query_id").alias("vec_id"), F.lit(True).alias("asks"))
    told = store.select("vec_id", F.col("label").alias("label_b")).join(asks, "vec_id", "left")
    asked, held, cells = _cells(queries.select("query_id", F.col("label").alias("label_a")), told, PAIR_QUERIES)
    # Rows are few and pairs many: a stated number of partitions is not drawn together by their bytes.
    both = asked.repartition(cells, "cell").join(held.repartition(cells, "cell").hint("shuffle_hash"), "cell")
    once = (F.col("query_id") != F.col("vec_id")) & (F.col("asks").isNull() | (F.col("query_id") < F.col("vec_id")))
    return both.filter(once).select(F.col("query_id").alias("vec_a"), F.col("vec_id").alias("vec_b"), (F.col("label_a") == F.col("label_b")).alias("same"))


def _weighed(pairs: DataFrame) -> DataFrame:
    """Pairs with n, how many each row stands for; 1 where the column is not there."""
    return pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1))


def fit_confidence(pairs: DataFrame) -> DataFrame:
    """One row: w and b of a logistic fit of `same` on the distance, and the least and greatest fitted confidence of each class.

    pairs has distance and same, and may have n, how many pairs a row stands for.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["distance"], outputCol="features").transform(_weighed(pairs).withColumn("label", F.col("same").cast("double")).withColumn("weight", F.col("n").cast("double")))
    total = data.agg(F.sum("weight")).first()[0] or 1.0
    model = LogisticRegression(regParam=1.0 / total, standardization=False, maxIter=100, weightCol="weight").fit(data)
    w, b = float(model.coefficients[0]), float(model.intercept)
    fitted = pairs.withColumn("c", 100 / (1 + F.exp(-(w * F.col("distance") + b))))
    ends = [f(F.when(F.col("same") == s, F.col("c"))).alias(n) for n, f, s in (("min_true", F.min, True), ("max_true", F.max, True), ("min_false", F.min, False), ("max_false", F.max, False))]
    return fitted.agg(*ends).select(F.lit(w).alias("w"), F.lit(b).alias("b"), "*")


def best_threshold(pairs: DataFrame) -> DataFrame:
    """Threshold and accuracy of the best cut of `distance` between the class means: one row threshold, accuracy.

    pairs has distance and same, and may have n, how many pairs a row stands for. Counts at each distinct distance
    are summed up in order, in place of a scan for each candidate.
    """
    pairs = _weighed(pairs)
    of = lambda cond: F.sum(F.when(cond, F.col("n")))
    mean = lambda cond: F.sum(F.when(cond, F.col("distance") * F.col("n"))) / of(cond)
    means = pairs.agg(mean(F.col("same")).alias("lo"), mean(~F.col("same")).alias("hi"), F.coalesce(of(~F.col("same")), F.lit(0)).alias("negatives"), F.sum("n").alias("pairs"))
    steps = pairs.groupBy("distance").agg(F.coalesce(of(F.col("same")), F.lit(0)).alias("t"), F.coalesce(of(~F.col("same")), F.lit(0)).alias("f"))
    running = running_counts(steps, "distance", ["t", "f"])
    # The class means are one row.
    scored = running.crossJoin(F.broadcast(means)).filter(F.col("distance").between(F.col("lo"), F.col("hi")))
    accuracy = (F.col("cum_t") + F.col("negatives") - F.col("cum_f")) / F.col("pairs")
    best = scored.select(F.round(accuracy, 6).alias("accuracy"), F.col("distance").alias("threshold"))
    return best.orderBy(F.desc("accuracy"), "threshold").limit(1)


#: Rows of one range of a running sum, about.
RANGE_ROWS = 200_000


def running_counts(df: DataFrame, order: str, columns: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """Adds cum_<column>, the sums up to each row in order of a distinct numeric key, without one task for all rows.

    Rows are dealt by ranges of the key, whose bounds are quantiles; sums of whole ranges, one row each, are
    added to those inside a range. The range is a function of the key, so a recomputed part is dealt alike. There are
    as many ranges as it takes for RANGE_ROWS in each.
    """
    parts = parts or max(8, -(-df.count() // RANGE_ROWS))
    key = F.col(order).desc() if descending else F.col(order).asc()
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("part", part)
    sums = dealt.groupBy("part").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    before = Window.orderBy(F.col("part").desc() if descending else F.col("part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("part", *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in columns])
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(carried), "part").withColumns({f"cum_{c}": F.col(f"b_{c}") + F.sum(c).over(inside) for c in columns})
    return summed.drop("part", *[f"b_{c}" for c in columns])
