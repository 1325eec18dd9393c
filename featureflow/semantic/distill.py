"""sem_distill (Q13): a small representative set of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.operators.sampling import hash_top_n
from featureflow.operators.windows import running
from featureflow.session import stage, with_package


def quotas(df: DataFrame, n: int, strata: list[str]) -> DataFrame:
    """(strata..., quota): proportional shares that add up to exactly n (or to all rows)."""
    sizes = stage(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_c")).withColumn("_one", F.lit(1)))
    total = sizes.agg(F.sum("_c")).first()[0] or 0
    n = min(n, total)
    cum = running(sizes, ["_one"], strata, {"_cum": ("sum", "_c")})
    upto = F.floor(F.col("_cum") * n / total + 0.5)
    before = F.floor((F.col("_cum") - F.col("_c")) * n / total + 0.5)
    return cum.select(*strata, (upto - before).alias("_quota"))


class SemDistill:
    """method="hash": stratified sample of exactly n rows in seeded key order.
    method="kmeans": the row nearest to each of at most n centres of the numeric columns; rows with a missing
    one stand aside. Centres come from a small weighted sample and are then moved by all rows.
    """

    def __init__(self, n: int, key: str, strata: list[str] | None = None, method: str = "hash", seed: int = 0,
                 features: list[str] | None = None):
        if method not in ("hash", "kmeans"):
            raise ValueError("method must be 'hash' or 'kmeans'")
        self.n, self.key, self.strata, self.method, self.seed = n, key, list(strata or []), method, seed
        self.features = list(features or [])

    def distill(self, df: DataFrame) -> DataFrame:
        return self._hash(df) if self.method == "hash" else self._kmeans(df)

    def _hash(self, df: DataFrame) -> DataFrame:
        if not self.strata:
            return hash_top_n(df, self.n, self.key, self.seed)
        q = stage(quotas(df, self.n, self.strata)).select(
            *[F.col(s).alias(f"_s_{s}") for s in self.strata], "_quota"
        )
        cond = None
        for s in self.strata:
            e = F.col(s).eqNullSafe(F.col(f"_s_{s}"))
            cond = e if cond is None else cond & e
        with_q = df.join(q, cond).drop(*[f"_s_{s}" for s in self.strata])
        return hash_top_n(with_q, "_quota", self.key, self.seed, self.strata).drop("_quota")

    def _kmeans(self, df: DataFrame) -> DataFrame:
        point = F.array(*[F.col(c).cast("double") for c in self.features])
        rows = df.withColumn("_point", point).where(~F.exists("_point", lambda x: x.isNull() | F.isnan(x)))
        centres = coreset_centres(rows.select("_point"), self.n, self.seed)
        for _ in range(POLISH):
            centres = moved_centres(rows.select("_point"), centres)
        if not len(centres):
            return df.limit(0)
        near = rows.withColumn("_near", _nearest(centres)).groupBy("_near.c").agg(
            F.min_by(F.struct(*df.columns), F.struct("_near.gap", F.col(self.key).alias("k"))).alias("_r")
        )
        return near.select("_r.*")


#: Points of a coreset per centre, and full passes that move the centres found on it.
POINTS_PER_CENTRE = 200
POLISH = 2


def _nearest(centres: np.ndarray) -> Column:
    """(gap, c): squared distance and number of the nearest centre of `_point`; the first of equal ones."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    gap = lambda c: F.aggregate(F.zip_with("_point", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(table, lambda c, i: F.struct(gap(c).alias("gap"), i.alias("c"))))


def moved_centres(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the points nearest to each centre: one pass over all points, a row per centre."""
    if not len(centres):
        return centres
    means = [F.avg(F.col("_point")[i]).alias(f"m{i}") for i in range(centres.shape[1])]
    found = points.withColumn("_c", _nearest(centres)["c"]).groupBy("_c").agg(*means).orderBy("_c").collect()
    return np.array([[r[f"m{i}"] for i in range(centres.shape[1])] for r in found])


def coreset_centres(points: DataFrame, k: int, seed: int = 0, size: int | None = None) -> np.ndarray:
    """At most k centres of the array column `_point`, found on a weighted sample that stands for all points.

    A task holds two buffers' worth of points: a full buffer is cut down to `size` points, drawn by their share of
    the squared distance to rough centres and of their cluster, with weights that keep all
    sums the same on average. Samples of tasks are merged and cut down in the same way, so that the driver gets one
    of `size` points, whatever the number of rows.
    """
    size = size or POINTS_PER_CENTRE * k
    kind = "_point array<double>, w double"
    here = with_package(points.withColumn("w", F.lit(1.0))).mapInArrow(_cut_down(k, size, seed), kind)
    some = here.repartition(max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)).mapInArrow(_cut_down(k, size, seed + 1), kind)
    rows = some.coalesce(1).mapInArrow(_cut_down(k, size, seed + 2), kind).collect()
    if not rows:
        return np.zeros((0, 0))
    x, w = np.array([r["_point"] for r in rows]), np.array([r["w"] for r in rows])
    order = np.lexsort(x.T)
    return _best_centres(x[order], w[order], k, np.random.default_rng(seed))


def _seeded(x: np.ndarray, w: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    """Rough centres: points drawn one by one by their weighted squared distance to those drawn before."""
    gap = np.full(len(x), np.inf)
    picked = [int(rnd.choice(len(x), p=w / w.sum()))]
    for _ in range(1, min(k, len(x))):
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        if not (total := (w * gap).sum()) > 0:
            break
        picked.append(int(rnd.choice(len(x), p=w * gap / total)))
    return x[picked]


def _gaps(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for i, c in enumerate(centres):
        gap = ((x - c) ** 2).sum(axis=1)
        at = np.where(gap < best, i, at)
        best = np.minimum(best, gap)
    return best, at


def _best_centres(x: np.ndarray, w: np.ndarray, k: int, rnd: np.random.Generator, tries: int = 8, steps: int = 30) -> np.ndarray:
    """Weighted k-means of a small sample: the cheapest of several starts."""
    found = None
    for _ in range(tries):
        centres = _seeded(x, w, k, rnd)
        for _ in range(steps):
            _, at = _gaps(x, centres)
            mass = np.bincount(at, weights=w, minlength=len(centres))
            moved = np.stack([np.bincount(at, weights=w * x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
            centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        cost = float((w * _gaps(x, centres)[0]).sum())
        if found is None or cost < found[0]:
            found = cost, centres
    return found[1][np.lexsort(found[1].T)]


def _cut_down(k: int, size: int, seed: int) -> Callable:
    def less(x: np.ndarray, w: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        gap, at = _gaps(x, _seeded(x, w, k, rnd))
        total = (w * gap).sum()
        mass = np.bincount(at, weights=w)
        share = (w * gap / total if total > 0 else 0.0) + w / mass[at] / len(mass)
        share = share / share.sum()
        picked, times = np.unique(rnd.choice(len(x), size, p=share), return_counts=True)
        return x[picked], w[picked] / share[picked] * times / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, weights, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * size):
                part = batch.slice(lo, 4 * size)
                held.append(np.stack(part.column(0).to_numpy(zero_copy_only=False)).astype(float))
                weights.append(part.column(1).to_numpy())
                n += part.num_rows
                if n > 4 * size:
                    x, w = less(np.concatenate(held), np.concatenate(weights), rnd)
                    held, weights, n = [x], [w], len(x)
        if n:
            x, w = np.concatenate(held), np.concatenate(weights)
            if n > size:
                x, w = less(x, w, rnd)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(w)], ["_point", "w"])

    return run
