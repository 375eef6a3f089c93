"""Codebooks over latent vectors: nearest code, margins, batch sums, k-means, moving averages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions.quantize import distance2, normalised


def assign(rows: DataFrame, codebook: DataFrame, cosine: bool = False, digits: int | None = None) -> DataFrame:
    """rows (with z) and state, the nearest code, ties to the lowest; and margin, how much further the second is.

    The codebook (state, vec; tens of rows) is one broadcast array, so that a row meets it within one expression.
    """
    book = codebook.select("state", (normalised(F.col("vec")) if cosine else F.col("vec")).alias("vec"))
    book = book.agg(F.sort_array(F.collect_list(F.struct("state", "vec"))).alias("_book"))
    z = normalised(F.col("z")) if cosine else F.col("z")
    near = lambda c: F.struct((distance2(F.col("_z"), c.vec) if digits is None else F.round(distance2(F.col("_z"), c.vec), digits)).alias("d2"), c.state.alias("state"))
    out = rows.withColumn("_z", z).crossJoin(F.broadcast(book)).withColumn("_near", F.array_sort(F.transform("_book", near)))
    gap = F.sqrt(F.get("_near", F.lit(1)).d2) - F.sqrt(F.get("_near", F.lit(0)).d2)
    return out.select(*rows.columns, F.get("_near", F.lit(0)).state.alias("state"), gap.alias("margin"))


def batch_sums(rows: DataFrame, width: int) -> DataFrame:
    """state, n, sums of z by component."""
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("z", F.lit(k))) for k in range(width))).alias("sums"))


def kmeans(rows: DataFrame, k: int, seed: int, cosine: bool = False) -> DataFrame:
    """state, vec: Spark's k-means over z; fewer rows than k give as many centres as rows, padded by repeating them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    z = normalised(F.col("z")) if cosine else F.col("z")
    data = rows.select(array_to_vector(z).alias("features"))
    n = data.limit(k).count()
    if not n:
        return rows.sparkSession.createDataFrame([], "state int, vec array<double>")
    centres = [c.tolist() for c in KMeans(k=min(k, n), seed=seed, maxIter=20).fit(data).clusterCenters()] if n > 1 else [data.first()["features"].toArray().tolist()]
    padded = [centres[i % len(centres)] for i in range(k)]
    return rows.sparkSession.createDataFrame(list(enumerate(padded)), "state int, vec array<double>")


class MovingAverage:
    """A codebook kept by exponential moving averages of batches, on the unit sphere unless normalize is false."""

    def __init__(self, codes: np.ndarray, decay: float = 0.99, warm_up: int = 500, dead: float = 1.0, eps: float = 1e-5, seed: int = 0, normalize: bool = True):
        self.normalize = normalize
        self.codes = self._scaled(codes)
        self.counts, self.sums = np.ones(len(codes)), self.codes.copy()
        self.decay, self.warm_up, self.dead, self.eps, self.step = decay, warm_up, dead, eps, 0
        self.rng = np.random.default_rng(seed)

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) if self.normalize else z

    def nearest(self, z: np.ndarray) -> np.ndarray:
        unit = self._scaled(z)
        return ((self.codes**2).sum(1) - 2 * unit @ self.codes.T).argmin(1)

    def update(self, z: np.ndarray) -> np.ndarray:
        """The batch's states; the codes then move, and dead codes restart at rows of the batch."""
        unit = self._scaled(z)
        states, k = self.nearest(z), len(self.codes)
        sums = np.zeros_like(self.sums)
        np.add.at(sums, states, unit)
        self.counts = self.decay * self.counts + (1 - self.decay) * np.bincount(states, minlength=k)
        self.sums = self.decay * self.sums + (1 - self.decay) * sums
        total = self.counts.sum()
        smooth = (self.counts + self.eps) / (total + k * self.eps) * total
        self.codes = self._scaled(self.sums / smooth[:, None])
        self.step += 1
        if self.step > self.warm_up and (gone := np.flatnonzero(self.counts < self.dead)).size:
            self.codes[gone] = unit[self.rng.integers(0, len(unit), gone.size)]
            self.sums[gone], self.counts[gone] = self.codes[gone], 1.0
        return states
