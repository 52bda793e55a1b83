"""What the vector operators share: which vectors take part, and k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for vectors that aren't zero and hold only finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each vec_id that isn't null: of repeated ids the row that sorts first."""
    first = vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("row"))
    return first.select("vec_id", *[F.col("row")[c].alias(c) for c in columns])


def sampled(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """At most `most` rows of vectors (vec_id, embedding) in all, chosen by a hash of the id, as doubles by their length."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").toPandas()["embedding"]
    return {int(n): np.array(x.tolist(), np.float64) for n, x in rows.groupby(rows.map(len))}


def packed(column) -> np.ndarray:
    """Rows of doubles from a column of binary values."""
    data = b"".join(bytes(x) for x in column)
    return np.frombuffer(data, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres
