"""Near duplicates among embeddings by product quantisation.

A vector belongs to the inverted list of its nearest coarse centroid, and its residual is coded by one codebook in
each subspace. Lists are numbered so that near ones have near numbers, and neighbouring lists form zones of about a block of
vectors. Every vector is sent to the zones that hold a list which it probes, and to no others; there its table of inner
products gives approximate cosines of all codes in a list, and survivors are compared exactly in double precision.
Equal vectors are compared once, with their number as a weight.

Nothing is lost on the way. A vector y lies nearer to its own centroid c than to the query's centroid q, so a query x
within distance r of y satisfies (|x-c|^2 - |x-q|^2) / (2|c-q|) <= r: all lists that pass are probed. And the approximate
cosine is off by at most y's coding error, which is stored and allowed for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .components import connected_components
from .vectors import k_means, one_per_id, packed, sampled, usable

#: Rows that the quantisers are fitted on: 40 for each list, within these bounds.
SAMPLE, MOST_SAMPLE = 20_000, 160_000
SUBSPACES = 16
CODES = 256
#: Vectors of one part of a zone, vectors sent to it that meet it in one task, and those whose lists are probed at a time.
BLOCK, ROUTED, STEP = 2048, 16_384, 2048
#: Rows up to which the tables of counts by label and of zones, some 40 bytes each, are broadcast.
BROADCAST_ROWS = 50_000
SLACK = 1e-7
#: Pairs whose exact cosines are worked out at a time.
PAIRS = 32_768


@dataclass(frozen=True)
class Quantiser:
    """At most MOST_SAMPLE / 40 centroids and SUBSPACES * CODES code vectors, whatever the table."""

    centroids: np.ndarray
    parts: tuple[np.ndarray, ...]
    books: tuple[np.ndarray, ...]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error (the distance to what the code stands for) of unit vectors."""
        cell = np.argmax(x @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2, axis=1)
        rest = x - self.centroids[cell]
        codes, error = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (part, book) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, m] = np.argmax(rest[:, part] @ book.T - (book**2).sum(axis=1) / 2, axis=1)
            error += ((rest[:, part] - book[codes[:, m]]) ** 2).sum(axis=1)
        return cell, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, cell: np.ndarray, radius: float, among: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which lists, of those in among, can hold a vector within radius: rows x lists."""
        lists, own = self.centroids[among], self.centroids[cell]
        square, own_square = (lists**2).sum(axis=1), (own**2).sum(axis=1)[:, None]
        apart = square - 2 * x @ lists.T - own_square + 2 * np.einsum("ij,ij->i", x, own)[:, None]
        between = np.sqrt(np.maximum(own_square - 2 * own @ lists.T + square, 0))
        return apart <= 2 * between * radius + SLACK

    def zone_level(self, rows: np.ndarray, block: int) -> np.ndarray:
        """For tables of so many rows: 2^level lists in a row form a zone of about a block."""
        lists = len(self.centroids)
        return np.clip(np.ceil(np.log2(block * lists / rows)), 0, lists.bit_length()).astype(np.int64)


def by_nearness(points: np.ndarray) -> np.ndarray:
    """The points in such an order that near ones come near each other: divided across the line between two far ones again and
    again, into parts whose first is a power of two, so that each zone is one such part."""
    if len(points) < 3:
        return points
    farthest = lambda p: points[np.argmax(((points - p) ** 2).sum(axis=1))]
    one = farthest(points.mean(axis=0))
    order = np.argsort(points @ (farthest(one) - one), kind="stable")
    first = 1 << ((len(points) - 1).bit_length() - 1)
    return np.concatenate([by_nearness(points[order[:first]]), by_nearness(points[order[first:]])])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, rows: float) -> Quantiser:
    """The square root of rows is the number of lists, as far as the sample bears it."""
    x = unit_rows(sample)
    centroids = by_nearness(k_means(x, max(1, min(int(np.ceil(np.sqrt(rows))), MOST_SAMPLE // 40, len(x) // 4))))
    rest = x - centroids[np.argmax(x @ centroids.T - (centroids**2).sum(axis=1) / 2, axis=1)]
    parts = tuple(np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1])))
    return Quantiser(centroids, parts, tuple(k_means(rest[:, p], max(1, min(CODES, len(x) // 8))) for p in parts))


class Quantisers(dict):
    """One for each length of vectors in the sample. A length that isn't in it has one list and one code, zero, for which the
    bounds still hold: all its pairs are compared exactly."""

    def __missing__(self, size: int) -> Quantiser:
        parts = tuple(np.array_split(np.arange(size), min(SUBSPACES, size)))
        return Quantiser(np.zeros((1, size)), parts, tuple(np.zeros((1, len(p))) for p in parts))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links (i, j) between labelled places; a label is the smallest place of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != label[label]).any():
            label = label[label]


def _compare(left: pd.DataFrame, right: pd.DataFrame, model: Quantiser, least: float) -> pd.DataFrame:
    """Links between vectors sent to a part of a zone and those that are there: how many each vector has, and one link to the
    smallest place of its local set. A vector of the part is among those sent, so links inside it are found from both ends."""
    right = right.sort_values("cell", kind="stable")
    ids = np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
    x, y, own = packed(left["unit"]), packed(right["unit"]), left["own"].to_numpy()
    codes = np.frombuffer(b"".join(bytes(c) for c in right["codes"]), np.uint8).reshape(len(right), -1)
    error, home = right["error"].to_numpy(), left["cell"].to_numpy()
    copies_x, copies_y = left["copies"].to_numpy(), right["copies"].to_numpy()
    lists, first = np.unique(right["cell"].to_numpy(), return_index=True)
    ends, radius = np.append(first[1:], len(y)), np.sqrt(2 - 2 * least)
    n_left, n_right, label = np.zeros(len(x)), np.zeros(len(y)), np.arange(len(ids))
    for start in range(0, len(x), STEP):
        probe = model.probes(x[start : start + STEP], home[start : start + STEP], radius, lists)
        for of, (cell, a, b) in enumerate(zip(lists, first, ends, strict=True)):
            queries = start + np.flatnonzero(probe[:, of])
            for at in range(0, len(queries), 256):
                q = queries[at : at + 256]
                near = (x[q] @ model.centroids[cell])[:, None] - least + error[None, a:b] + SLACK
                for m, (part, book) in enumerate(zip(model.parts, model.books, strict=True)):
                    near += (x[q][:, part] @ book.T)[:, codes[a:b, m]]
                i, j = np.nonzero(near >= 0)
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[q[i[k : k + PAIRS]]], y[a + j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS))])
                i, j = q[i[exact >= least]], a + j[exact >= least]
                apart = ids[i] != ids[len(x) + j]
                i, j = i[apart], j[apart]
                n_left += np.bincount(i, weights=copies_y[j], minlength=len(x))
                n_right += np.bincount(j, weights=np.where(own[i], 0, copies_x[i]), minlength=len(y))
                label = merged(label, i, len(x) + j)
    n, linked = np.concatenate([n_left, n_right]).astype(np.int64), np.flatnonzero(np.bincount(label, minlength=len(ids))[label] > 1)
    return pd.DataFrame({"rep": ids[linked], "n": n[linked], "to": ids[label[linked]]})


def link_near_duplicates(vectors: DataFrame, *, least: float = 0.93, sample: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vec_id of vectors (vec_id, embedding, label).

    Only vectors of the same label (not null) and length are compared. Vectors that are null, zero or hold null or
    non-finite components link with nothing, and neither do labels of one vector. Rows without vec_id are left out; of repeated
    ids the row that sorts first counts; more columns are ignored. The quantisers are fitted on at most `sample` rows (default: 40
    for each list, MOST_SAMPLE at most), every row is indexed, and recall doesn't depend on the fit.
    """
    rows = written(one_per_id(vectors, ["label", "embedding"]), "vectors")
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select("vec_id", "label", "embedding")
    alike = ["label", "size"]  # what two vectors must have in common to be compared
    distinct = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.withColumn("size", F.size("embedding")), "distinct")
    members = written(good.join(distinct, ["label", "embedding"]).select("vec_id", "rep"), "members")
    count = distinct.count()
    fitted = sampled(distinct.select(F.col("rep").alias("vec_id"), "embedding"), sample or int(min(max(SAMPLE, 40 * np.sqrt(count)), MOST_SAMPLE)))
    if not fitted:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = sum(map(len, fitted.values()))
    send = vectors.sparkSession.sparkContext.broadcast(Quantisers({n: fit(x, count * len(x) / drawn) for n, x in fitted.items()}))
    radius = float(np.sqrt(2 - 2 * least))
    label_type = dict(good.dtypes)["label"]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for size, frame in whole.groupby("size"):
                model, x = send.value[int(size)], unit_rows(np.array(frame["embedding"].tolist(), np.float64))
                cell, codes, error = model.encode(x)
                level, probe = model.zone_level(frame["rows"].to_numpy(), block), model.probes(x, cell, radius)
                zone = cell >> level
                to = [np.unique(np.flatnonzero(p) >> up) for p, up in zip(probe, level, strict=True)]
                yield pd.DataFrame({
                    "rep": frame["rep"], "copies": frame["copies"], "label": frame["label"], "size": np.int32(size), "cell": cell.astype(np.int32), "zone": zone.astype(np.int32),
                    "error": error, "unit": [r.tobytes() for r in x], "codes": [c.tobytes() for c in codes],
                    "to": [t[t >= z].astype(np.int32) for t, z in zip(to, zone, strict=True)],
                })

    small = lambda table: F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    tables = small(written(distinct.groupBy(*alike).agg(F.count(F.lit(1)).alias("rows")), "tables"))
    schema = f"rep long, copies long, label {label_type}, size int, cell int, zone int, error double, unit binary, codes binary, to array<int>"
    lists = written(distinct.join(tables, alike).select("rep", "copies", *alike, "embedding", "rows").mapInPandas(index, schema), "lists")
    held = lists.groupBy(*alike, "zone").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    sent = lists.select(*alike, F.explode("to").alias("zone")).groupBy(*alike, "zone").agg(F.count(F.lit(1)).alias("n"))
    zones = small(written(held.join(sent, [*alike, "zone"]), "zones").select(*alike, "zone", "parts", F.ceil(F.col("n") / ROUTED).alias("chunks")))
    keys = [*alike, "zone", "part", "chunk"]
    own_part, of_chunk = F.pmod(F.xxhash64("rep"), F.col("parts")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks"))
    there = lists.select("rep", "copies", *alike, "zone", "cell", "error", "unit", "codes").join(zones, [*alike, "zone"])
    right = there.withColumn("part", own_part).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    right = right.select(*keys, "rep", "copies", "cell", "error", "unit", "codes")
    right = right.toDF(*[f"{c}_there" for c in right.columns])
    routed = lists.select("rep", "copies", *alike, "cell", "unit", F.col("zone").alias("home"), F.explode("to").alias("zone")).join(zones, [*alike, "zone"])
    at_home, nowhere_earlier = F.col("home") == F.col("zone"), F.lit(0).cast("long")
    routed = routed.withColumn("part", F.explode(F.sequence(F.when(at_home, own_part).otherwise(nowhere_earlier), F.col("parts") - 1)))
    left = routed.withColumn("own", at_home & (F.col("part") == own_part)).withColumn("chunk", of_chunk).select(*keys, "rep", "copies", "cell", "unit", "own")

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "n": [], "to": []}).astype("int64")
        return _compare(a, b.rename(columns=lambda c: c.removesuffix("_there")), send.value[int(key[1])], least)

    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_there" for k in keys])).applyInPandas(compare, "rep long, n long, to long")
    partial = written(found, "partial")
    counts = partial.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(partial.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    n_links, component = F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.coalesce("component", "rep")
    of_reps = distinct.select("rep", "copies").join(counts, "rep", "left").join(components, "rep", "left").select("rep", n_links.alias("n_links"), component.alias("c"))
    out = rows.select("vec_id").join(members.join(of_reps, "rep"), "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) >= 0.93 END
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
