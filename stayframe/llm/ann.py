"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Rows are dealt into shards by a hash, and each shard builds its graph: a greedy search for each vector proposes
neighbours, pruning keeps an edge to a candidate unless an edge already kept leads there `relax` times closer, and
reverse edges are added and pruned alike. A beam search then answers each query on every shard, and the shards'
answers, scored exactly in double precision, are merged. One more coordinate turns the largest inner product into the
smallest distance.

Vectors of different lengths have no inner product, so each length has shards of its own. The size of a shard grows with the
table between two bounds, so that up to SHARDS * MOST_SHARD_ROWS vectors the number of shards that a query meets, and with it the
work for a query, hardly grows.

Graphs hold distinct vectors: equal ones would prune each other's edges. A found vector stands for all its ids, which a
table keeps in order, and is expanded to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .vectors import one_per_id, packed, usable

SHARD_ROWS, MOST_SHARD_ROWS, SHARDS = 4096, 65_536, 256
#: Queries that meet a shard in one task, about a large shard's rows, so that neither side is copied much more often than the other, and how many of
#: them are searched at a time.
QUERY_BLOCK, STEP = 65_536, 2048
#: Lengths up to which the table of shard counts, 16 bytes each, is broadcast.
BROADCAST_LENGTHS = 10_000
DEGREE = 24
BEAM = 64
SEARCH_BEAM = 96
RELAX = 1.2
ENTRIES = 64
TOGETHER = 256


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate that gives all the same length: nearest then means largest inner product."""
    square = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))])


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rows of x found for each query, nearest first, and all rows that the search expanded; -1: none."""
    b, rows = len(queries), np.arange(len(queries))
    square = (x * x).sum(axis=1)
    ids, dist = np.full((b, width), -1), np.full((b, width), np.inf)
    done, seen = np.ones((b, width), bool), np.zeros((b, len(x)), bool)
    start = square[entries] - 2 * queries @ x[entries].T
    order = np.argsort(start, axis=1, kind="stable")[:, :width]
    ids[:, : order.shape[1]], dist[:, : order.shape[1]] = entries[order], np.take_along_axis(start, order, axis=1)
    done[:, : order.shape[1]] = False
    seen[:, entries] = True
    path = []
    while len(rows):
        at = np.argmin(done[rows], axis=1)  # beams are sorted: the first that isn't expanded is the nearest
        some = ~done[rows, at]
        rows, at = rows[some], at[some]
        done[rows, at] = True
        path.append(np.full(b, -1))
        path[-1][rows] = ids[rows, at]
        near = edges[ids[rows, at]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        near = np.where(fresh, near, 0)
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        far = np.full(near.shape, np.inf)
        far[r, c] = square[near[r, c]] - 2 * np.einsum("ij,ij->i", x[near[r, c]], queries[rows[r]])
        all_dist = np.concatenate([dist[rows], far], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(all_dist, order, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1), order, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), order, axis=1)
    return ids, np.stack(path, axis=1)


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most `degree` diverse neighbours for each row in `of`, out of candidates (-1: none; repeated ones count once)."""
    candidates = np.sort(np.where(candidates == of[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates = np.sort(candidates, axis=1)
    candidates = candidates[:, min(int((candidates < 0).sum(axis=1).min(initial=candidates.shape[1])), candidates.shape[1] - 1) :]
    points = x[np.maximum(candidates, 0)]
    inner, square = points @ points.transpose(0, 2, 1), (points * points).sum(axis=2)
    dist = np.where(candidates >= 0, square - 2 * (points @ x[of][:, :, None])[:, :, 0] + (x[of] ** 2).sum(axis=1)[:, None], np.inf)
    alive, rows = candidates >= 0, np.arange(len(of))
    kept = np.full((len(of), degree), -1)
    for k in range(degree):
        best = np.argmin(np.where(alive, dist, np.inf), axis=1)
        some = alive[rows, best]
        if not some.any():
            break
        kept[some, k] = candidates[rows, best][some]
        alive[rows, best] = False
        between = square + square[rows, best][:, None] - 2 * inner[rows, best]
        alive &= ~(some[:, None] & (relax * relax * between <= dist))
    return kept


def build_graph(x: np.ndarray, *, degree: int = DEGREE, width: int = BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows x degree, -1 where fewer) and the entry rows: the one nearest the mean and some random ones."""
    n, rng = len(x), np.random.default_rng(seed)
    middle = np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))
    entries = np.union1d(middle, rng.choice(n, min(n, ENTRIES), replace=False))
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    for factor in (1.0, relax):
        order = rng.permutation(n)
        for at in range(0, n, TOGETHER):
            rows = order[at : at + TOGETHER]
            proposed = np.concatenate(beam_search(x, edges, x[rows], entries, width), axis=1)
            edges[rows] = robust_prune(x, rows, np.concatenate([proposed, edges[rows]], axis=1), degree, factor)
            to, source = edges[rows].ravel(), np.repeat(rows, degree)
            source, to = source[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            targets, first, count = np.unique(to[by], return_index=True, return_counts=True)
            for a in range(0, len(targets), TOGETHER):
                t, f, c = targets[a : a + TOGETHER], first[a : a + TOGETHER], count[a : a + TOGETHER]
                slot = np.arange(c.max())
                incoming = np.where(slot < c[:, None], source[by][np.minimum(f[:, None] + slot, len(by) - 1)], -1)
                edges[t] = robust_prune(x, t, np.concatenate([edges[t], incoming], axis=1), degree, factor)
    return edges, entries


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rep", kind="stable")
    x = lifted(packed(frame["vector"]))
    # single precision is enough for choosing edges; a shard that a beam holds whole needs none
    edges, entries = build_graph(x.astype(np.float32)) if len(x) > SEARCH_BEAM else (np.full((len(x), DEGREE), -1), np.zeros(0))
    return frame.assign(place=np.arange(len(x), dtype=np.int32), edges=[e.astype(np.int32).tobytes() for e in edges], entry=np.isin(np.arange(len(x)), entries))


def _answer(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 nearest distinct vectors of the shard for each query, by their smallest id: one may be the query's own."""
    if not len(index) or not len(queries):
        return pd.DataFrame({"query_id": [], "rep": [], "score": []}).astype({"query_id": "int64", "rep": "int64", "score": "float64"})
    index = index.sort_values("place")
    x, q, ids = packed(index["vector"]), packed(queries["vector"]), index["rep"].to_numpy()
    if len(x) > SEARCH_BEAM:
        edges = np.frombuffer(b"".join(bytes(e) for e in index["edges"]), np.int32).reshape(len(x), -1)
        entries, up = np.flatnonzero(index["entry"].to_numpy()), lifted(x)
        down = np.column_stack([q, np.zeros(len(q))])
    best = []
    for start in range(0, len(q), STEP):
        some = np.arange(start, min(start + STEP, len(q)))
        if len(x) > SEARCH_BEAM:
            found = np.concatenate([beam_search(up, edges, down[some[a : a + TOGETHER]], entries, SEARCH_BEAM)[0] for a in range(0, len(some), TOGETHER)])
        else:
            found = np.broadcast_to(np.arange(len(x)), (len(some), len(x)))
        row, col = np.nonzero(found >= 0)
        place, row = found[row, col], some[row]
        out = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "rep": ids[place], "score": np.einsum("ij,ij->i", q[row], x[place])})
        best.append(out.sort_values(["query_id", "score", "rep"], ascending=[True, False, True]).groupby("query_id").head(k + 1))
    return pd.concat(best)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, shard_rows: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors (vec_id, embedding) found for each of queries (vec_id,
    embedding), its own id left out; ties go to the smaller vec_id. More columns are ignored.

    A query is compared with vectors of its length. Vectors that are null, zero or hold null or non-finite components, and rows
    without vec_id, take no part on either side; of repeated ids the row that sorts first counts. With fewer than k
    candidates all are returned, and an empty table gives no rows. Every row is indexed; a shard's graph and a block of
    queries meet in one task, both of bounded size. shard_rows: rows of a shard (default: a 1/SHARDS of the table, within bounds).
    """

    def as_doubles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # -0.0 becomes 0.0, so that equal vectors have equal bytes
            yield frame.assign(vector=[(np.array(e, np.float64) + 0.0).tobytes() for e in frame["embedding"]])[["vec_id", "vector"]]

    pack = lambda df: df.where(usable(F.col("embedding"))).select("vec_id", "embedding").mapInPandas(as_doubles, "vec_id long, vector binary")
    size = (F.octet_length("vector") / 8).cast("int").alias("size")
    known = written(pack(one_per_id(vectors, ["embedding"])), "packed")
    distinct = written(known.groupBy("vector").agg(F.min("vec_id").alias("rep")).select("rep", "vector", size), "distinct")
    asked = written(pack(one_per_id(queries, ["embedding"])).select(F.col("vec_id").alias("query_id"), "vector", size), "queries")
    rows = F.lit(shard_rows) if shard_rows else F.least(F.greatest(F.ceil(F.col("n") / SHARDS), F.lit(SHARD_ROWS)), F.lit(MOST_SHARD_ROWS))
    counted = lambda df, per, name: df.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.ceil(F.col("n") / per).cast("int").alias(name))
    lengths = written(counted(distinct, rows, "shards").join(counted(asked, F.lit(query_block), "blocks"), "size"), "lengths")
    lengths = F.broadcast(lengths) if lengths.count() <= BROADCAST_LENGTHS else lengths
    dealt = distinct.join(lengths, "size").select("rep", "vector", "size", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"))
    index = written(dealt.groupBy("size", "shard").applyInPandas(_build, "rep long, vector binary, size int, shard int, place int, edges binary, entry boolean"), "graphs")
    # a vector's ids in order, so that a query's own id among them leaves k others
    in_order = Window.partitionBy("rep").orderBy("vec_id")
    members = known.join(distinct, "vector").select("rep", "vec_id").withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= k + 1)
    members = written(members.select("rep", "vec_id"), "members")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    units = asked.join(lengths, "size").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("shard", every("shards"))
    keys = ("size", "shard", "block")
    sides = index.join(lengths, "size").withColumn("block", every("blocks")).drop("blocks", "shards").groupBy(*keys).cogroup(units.drop("blocks", "shards").groupBy(*keys))
    found = sides.applyInPandas(lambda a, b: _answer(a, b, k), "query_id long, rep long, score double")
    by_rep = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = found.withColumn("rank", F.row_number().over(by_rep)).where(F.col("rank") <= k + 1).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    expanded = best.join(members, "rep").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return expanded.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
