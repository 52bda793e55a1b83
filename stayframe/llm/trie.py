"""The trie of conversation prefixes.

Every first d turns of a conversation are a prefix, known by a digest of 128 bits: the exclusive or of its turns' digests, each of which holds
its place, so a prefix's parent is its digest without the last turn's. A count-min sketch of all prefixes screens them: an
estimate of one proves that no other conversation shares a prefix, and then none shares a longer one. Such tails are nodes
already, row by row. Only the prefixes that may be shared are shuffled and grouped exactly; what the sketch
takes for shared without need is found out there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, ship, written
from .textops import mixed

#: Turns that are numbered or summed up in one go; a longer conversation is dealt out in such segments.
SEGMENT = 1024
#: Counters of the sketch: rows of so many at most, of which a block travels together. A full sketch screens less, which changes no result.
ROWS, MOST_WIDTH, BLOCK = 3, 1 << 25, 1 << 15
#: Ids that are written into one piece of a node's list.
PIECE = 4096
NODE = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, n from 1, total, a and b: the digest of role and text, words) and conversations (conv_id, total).

    Turns follow each other by turn (null first), then role and text; null roles and texts count as empty. Rows without conv_id
    belong to no conversation.
    """
    said = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = said.withColumn("segment", F.floor(F.col("turn") / SEGMENT))
    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    digests = {"a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "text", "role"), "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")}
    ordered = placed.withColumns(digests).withColumn("n", F.row_number().over(inside)).drop("turn", "role", "text")
    sizes = placed.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("conv_id").orderBy("segment")
    before = F.coalesce(F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sizes = sizes.select(F.col("conv_id").alias("of"), F.col("segment").alias("of_segment"), before.alias("before"), total.alias("total"))
    joined = ordered.join(sizes, (F.col("conv_id") == F.col("of")) & F.col("segment").eqNullSafe(F.col("of_segment")))
    turns = joined.select("conv_id", (F.col("n") + F.col("before")).alias("n"), "total", "a", "b", "words")
    return turns, sizes.groupBy(F.col("of").alias("conv_id")).agg(F.max("total").alias("total"))


def prefixes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b: the prefix's digest, pa and pb: its parent's, words, last) for every prefix of the conversations convs
    (conv_id, total), the empty one included, from their turns (conv_id, n, total, a, b, words)."""
    own = turns.select(
        "conv_id", "n", "total", "words", F.floor((F.col("n") - 1) / SEGMENT).alias("segment"), F.xxhash64("n", "a", "b").alias("ta"), F.xxhash64("b", "a", "n").alias("tb")
    )
    so_far = Window.partitionBy("conv_id", "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({"a": F.bit_xor("ta").over(so_far), "b": F.bit_xor("tb").over(so_far)})
    earlier = Window.partitionBy("of").orderBy("of_segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(F.col("conv_id").alias("of"), F.col("segment").alias("of_segment")).agg(F.bit_xor("ta").alias("sa"), F.bit_xor("tb").alias("sb"))
    offsets = ends.select("of", "of_segment", F.bit_xor("sa").over(earlier).alias("oa"), F.bit_xor("sb").over(earlier).alias("ob")).where("of_segment > 0")
    full = run.join(offsets, (F.col("conv_id") == F.col("of")) & (F.col("segment") == F.col("of_segment")), "left")
    full = full.withColumns({"a": F.col("a").bitwiseXOR(F.coalesce("oa", F.lit(0))), "b": F.col("b").bitwiseXOR(F.coalesce("ob", F.lit(0)))})
    grown = full.select(
        "conv_id", F.col("n").cast("long").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("pa"), F.col("b").bitwiseXOR(F.col("tb")).alias("pb"), "words", (F.col("n") == F.col("total")).alias("last")
    )
    nothing = F.lit(0).cast("long")
    roots = convs.select("conv_id", nothing.alias("depth"), nothing.alias("a"), nothing.alias("b"), nothing.alias("pa"), nothing.alias("pb"), nothing.alias("words"), (F.col("total") == 0).alias("last"))
    return grown.unionByName(roots)


def _places(a: np.ndarray, b: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((mixed(a, row) ^ mixed(b, row + ROWS)) & np.uint64(width - 1)).astype(np.int64)


def crowded_counters(digests: DataFrame, width: int) -> np.ndarray:
    """The sketch of digests (a, b), as one bit for each counter: whether it counts two or more.

    Tasks count their own rows, in ROWS * width bytes; their counts (none, one, more) are added up block by block in as many tasks as
    Spark likes. The driver gets ROWS * width bits, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            for row in range(ROWS):
                at, times = np.unique(_places(a, b, row, width), return_counts=True)
                counts[row, at] = np.minimum(counts[row, at] + np.minimum(times, 2), 2)
        blocks = counts.reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)):
            bits = [np.packbits(blocks[i] >= k).tobytes() for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in bits)], ["block", "some", "more"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, some, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(some, np.uint8), np.frombuffer(more, np.uint8)
                if block in known:
                    x0, y0 = known[block]
                    x, y = x | x0, y | y0 | (x & x0)
                known[block] = x, y
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([y.tobytes() for _, y in known.values()], pa.binary())], ["block", "more"])

    counted = digests.select("a", "b").mapInArrow(count, "block int, some binary, more binary")
    bits = np.zeros((ROWS * width // BLOCK, BLOCK // 8), np.uint8)
    for block, more in counted.repartition("block").mapInArrow(add, "block int, more binary").collect():  # bounded, see above
        bits[block] = np.frombuffer(more, np.uint8)
    return bits.reshape(ROWS, -1)


def screened(prefixes: DataFrame, *, most_width: int = MOST_WIDTH) -> DataFrame:
    """prefixes with `alone` and `parent_alone`: whether the sketch proves that the prefix, or its parent, is one conversation's only. The
    empty prefix is never alone."""
    digests = prefixes.where("depth > 0")
    width, rows = BLOCK, digests.count()
    while width < min(8 * rows, most_width):
        width *= 2
    send = prefixes.sparkSession.sparkContext.broadcast(crowded_counters(digests, width))

    def one(a: pa.Array, b: pa.Array) -> pa.Array:
        bits, x, y = send.value, a.to_numpy(), b.to_numpy()
        crowded = np.ones(len(x), np.bool_)
        for row in range(ROWS):
            at = _places(x, y, row, width)
            crowded &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.bool_)
        return pa.array(~crowded)

    proven = F.arrow_udf(one, "boolean")
    return prefixes.withColumns({"alone": proven("a", "b") & (F.col("depth") > 0), "parent_alone": proven("pa", "pb") & (F.col("depth") > 1)})


def _hashed_lists(pieces: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from pieces (depth, a, b, piece, ids) of lists: hashed piece after piece, so a list of any length passes
    through a task that holds a piece of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == of:
                    digest.update(b"," + ids.encode())
                else:
                    done += [(*of, digest.hexdigest())] if of else []
                    of, digest = node, hashlib.sha256(ids.encode())
            yield _rows(done)
        yield _rows([(*of, digest.hexdigest())] if of else [])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _below(shared: DataFrame, weights: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens): sums of weights (conv_id, depth, leaf, saved) over each node's subtree.

    A weight belongs to its node's smallest member. Those of a subtree are, for each member, its own at this depth and beyond: a sum
    from the end of a conversation, taken segment by segment.
    """
    segment = F.floor(F.col("depth") / SEGMENT).alias("segment")
    nothing = F.lit(0).cast("long")
    rows = shared.select("conv_id", "depth", segment, "a", "b", nothing.alias("leaf"), nothing.alias("saved"), F.lit(True).alias("real"))
    own = weights.select("conv_id", "depth", segment, nothing.alias("a"), nothing.alias("b"), "leaf", "saved", F.lit(False).alias("real"))
    rest = Window.partitionBy("conv_id", "segment").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.unionByName(own).withColumns({"leaf": F.sum("leaf").over(rest), "saved": F.sum("saved").over(rest)}).where("real")
    later = Window.partitionBy("of").orderBy(F.desc("of_segment")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(F.col("conv_id").alias("of"), F.col("segment").alias("of_segment")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    # only conversations that go beyond one segment have sums to carry; one for each of their segments, with weights or without
    long = shared.select(F.col("conv_id").alias("of"), segment.alias("of_segment")).distinct().join(totals.where("of_segment > 0").select("of").distinct(), "of", "left_semi")
    carried = long.join(totals, ["of", "of_segment"], "left").unionByName(totals.join(long, ["of", "of_segment"], "left_anti").where("of_segment > 0"))
    spread = carried.select("of", "of_segment", F.sum("l").over(later).alias("ol"), F.sum("s").over(later).alias("os")).where("ol IS NOT NULL")
    full = summed.join(spread, (F.col("conv_id") == F.col("of")) & (F.col("segment") == F.col("of_segment")), "left")
    return full.groupBy(*NODE).agg(F.sum(F.col("leaf") + F.coalesce("ol", F.lit(0))).alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("os", F.lit(0))).alias("saved_tokens"))


def prefix_trie(turns: DataFrame, convs: DataFrame, *, most_width: int = MOST_WIDTH) -> DataFrame:
    """The nodes of the trie of conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that a shared prefix saves, over the subtree), ends_sha256 (hash of the list of members that end there).

    turns and convs are as numbered_turns gives them. No conversations: no nodes. A conversation without turns is a member of the
    root. The result is the same for any width of the sketch.
    """
    ship(convs.sparkSession)
    prefixes = written(prefixes_of(turns, convs), "prefixes")
    flagged = screened(prefixes, most_width=most_width)
    shared = written(flagged.where("NOT alone").drop("alone", "parent_alone"), "shared")
    alone = flagged.where("alone")
    heads = alone.where("NOT parent_alone")
    grouped = shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = written(grouped, "nodes")
    above = lambda df: df.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = above(nodes).unionByName(above(heads)).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    known = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known")
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    weights = known.select("conv_id", "depth", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).where("leaf > 0 OR saved > 0")
    tips = alone.where("last").select("conv_id", "depth", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = shared.where("last").groupBy(*NODE, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(listed.alias("ids"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    grown = known.join(_below(shared, weights.unionByName(tips)), NODE).join(_hashed_lists(pieces), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
    single = {
        "n_convs": F.lit(1).cast("long"), "n_children": F.when(F.col("last"), 0).otherwise(1).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nobody),
    }
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tails = alone.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id")).withColumns(single).select(*columns)
    placed = _with_parent(grown, nodes).select(*columns).unionByName(_with_parent(heads, nodes).withColumns(single).select(*columns))
    return placed.unionByName(tails)


def _with_parent(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id, looked up by (pa, pb). A parent that isn't in nodes was proven to be one conversation's only, so it is
    the row's own. The root, parent of all first turns, isn't looked up."""
    top = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = rows.where("depth > 1").join(parents, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    first = rows.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    return deep.unionByName(first)


def rebuilt(turns: DataFrame, convs: DataFrame, *, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of which each has its first h turns from the first conversation of its group of ids, h being
    crc32(conv_id) % most: all of them if that one has fewer, none if it doesn't exist."""
    conv = F.col("conv_id")
    base: Column = conv - conv % group
    h = F.crc32(conv.cast("string").cast("binary")) % most
    givers = convs.select(conv.alias("base"), F.col("total").alias("there"))
    lent = convs.select("conv_id", "total", base.alias("base"), h.alias("h")).join(givers, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    lent = lent.withColumn("length", F.greatest(F.col("total") - F.col("h"), F.lit(0)) + F.col("lent"))
    there = F.col("n") > h
    # how many were lent follows from the group's base alone, which most conversations share: looked up by conversation, a hot one is split by Spark
    own = turns.where(there).join(lent.select("conv_id", "lent", "length"), "conv_id").select("conv_id", (F.col("n") - h + F.col("lent")).alias("n"), F.col("length").alias("total"), "a", "b", "words")
    given = turns.where((F.col("n") < most) & (conv == base)).select(conv.alias("base"), "n", "a", "b", "words")
    borrowed = given.join(lent.select("conv_id", "base", "h", "length"), "base").where("n <= h").select("conv_id", "n", F.col("length").alias("total"), "a", "b", "words")
    return own.unionByName(borrowed), lent.select("conv_id", F.col("length").alias("total"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = numbered_turns(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    own = rebuilt(written(turns, "turns"), written(convs, "convs"))
    return prefix_trie(written(own[0], "rebuilt"), written(own[1], "lengths"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: xor(xor(x, y) >> 1, CASE WHEN xor(x, y) % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.n, k, text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h UNION ALL SELECT c.conv_id, t.n, k, text FROM c JOIN t USING (conv_id) WHERE t.n > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    count(*) OVER (PARTITION BY conv_id) AS total FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n)
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM p GROUP BY path, depth
), kids AS (SELECT path[1:(depth - 1) * 64] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, depth)),
below AS (
  SELECT p.path, p.depth, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved FROM p JOIN whole y ON y.conv_id = p.conv_id AND y.depth >= p.depth GROUP BY 1, 2
)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, coalesce(n_leaves, 0) AS n_leaves, coalesce(saved, 0)::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w LEFT JOIN below b ON b.path = w.path AND b.depth = w.depth LEFT JOIN nodes u ON u.depth = w.depth - 1 AND u.path = w.path[1:(w.depth - 1) * 64]
"""
