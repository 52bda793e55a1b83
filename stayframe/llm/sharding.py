"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group, and a group stays whole. Groups that weigh a noticeable part of a
shard are items of their own; the others are gathered by hash into bundles. Both counts are bounded by
parameters, whatever the number of rows, so the packing itself handles a short list: items by falling size,
each placed where the dot product of its vector with the shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digits_for, ranked, read_table, row_digest, written

SHARDS = 8
BUNDLES = 8192
#: A group is an item of its own from 1/(shards * FINENESS) of any total.
FINENESS = 1024
DIMENSIONS = ("bytes", "tokens", "rows")


def document_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, group): narrow rows; a null text has size 1, no tokens and crc 0.

    Tokens are the words between ASCII white space."""
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.size(F.array_remove(F.split(blank, " "), "")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("group"),
    )


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of vectors (items x dimensions), which is in the order of placing."""
    totals = vectors.sum(axis=0)
    scaled = vectors / np.where(totals > 0, totals, 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    placed = np.empty(len(vectors), dtype=np.int32)
    for n, v in enumerate(scaled):
        placed[n] = best = int(np.argmax(residual @ v))
        residual[best] -= v
    return placed


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, bundles: int = BUNDLES, fineness: int = FINENESS, seed: str = "shard") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) for every row of docs (doc_id, text).

    Equal texts share a shard, all null texts too. slot counts from 0 without gaps in each shard, in the order
    of md5 of seed and doc_id (of the text, where doc_id is null). Repeated rows are all kept, each with a slot. An empty
    table gives no rows; other columns of docs are ignored. If one group outweighs a shard, it stays whole and sizes can't be
    equal. At most 3 * shards * fineness + bundles items reach the driver. Texts are read once.
    """
    rows = written(document_vectors(docs), "vectors")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    totals = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    limits = {d: totals[d] / (shards * fineness) for d in DIMENSIONS}
    # a row weighs more than the limit in small tables: then sizes decide, and rows only where they stand out
    own = (F.col("bytes") > limits["bytes"]) | (F.col("tokens") > limits["tokens"]) | (F.col("rows") > max(1.0, limits["rows"]))
    item = F.when(own, F.struct(F.lit(True).alias("own"), F.col("group").alias("id"))).otherwise(
        F.struct(F.lit(False).alias("own"), F.pmod(F.col("group"), F.lit(bundles)).alias("id"))
    )
    items = groups.groupBy(item.alias("item")).agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).select("item.own", "item.id", *DIMENSIONS).toPandas()
    weight = sum(items[d] / max(1, totals[d]) for d in DIMENSIONS)
    items = items.assign(weight=weight).sort_values(["weight", "own", "id"], ascending=[False, True, True])
    items["shard"] = pack(items[list(DIMENSIONS)].to_numpy(dtype=float), shards)
    spark = docs.sparkSession
    own_items, bundle_items = (items[items["own"] == x] for x in (True, False))
    own_shards = spark.createDataFrame(own_items[["id", "shard"]].values.tolist(), "group long, __own int")
    bundle_shards = spark.createDataFrame(bundle_items[["id", "shard"]].values.tolist(), "__bundle long, __bundled int")
    # both tables are within the bound above
    placed = (
        rows.join(F.broadcast(own_shards), "group", "left")
        .withColumn("__bundle", F.pmod("group", F.lit(bundles)))
        .join(F.broadcast(bundle_shards), "__bundle", "left")
        .withColumn("shard", F.coalesce("__own", "__bundled"))
        .withColumn("__digest", row_digest(seed, F.col("doc_id"), F.col("group")))
    )
    slim = placed.select("doc_id", "size", "tokens", "text_crc32", "shard", "__digest")
    slots = ranked(slim, "shard", "__digest", ["doc_id", "text_crc32", "size"], digits=digits_for(int(totals["rows"]) // shards))
    return slots.select("doc_id", "size", "tokens", "text_crc32", "shard", F.col("__rank").cast("long").alias("slot"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
