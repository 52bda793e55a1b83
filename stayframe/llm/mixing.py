"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, in a seeded order, are cut into blocks of about `block_bytes`. With a target share
of a/Q, block j (from 0) of a source is released at slot floor(j*Q/a) and due before slot ceil((j+1)*Q/a).
Earliest deadline first among released blocks fills every slot, and at any slot each source is less than one
block away from its target (until a source has run out). Shares are whole numbers of quanta, so the schedule
repeats every Q slots: the pattern of one period is found once, and a block's slot follows from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digits_for, quoted, ranked, read_table, row_digest, written

QUANTA = 1000
BLOCK_BYTES = 64 * 1024
NO_SOURCE = ""
#: Parts that the schedule splits priorities into at once.
SPLIT = 32
#: Slots of a period up to which its schedule is broadcast: 24 bytes and a name each, 2 MB or so.
BROADCAST_SLOTS = 50_000


def tempered_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights (source, weight) in proportion to each source's bytes to a power below 1, so that small
    sources are raised and large ones lowered. A null source counts as the source named ''."""
    return (
        docs.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), _size(F.col("text")).alias("bytes"))
        .groupBy("source")
        .agg(F.pow(F.sum("bytes").cast("double"), F.lit(power)).alias("weight"))
    )


def _size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def quanta_plan(weights: DataFrame, quanta: int = QUANTA) -> DataFrame:
    """(source, a, q): whole quanta by largest remainder, at least one for each source, q in all.

    q is `quanta` or 100 for each source if that is more, so rounding moves a share by 1 % at most. The
    rows are as many as the sources.
    """
    everyone = Window.partitionBy(F.lit(0))
    sized = (
        weights.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"))
        .agg(F.sum("weight").alias("weight"))
        .where(F.col("weight") > 0)
        .withColumns({"k": F.count(F.lit(1)).over(everyone), "all": F.sum("weight").over(everyone)})
        .withColumn("q", F.greatest(F.lit(quanta), F.col("k") * 100))
        .withColumn("exact", F.col("weight") / F.col("all") * (F.col("q") - F.col("k")))
        .withColumn("base", F.floor("exact"))
        .withColumn("spare", F.col("q") - F.col("k") - F.sum("base").over(everyone))
    )
    by_remainder = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("base")), "source")
    extra = (F.row_number().over(by_remainder) <= F.col("spare")).cast("long")
    return sized.select("source", (F.col("base") + 1 + extra).alias("a"), "q")


def edf_pattern(plan: DataFrame) -> DataFrame:
    """(source, a, q, occurrence, turn): the slots of one period of the earliest-deadline-first schedule.

    Ties of deadlines go to the source that sorts first. Blocks of unit length have a fixed priority, by deadline and source, and the
    slots that the blocks of a first part of the priorities take together don't depend on the order among them: dealt out by
    release, each takes the later of its release and the slot after the one before it. So priorities are split into SPLIT parts, the slots of the
    first part, the first two and so on are found side by side, and what a part adds are its own slots. Releases are
    counted in these, and each part is split again, until a part is one block with one slot. That takes log(q) / log(SPLIT) rounds of three
    windows over q * SPLIT / 2 rows, which tasks share, however many sources there are.
    """
    digits, reach = 1, SPLIT
    period = plan.agg(F.max("q")).first()[0] or 1
    while reach < period:
        digits, reach = digits + 1, reach * SPLIT
    nth = plan.withColumn("occurrence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)))
    due = nth.withColumn("due", F.expr("(occurrence * q + q + a - 1) div a"))
    by_priority = Window.partitionBy(F.lit(0)).orderBy("due", "source")  # a sort of q rows
    block = F.struct("source", "a", "q", "occurrence")
    blocks = due.select((F.row_number().over(by_priority) - 1).cast("long").alias("priority"), F.expr("(occurrence * q) div a").alias("place"), block.alias("block"))
    none = {"priority": F.lit(None).cast("long"), "block": F.lit(None).cast(blocks.schema["block"].dataType)}
    slots = blocks.select(F.col("priority").alias("place"), F.col("priority").alias("turn")).withColumns(none)  # every slot of the period is taken
    rows = blocks.withColumn("turn", F.lit(None).cast("long")).unionByName(slots).withColumn("node", F.lit(0).cast("long"))
    is_slot = F.col("turn").isNotNull()
    for _ in range(digits):
        reach //= SPLIT
        part = F.when(~is_slot, F.expr(f"CAST(priority div {reach} % {SPLIT} AS int)")).otherwise(-1)
        first_parts = F.explode(F.when(is_slot, F.array(F.lit(-1))).otherwise(F.sequence("part", F.lit(SPLIT - 1)))).alias("upto")
        spread = rows.withColumn("part", part).select("*", first_parts).withColumn("block", F.when(F.col("part") == F.col("upto"), F.col("block")))
        by_release = Window.partitionBy("node", "upto").orderBy("place")
        queued = spread.withColumn("queue", F.row_number().over(by_release) - 1)
        latest = F.max(F.col("place") - F.col("queue")).over(by_release.rowsBetween(Window.unboundedPreceding, 0))
        taken = queued.withColumn("takes", F.when(is_slot, F.col("place")).otherwise(F.col("queue") + latest))
        owner = F.min(F.when(~is_slot, F.col("upto"))).over(Window.partitionBy("node", "takes"))
        owned = taken.withColumn("owner", owner).where(is_slot | (F.col("part") == F.col("upto")))
        deeper = owned.withColumn("node", F.col("node") * SPLIT + F.when(is_slot, F.col("owner")).otherwise(F.col("part")))
        earlier = Window.partitionBy("node").orderBy("place", is_slot).rowsBetween(Window.unboundedPreceding, -1)
        counted = F.coalesce(F.sum(is_slot.cast("long")).over(earlier), F.lit(0).cast("long"))
        rows = deeper.withColumn("place", counted).select("node", "priority", "place", "turn", "block")
    found = rows.groupBy("node").agg(F.max("block").alias("block"), F.max("turn").alias("turn"))
    return found.select("block.source", "block.a", "block.q", "block.occurrence", "turn")


def mix_sources(docs: DataFrame, weights: DataFrame, *, quanta: int = QUANTA, block_bytes: int = BLOCK_BYTES, seed: str = "mix", prefix: str = "mix_") -> DataFrame:
    """docs (doc_id, text, source, more columns) with `mix_block`, `mix_release`, `mix_deadline`, `mix_slot`,
    `mix_rank` (order inside the source), `mix_share`; reading by (mix_slot, mix_rank) is the mixture.

    Every row stays, once. Sources without a positive weight come after the mixture (mix_slot null). A null source is the source ''; null
    and empty texts have size 1. Order inside a source: md5 of seed and doc_id (of the text, where doc_id is null), then doc_id
    and text, so equal rows may swap places with each other only. An empty table gives no rows. Columns of the input whose names begin with the prefix are replaced.
    """
    names = [c for c in docs.columns if not c.startswith(prefix)]
    inside = {c: f"__c{i}" for i, c in enumerate(names)}  # no name of the input can clash with those used here
    plain = docs.select(*[quoted(c).alias(inside[c]) for c in names])
    doc_id, text, source = (F.col(inside[c]) for c in ("doc_id", "text", "source"))
    keyed = plain.withColumns(
        {
            "__source": F.coalesce(source, F.lit(NO_SOURCE)),
            "__digest": row_digest(seed, doc_id, F.xxhash64(text)),
            "__size": _size(text),
            "__text": F.xxhash64(text),
        }
    )
    in_order = ranked(keyed, "__source", "__digest", [inside["doc_id"], "__size", "__text"], size="__size", digits=digits_for(docs.count()))
    blocks = in_order.withColumn("__block", F.floor(F.col("__before") / block_bytes))
    pattern = written(edf_pattern(quanta_plan(weights, quanta)), "pattern")
    small = F.broadcast if pattern.count() <= BROADCAST_SLOTS else (lambda df: df)  # beyond it, Spark joins by shuffling
    shares = pattern.select("source", "a", "q").distinct().withColumnsRenamed({"source": "__source", "a": "__a", "q": "__q"})
    turns = pattern.select(F.col("source").alias("__source"), F.col("occurrence").alias("__occurrence"), F.col("turn").alias("__turn"))
    with_share = blocks.join(small(shares), "__source", "left").withColumn("__occurrence", F.expr("__block % __a"))
    with_turn = with_share.join(small(turns), ["__source", "__occurrence"], "left")
    added = {
        "block": F.col("__block"),
        "release": F.expr("(__block * __q) div __a"),
        "deadline": F.expr("(__block * __q + __q + __a - 1) div __a"),
        "slot": F.expr("(__block div __a) * __q + __turn"),
        "rank": F.col("__rank").cast("long"),
        "share": F.col("__a") / F.col("__q"),
    }
    return with_turn.select(*[F.col(inside[c]).alias(c) for c in names], *[v.alias(f"{prefix}{k}") for k, v in added.items()])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, tempered_weights(docs))
    return mixed.select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank", F.round("mix_share", 9).alias("mix_share"))


OP8_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(source, '') AS src, coalesce(strlen(text), 0) + 1 AS size, md5('mix:' || doc_id) AS digest FROM documents
), weights AS (SELECT src, sqrt(sum(size)) AS w FROM sized GROUP BY src
), q AS (SELECT greatest({QUANTA}, count(*) * 100)::BIGINT AS q, count(*) AS k, sum(w) AS total FROM weights
), based AS (SELECT src, w / total * (q - k) AS exact, floor(w / total * (q - k))::BIGINT AS base, q, k FROM weights, q
), plan AS (
  SELECT src, q, base + 1 + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, src) <= q - k - sum(base) OVER () THEN 1 ELSE 0 END AS a,
         row_number() OVER (ORDER BY src) AS i FROM based
), p AS (SELECT list(a::BIGINT ORDER BY i) AS a, max(q) AS q, count(*) AS k FROM plan
), fold AS (
  SELECT 0::BIGINT AS t, list_transform(range(k), lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS nth FROM p
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, j: CASE WHEN j = c THEN v + 1 ELSE v END), c, done[c] FROM (
    SELECT fold.t, fold.done, (SELECT arg_min(x.i, (x.due * 100000 + x.i)) FROM (
        SELECT i, ((done[i] * p.q + p.q + p.a[i] - 1) // p.a[i]) AS due FROM unnest(range(1, p.k + 1)) u(i)
        WHERE done[i] < p.a[i] AND (done[i] * p.q) // p.a[i] <= fold.t) x) AS c
    FROM fold, p WHERE fold.t < p.q)
), turns AS (SELECT t - 1 AS turn, pick AS i, nth FROM fold WHERE t > 0
), blocks AS (
  SELECT doc_id, source, src,
         (sum(size) OVER w - size)::BIGINT // {BLOCK_BYTES} AS mix_block, row_number() OVER w - 1 AS mix_rank
  FROM sized WINDOW w AS (PARTITION BY src ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)
)
SELECT b.doc_id, b.source, b.mix_block::BIGINT AS mix_block, ((b.mix_block * p.q) // p.a)::BIGINT AS mix_release,
       ((b.mix_block * p.q + p.q + p.a - 1) // p.a)::BIGINT AS mix_deadline,
       ((b.mix_block // p.a) * p.q + t.turn)::BIGINT AS mix_slot, b.mix_rank::BIGINT AS mix_rank, round(p.a::DOUBLE / p.q, 9) AS mix_share
FROM blocks b JOIN plan p USING (src) JOIN turns t ON t.i = p.i AND t.nth = b.mix_block % p.a
"""
