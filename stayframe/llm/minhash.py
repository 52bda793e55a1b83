"""Near-duplicate documents by ProbMinHash over weighted shingles of five words, banding and exact verification.

Equal texts are one class from the start. Each shingle of a text is a Poisson process whose rate is its weight; every
arrival falls into one of the signature's registers, and a register keeps the shingle that arrives first. An element is
dropped as soon as its next arrival comes after all registers' times. Registers of two texts agree with the probability
Jaccard similarity of their weighted shingles. Texts that agree in a whole band share a bucket. A text with repeated
shingles has a second signature, in which every shingle weighs the same, for the similarity of the sets.

Buckets are compared exactly, in blocks of bounded size, by tasks that return links between sets they have joined and
not pairs. Bands are taken in groups: what earlier groups have joined into one class isn't compared again. In a large
bucket every block is compared with the first one, which joins what is alike; at the end, blocks are compared
with each other as far as they hold texts of different classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_in, read_table, written
from .components import connected_components
from .embedding_dedup import merged
from .textops import mixed, sliced, sorted_counts, unit_interval, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 5 registers: a pair at 0.8 shares no band with a probability of 0.00007.
BANDS, ROWS = 24, 5
BAND_GROUPS = ((0, 2), (2, 8), (8, 24))
#: Texts, and shingles on the average, that a block of a bucket holds.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Bytes of text that a task works on at a time.
STEP = 1_000_000


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document: hashes of five successive words, or of all words if a text has
    fewer. Texts without words have no shingle."""
    words = words_of(texts)
    names = pd.util.hash_array(words.vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words.vocabulary) else np.zeros(0, np.uint64)
    word, count = names[words.code], words.per_doc()
    base = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(word) - SHINGLE + 1, 0)
    code = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        code = code * base + word[k : k + n]
    inside = words.doc[:n] == words.doc[SHINGLE - 1 :] if n else np.zeros(0, bool)
    doc, code = words.doc[:n][inside], code[inside]
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    whole = np.array([sum(int(w) * pow(int(base), i, 1 << 64) for i, w in enumerate(word[begin[d] : begin[d] + count[d]])) % (1 << 64) for d in short], np.uint64)
    doc, code = np.concatenate([doc, short]).astype(np.int64), np.concatenate([code, whole])
    key = mixed(code ^ mixed(doc))
    order = np.argsort(key)
    _, start, times = sorted_counts(key)
    first = order[start] if len(start) else np.zeros(0, np.int64)
    by_doc = np.argsort(doc[first], kind="stable")
    return doc[first][by_doc], mixed(code[first][by_doc]), times[by_doc]


def weights(count: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so that repetition counts but doesn't drown the rest."""
    return 1.0 + np.log(count)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The first shingle to arrive in each register (docs x registers)."""
    time, kept = np.full(docs * registers, np.inf), np.zeros(docs * registers, np.uint64)
    arrival, turn = np.zeros(len(doc)), 0
    while len(doc):
        arrival = arrival - np.log(unit_interval(mixed(shingle, 2 * turn))) / weight
        slot = doc * registers + (mixed(shingle, 2 * turn + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, arrival)
        won = time[slot] == arrival
        kept[slot[won]] = shingle[won]
        open_until = time.reshape(docs, registers).max(axis=1)
        going = arrival < open_until[doc]
        doc, shingle, weight, arrival, turn = doc[going], shingle[going], weight[going], arrival[going], turn + 1
    return kept.reshape(docs, registers)


def _band_keys(kept: np.ndarray) -> np.ndarray:
    kept = kept.reshape(len(kept), BANDS, ROWS)
    key = np.zeros((len(kept), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key ^ kept[:, :, r])
    return key


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
        doc, shingle, count = weighted_shingles(batch.column("text"))
        present, local = np.unique(doc, return_inverse=True)
        key = _band_keys(signatures(local, shingle, weights(count), len(present), BANDS * ROWS))
        # bands for the set similarity too, as if every shingle occurred once; without repeated shingles they are the same
        repeats = np.bincount(local, weights=count > 1, minlength=len(present)) > 0
        of, again = np.flatnonzero(repeats), repeats[local]
        plain = _band_keys(signatures(np.searchsorted(of, local[again]), shingle[again], np.ones(int(again.sum())), len(of), BANDS * ROWS))
        new = np.ones((len(present), 2 * BANDS), bool)
        new[of, BANDS:] = plain != key[of]  # a text is in a bucket once
        both = np.concatenate([key, np.zeros_like(key)], axis=1)
        both[of, BANDS:] = plain
        taken = np.ones((len(present), 2 * BANDS), bool)
        taken[:, BANDS:] = repeats[:, None]
        offsets = np.zeros(batch.num_rows + 1, np.int32)
        offsets[present + 1] = BANDS * (1 + repeats)
        lists = pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), pa.array(both[taken].view(np.int64), mask=~new[taken]))
        size = pa.array(np.bincount(doc, minlength=batch.num_rows))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, size], [*batch.schema.names[1:], "bands", "size"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
        doc, shingle, count = weighted_shingles(batch.column("text"))
        order = np.lexsort((shingle, doc))
        shingle, count, ends = shingle[order], count[order], np.searchsorted(doc, np.arange(batch.num_rows + 1))
        sets = [shingle[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        counts = [count[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["rep", "shingles", "counts"])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over all e of max(x_e/x_d, y_e/y_d), for sorted elements a, b with weights x, y."""
    at = np.searchsorted(b, a)
    both = b[np.minimum(at, len(b) - 1)] == a
    p, q = x[both], y[at[both]]
    # max(x_e/x_d, y_e/y_d) is x_e/x_d where x_e/y_e is above x_d/y_d: sums over the order of that ratio; what is in one
    # text only has the ratio infinity or 0
    order = np.argsort(p / q)
    p, q = p[order], q[order]
    ratio = p / q
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    above, below = np.append(np.cumsum(p[::-1])[::-1], 0.0) + only_x, np.append(0.0, np.cumsum(q)) + only_y
    place = np.searchsorted(ratio, ratio)
    return float((1.0 / (above[place] / p + below[place] / q)).sum())


def similarities(sets: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of a block: the Jaccard similarity of the sets, and the share of i's weight that lies on shingles of j
    (as far as any text repeats a shingle: without repeats the first says it all)."""
    n, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code) > 1
    column, mine = np.cumsum(often) - 1, often[code]
    of, at = owner[mine], column[code[mine]]
    share = np.concatenate([weights(c) / weights(c).sum() for c in counts])[mine]
    order = np.argsort(at, kind="stable")
    of, at, share = of[order], at[order], share[order]
    repeats = any((c > 1).any() for c in counts)
    both, held = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for begin in range(0, int(often.sum()), 8192):  # a strip of shared shingles at a time
        a, b = np.searchsorted(at, [begin, begin + 8192])
        strip = np.zeros((n, min(8192, int(often.sum()) - begin)), np.float32)
        strip[of[a:b], at[a:b] - begin] = 1
        both += strip @ strip.T
        if repeats:
            weighted = np.zeros_like(strip)
            weighted[of[a:b], at[a:b] - begin] = share[a:b]
            held += weighted @ strip.T
    return both / np.maximum(size[:, None] + size[None] - both, 1), held


def joined_by_links(sets: list[np.ndarray], counts: list[np.ndarray], label: np.ndarray, apart: np.ndarray, least: float) -> np.ndarray:
    """Labels of a block's texts, the smallest place of each set, after all links: pairs with apart[i, j] whose shingle sets or
    weighted shingles are at least that similar. label has the sets that are joined already.

    The weighted similarity of a pair is worked out only as long as its texts aren't joined: that changes no set.
    """
    if not sum(len(s) for s in sets):
        return label
    jaccard, held = similarities(sets, counts)
    label = merged(label, *np.nonzero(np.triu(apart & (jaccard >= least), 1)))
    repeats = np.array([(c > 1).any() for c in counts])
    # a sum over e of max(x_e/x_d, y_e/y_d) is at least x/x_d and y/y_d with the totals x and y, so neither text may hold
    # less of its weight on shared shingles than the probability Jaccard similarity; the slack is for single precision
    bound = np.minimum(held, held.T)
    i, j = np.nonzero(np.triu(apart & (jaccard < least) & (bound >= least - 1e-3) & (repeats[:, None] | repeats[None]) & (label[:, None] != label[None]), 1))
    likely = np.argsort(-bound[i, j], kind="stable")
    weight = [weights(c) for c in counts]
    for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
        if label[a] != label[b] and probability_jaccard(sets[a], weight[a], sets[b], weight[b]) >= least:
            label = np.where(label == max(label[a], label[b]), min(label[a], label[b]), label)
    return label


def _compare(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """The links of one pair of blocks, each set of joined texts as a star around its first."""
    frame = frame.sort_values("rep", kind="stable")
    rep, label, block = (frame[c].to_numpy() for c in ("rep", "label", "block"))
    _, first, known = np.unique(label, return_index=True, return_inverse=True)
    apart = label[:, None] != label[None]
    if frame["one"].iloc[0] != frame["two"].iloc[0]:
        apart &= block[:, None] != block[None]
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    counts = [np.frombuffer(c, np.int32) for c in frame["counts"]]
    start = first[known]
    root = joined_by_links(sets, counts, start.copy(), apart, least)
    moved = np.flatnonzero((root != start) & (start == np.arange(len(rep))))  # one of each set that was joined before
    return pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})


def _blocks(n: str, size: str, block: int):
    """How many blocks n texts with that many shingles in all are cut into."""
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")


def near_duplicate_classes(docs: DataFrame, *, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, kept) for each doc_id of docs (doc_id long, text): class_id is the smallest doc_id of its class, which is kept.

    A class holds all documents that links reach: equal texts, and texts whose sets of shingles have a Jaccard similarity of
    `least`, or whose weighted shingles have that probability Jaccard similarity. Words are split at white space, A-Z in
    lower case. A null text is a class of its own, as is a text without words unless another is equal to it. A doc_id that occurs
    repeatedly is one document and joins the classes of all its texts; rows without doc_id are left out.
    """
    rows = docs.where("doc_id IS NOT NULL").select("text", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    features = written(rows.mapInArrow(_band, "doc_id long, h1 long, h2 long, bands array<long>, size long"), "bands")
    absent = docs.where("doc_id IS NOT NULL AND text IS NULL").select("doc_id")
    texts = features.join(absent, "doc_id", "left_anti").groupBy("h1", "h2")
    texts = written(texts.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size")), "texts")
    equal = features.join(texts.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    keys = texts.select("rep", "size", F.posexplode("bands").alias("band", "bucket")).where("bucket IS NOT NULL")
    keys = keys.withColumn("band", F.col("band") % BANDS)  # from BANDS on: the bands for the set similarity
    same = [F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2")]
    buckets = keys.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"), *same).where("n > 1")
    # buckets of the same members, in whatever band, are one
    once = buckets.groupBy("n", "sizes", "x1", "x2").agg(F.min(F.struct("band", "bucket")).alias("k"))
    once = once.select("k.band", "k.bucket", _blocks("n", "sizes", block).alias("blocks"))
    members = written(keys.join(once, ["band", "bucket"]), "members")
    wanted = written(members.select("rep").distinct(), "wanted")
    # a few more texts than wanted get their set written, so that no text is shuffled
    chosen = maybe_in(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "doc_id", wanted.withColumnRenamed("rep", "doc_id"))
    sets = written(chosen.select("text", F.col("doc_id").alias("rep")).mapInArrow(_shingle_sets, "rep long, shingles binary, counts binary"), "sets")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = wanted.withColumn("label", F.col("rep"))

    def after(units: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and labels after comparing units (band, bucket, one, two, rep, label, block)."""
        near = maybe_in(sets, "rep", units.select("rep").distinct())
        compared = units.join(near, "rep").groupBy("band", "bucket", "one", "two").applyInPandas(lambda frame: _compare(frame, least), "a long, b long")
        joined = connected_components(links.unionByName(written(compared.distinct(), "found"))).withColumnsRenamed({"node": "rep", "component": "joined"})
        pairs = joined.where("rep <> joined").select(F.col("rep").alias("a"), F.col("joined").alias("b"))
        return pairs, wanted.join(joined, "rep", "left").select("rep", F.coalesce("joined", "rep").alias("label"))

    def unsettled(some: DataFrame) -> DataFrame:
        """The members, with labels, of the buckets that aren't one class yet."""
        now = some.join(labels, "rep")
        mixed_up = now.groupBy("band", "bucket").agg((F.min("label") != F.max("label")).alias("open")).where("open").drop("open")
        # a table of its own, so that a join on a hot bucket can be split
        return written(now.join(written(mixed_up, "open"), ["band", "bucket"]), "placed")

    for low, high in BAND_GROUPS:
        placed = unsettled(members.where((F.col("band") >= low) & (F.col("band") < high)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # each block of a bucket is compared with the first one, within itself too
        others = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        units = placed.withColumn("two", F.explode(others)).withColumn("one", F.lit(0))
        links, labels = after(units.select("band", "bucket", "one", "two", "rep", "label", "block"))
    # what is left of buckets of several blocks: all pairs of texts that aren't in one class. A class that fills a block gets
    # blocks of its own, which needn't be compared with each other; the other texts of a bucket share blocks
    placed = unsettled(members.where("blocks > 1")).drop("blocks")
    classes = placed.groupBy("band", "bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"))
    fills = (F.col("n") >= block) | (F.col("sizes") >= BLOCK_SHINGLES)
    classes = classes.withColumn("own", F.when(fills, F.col("label").cast("string")).otherwise(""))
    groups = classes.groupBy("band", "bucket", "own").agg(F.sum("n").alias("n"), F.sum("sizes").alias("sizes"))
    groups = groups.select("band", "bucket", "own", _blocks("n", "sizes", block).alias("blocks"))
    placed = placed.join(classes.select("band", "bucket", "label", "own"), ["band", "bucket", "label"]).join(groups, ["band", "bucket", "own"])
    part = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = written(placed.select("band", "bucket", "rep", "label", "own", F.concat_ws("/", "own", part).alias("block")), "parts")
    blocks = placed.select("band", "bucket", "own", "block").distinct()
    second = blocks.select("band", "bucket", F.col("own").alias("own_two"), F.col("block").alias("two"))
    pairs = blocks.join(second, ["band", "bucket"]).where("block <= two AND (own <> own_two OR own = '')").withColumnRenamed("block", "one")
    sides = written(pairs.select("band", "bucket", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")), "pairs")
    links, _ = after(sides.join(placed, ["band", "bucket", "block"]).select("band", "bucket", "one", "two", "rep", "label", "block"))
    classes = connected_components(links.unionByName(equal)).withColumnsRenamed({"node": "doc_id", "component": "found"})
    ids = features.select("doc_id").distinct()
    out = ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("found", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
