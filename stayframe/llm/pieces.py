"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding starts from single characters and always takes the best-scored merge of neighbours, the leftmost of equal
ones. With dropout, a candidate merge (of the characters from `start` to `mid` with those from `mid` to `end` of a text) is skipped
when a hash keyed by the seed and the document falls below the dropout rate, so a text has the same segmentation on
every run, another one for every seed, and always decodes to itself.

No piece of the vocabulary holds a blank after another character, so merges never cross the place before a blank, nor
a character without a piece; that cuts a text into short segments. Segments of equal length are merged side by side,
and long ones one by one with an agenda.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from .common import in_arrow, read_table
from .textops import code_points, mixed, sliced

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
BLANK = "▁"
#: Segments of up to this many characters are merged side by side.
SIDE_BY_SIDE = 32
STEP_BYTES = 1_000_000
NO_MERGE = np.iinfo(np.int32).max


@dataclass(eq=False)
class PieceTable:
    """The model as arrays; its size is that of the vocabulary."""

    char_id: np.ndarray
    byte_id: np.ndarray
    rank: np.ndarray
    slots: np.ndarray
    merged: np.ndarray
    probes: int
    data: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The merges by (left << 32) | right, built once in each worker."""
        used = self.slots >= 0
        return dict(zip(self.slots[used].tolist(), self.merged[used].tolist(), strict=True))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's merge, or -1."""
        key = (left.astype(np.int64) << 32) | right
        slot = _slot(key, len(self.slots))
        found = np.full(len(key), -1, np.int32)
        for _ in range(self.probes):
            hit = self.slots[slot] == key
            found[hit] = self.merged[slot[hit]]
            slot = (slot + 1) & (len(self.slots) - 1)
        return found


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    product = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((product ^ (product >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)


def load(path: str = MODEL_PATH) -> PieceTable:
    """Reads a BPE model with byte fallback, in which pieces hold blanks in front only."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    names, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    ids = {name: i for i, name in enumerate(names) if plain[i]}
    if any(BLANK in name.lstrip(BLANK) for name in ids):
        raise ValueError("a piece holds a blank after another character")
    char_id, byte_id = np.full(0x110000, -1, np.int32), np.zeros(256, np.int32)
    for name, i in ids.items():
        if len(name) == 1:
            char_id[ord(name)] = i
    char_id[ord(" ")], char_id[ord(BLANK)] = ids[BLANK], -1  # the blank's own sign in a text is spelled in bytes
    for i in range(n):
        if model.is_byte(i):
            byte_id[int(names[i][3:5], 16)] = i
    rank = np.empty(n, np.int32)
    rank[np.argsort(-scores, kind="stable")] = np.arange(n)
    pairs = {(ids[name[:k]], ids[name[k:]]): i for name, i in ids.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids}
    keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
    size = 1 << int(np.ceil(np.log2(8 * len(keys))))
    slots, merged, probes = np.full(size, -1, np.int64), np.zeros(size, np.int32), 1
    for key, slot, value in zip(keys.tolist(), _slot(keys, size).tolist(), pairs.values(), strict=True):
        tried = 1
        while slots[slot] != -1:
            slot, tried = (slot + 1) & (size - 1), tried + 1
        slots[slot], merged[slot], probes = key, value, max(probes, tried)
    spelled = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(BLANK, " ").encode() if plain[i] else b"" for i in range(n)]
    length = np.array([len(s) for s in spelled], np.int64)
    return PieceTable(char_id, byte_id, rank, slots, merged, probes, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(length) - length, length)


_ALL = (1 << 64) - 1


def _place(start: int, mid: int, end: int) -> int:
    return ((start << 40) & _ALL) ^ ((mid - start) << 20) ^ (end - mid)


def _mixed_int(x: int) -> int:
    """`mixed` with seed 0 for one number."""
    x = (x + 0x9E3779B97F4A7C15) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate merges of [start, mid) and [mid, end) in documents of these keys are dropped."""
    if dropout <= 0:
        return np.zeros(len(start), bool)
    # the lengths of both halves take 20 bits each; longer ones only share their hash with others
    place = (start.astype(np.uint64) << np.uint64(40)) ^ ((mid - start).astype(np.uint64) << np.uint64(20)) ^ (end - mid).astype(np.uint64)
    return (mixed(key.astype(np.uint64) ^ mixed(place)) >> np.uint64(11)).astype(np.float64) < dropout * float(1 << 53)


def agenda(table: PieceTable, ids: np.ndarray, key: int, offset: int, dropout: float) -> list[tuple[int, int]]:
    """(start, id) of the pieces of one segment that begins at `offset` of its document."""
    n = len(ids)
    if not n:
        return []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = np.arange(n - 1)
    first = table.lookup(ids[:-1], ids[1:])
    first[skipped(np.full(n - 1, key & _ALL, np.uint64), offset + at, offset + at + 1, offset + at + 2, dropout)] = -1
    heap = [(int(table.rank[first[a]]), a, a + 1, a + 2, int(first[a])) for a in np.flatnonzero(first >= 0).tolist()]
    heapq.heapify(heap)
    ids, pairs = [int(i) for i in ids], table.pairs
    limit = round(dropout * (1 << 53))

    def offer(a: int) -> None:
        b = after[a]
        if b >= n:
            return
        new = pairs.get((ids[a] << 32) | ids[b], -1)
        if new >= 0 and not (limit and _mixed_int((key & _ALL) ^ _mixed_int(_place(offset + a, offset + b, offset + after[b]))) >> 11 < limit):
            heapq.heappush(heap, (int(table.rank[new]), a, b, after[b], new))

    while heap:
        _, a, b, end, new = heapq.heappop(heap)
        if ids[a] < 0 or ids[b] < 0 or after[a] != b or after[b] != end:
            continue  # one of both halves has changed
        ids[a], ids[b], after[a] = new, -1, end
        if end < n:
            before[end] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [(a, i) for a, i in enumerate(ids) if i >= 0]


def _merge_side_by_side(table: PieceTable, ids: np.ndarray, key: np.ndarray, offset: np.ndarray, dropout: float) -> np.ndarray:
    """Pieces of segments of equal length (rows x characters): the id where a piece begins, elsewhere -1."""
    n, width = ids.shape
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    new, order = np.full((n, width), -1, np.int32), np.full((n, width), NO_MERGE, np.int32)

    def offer(rows: np.ndarray, a: np.ndarray) -> None:
        b = after[rows, a]
        inside = b < width
        new[rows[~inside], a[~inside]], order[rows[~inside], a[~inside]] = -1, NO_MERGE
        rows, a, b = rows[inside], a[inside], b[inside]
        found = table.lookup(ids[rows, a], ids[rows, b])
        hit = np.flatnonzero(found >= 0)
        drop = skipped(key[rows[hit]], offset[rows[hit]] + a[hit], offset[rows[hit]] + b[hit], offset[rows[hit]] + after[rows[hit], b[hit]], dropout)
        found[hit[drop]] = -1
        new[rows, a] = found
        order[rows, a] = np.where(found >= 0, table.rank[found], NO_MERGE)

    every = np.arange(n)
    for a in range(width - 1):
        offer(every, np.full(n, a))
    rows = every
    while True:
        a = np.argmin(order[rows], axis=1)
        some = order[rows, a] != NO_MERGE
        rows, a = rows[some], a[some]
        if not len(rows):
            return ids
        b = after[rows, a]
        end = after[rows, b]
        ids[rows, a], ids[rows, b], order[rows, b] = new[rows, a], -1, NO_MERGE
        after[rows, a], before[rows, end] = end, a
        offer(rows, a)
        prior = before[rows, a]
        offer(rows[prior >= 0], prior[prior >= 0])


def encode_texts(table: PieceTable, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has."""
    points, doc = code_points([f" {t}" if t else "" for t in texts])
    n = len(points)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    ids = table.char_id[points]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    blank, foreign = points == 32, ids < 0
    cut = first | foreign
    cut[1:] |= (blank[1:] & ~blank[:-1]) | foreign[:-1]
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, n))
    place = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    for width in np.unique(length[length > 1]):
        at = begin[length == width]
        if width <= SIDE_BY_SIDE:
            spots = at[:, None] + np.arange(width)
            ids[spots] = _merge_side_by_side(table, ids[spots], keys[doc[at]], place[at], dropout)
        else:
            for b in at:
                kept = agenda(table, ids[b : b + width], int(keys[doc[b]]), int(place[b]), dropout)
                ids[b : b + width] = -1
                for a, i in kept:
                    ids[b + a] = i
    spelled = {int(c): chr(c).encode("utf-8") for c in np.unique(points[foreign])}
    count = (ids >= 0).astype(np.int64)
    if spelled:
        known = np.array(sorted(spelled))
        which = np.searchsorted(known, points[foreign])
        count[foreign] = np.array([len(spelled[c]) for c in known])[which]
    out = np.repeat(ids, count)
    if spelled:
        grid = np.array([[*table.byte_id[list(spelled[c])], *[0] * 4][:4] for c in known], np.int32)
        start = (np.cumsum(count) - count)[foreign]
        for k in range(4):
            more = count[foreign] > k
            out[start[more] + k] = grid[which[more], k]
    return out, np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)


def decode_ids(table: PieceTable, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of sequences of ids, of which counts gives the lengths."""
    length = table.length[ids]
    ends = np.concatenate(([0], np.cumsum(length)))
    data = table.data[np.repeat(table.begin[ids] - ends[:-1], length) + np.arange(ends[-1])]
    bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
    return pa.array([data[a + 1 : b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def encode(docs: DataFrame, table: PieceTable, *, dropout: float = DROPOUT, seed: int = 0, output: str = "piece_ids") -> DataFrame:
    """docs (doc_id, text, more columns) with the array `output`: the ids of the whole text. Every row stays.

    A null text has null ids, an empty one none. The key of a document is a hash of seed and doc_id, so repeated ids
    with equal texts have equal segmentations. A column of the output's name is replaced.
    """
    plain = docs.drop(output).withColumn("__key", F.xxhash64(F.lit(seed), "doc_id"))
    send = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP_BYTES)):
            texts = batch.column("text")
            ids, counts = encode_texts(send.value, [t or "" for t in texts.to_pylist()], batch.column("__key").to_numpy(), dropout)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32(), mask=np.append(pc.is_null(texts).to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*batch.schema.names, output])

    return in_arrow(plain, run, [StructField(output, ArrayType(IntegerType()))]).drop("__key")


def decode(encoded: DataFrame, table: PieceTable, *, ids: str = "piece_ids", output: str = "decoded") -> DataFrame:
    """encoded with the text of its array `ids` as `output`; null stays null."""
    plain = encoded.drop(output)
    send = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(ids)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = decode_ids(send.value, pc.list_flatten(lists).to_numpy(zero_copy_only=False), counts)
                texts = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, output])

    return in_arrow(plain, run, [StructField(output, StringType())])


def round_trip(docs: DataFrame, table: PieceTable, keep: list[str], *, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """The columns in keep, piece_ids, n_pieces, text_crc32 and `lossless`: whether decoding gives the text again.

    One worker encodes and decodes, so a task needs one Python process and ids cross to it once.
    """
    names = [*keep, "text_crc32"]
    rows = docs.select(*keep, F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text", F.xxhash64(F.lit(seed), "doc_id").alias("__key"))
    send = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP_BYTES)):
            given = batch.column("text")
            texts, absent = [t or "" for t in given.to_pylist()], pc.is_null(given).to_numpy(zero_copy_only=False)
            ids, counts = encode_texts(send.value, texts, batch.column("__key").to_numpy(), dropout)
            same = pa.array([a == b for a, b in zip(decode_ids(send.value, ids, counts).to_pylist(), texts, strict=True)], pa.bool_())
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32(), mask=np.append(absent, False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), same], [*names, "piece_ids", "lossless"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "piece_ids array<int>", "lossless boolean"]))
    return found.select(*keep, "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "text_crc32", "lossless")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), load(), ["doc_id"])
