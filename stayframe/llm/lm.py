"""Language-model scoring with a probabilistic suffix tree over words.

The root predicts a word from its smoothed count. A context of up to `context` words (a string that occurs MIN_COUNT times)
becomes a state of the tree if its next-word counts diverge enough from those of the state that its suffix would use:
the log-likelihood ratio must exceed half a log of the corpus size for each parameter. A state's distribution is
smoothed with its parent's, words that it doesn't list keep the parent's proportions, and every word is scored in the
state of the longest suffix of what precedes it.

Nothing here is bounded by a share of the corpus: words, contexts and next-word counts stay in Spark tables, under 64-bit
hashes of their words. What a token scores above the root is a sum over the states that end before it: what the state
gives every word, and what it gives a listed one besides. Both are values under a key, so one join by key finds them.
Only the commonest words and keys (at most LOOKUP_ROWS of each) are looked up in the tasks, all others in that join, and bitmaps
of 16 MB at most keep keys out of shuffles that the tables can't hold.

Strings to count and keys to look up are many and short, so a task deals them out into buckets by their hash and hands on each bucket
as one row of packed arrays. The number of buckets grows with the corpus, which bounds what a bucket holds. A string to be counted is
sent as its words' numbers, three bytes each for the LOOKUP_ROWS commonest words; strings with another word are sent as hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BITMAP, held_out, read_table, removed, written
from .textops import Words, mixed, sliced, words_of

END = ""
#: So many words, and so many keys, are looked up in the tasks at most: 16 bytes each. The others are found by a join.
LOOKUP_ROWS = 1 << 20
MIN_COUNT = 4
CONTEXT = 3
SMOOTHING = 2.0
#: Tells the key of a state from the key of the same words as a listed string.
STATE = 0x2545F4914F6CDD1D
#: Tokens of the corpus, on the average, for one bucket of strings to count, and for one of keys to look up.
BUCKET_TOKENS, LOOKUP_TOKENS = 1 << 20, 1 << 23
#: From so many bytes of text on, documents are scored in SLICES parts one after the other: what they ask for takes more disk than
#: the tables that answer, which each slice shuffles again. Every document is in one slice.
SLICE_BYTES, SLICES = 1 << 26, 4
#: Bytes of text for one token, about: how many tokens a table to be scored has needn't be known.
TOKEN_BYTES = 6
#: Bytes of text that a task scores at a time, and counts the strings of before they are shuffled, and bytes of keys.
STEP, COUNT_STEP, KEY_STEP = 1_000_000, 4_000_000, 4_000_000


@dataclass
class SuffixTree:
    """The tables of the model, and the common part of them that tasks look up.

    counts is the table (name, c) of all words, levels the length of the longest context, and lookup is the table (key, v, n) of
    what states and the strings they list add to a word's score. words and seen are the common words' names (sorted) and counts, keys
    (sorted) and added the common part of lookup; common_words and common_keys say from which count on. bits is a bitmap of all keys.
    """

    counts: DataFrame
    tokens: int
    vocabulary: int
    levels: int
    lookup: DataFrame
    common_words: int
    words: np.ndarray
    seen: np.ndarray
    common_keys: int
    keys: np.ndarray
    added: np.ndarray
    bits: np.ndarray

    def buckets(self, tokens: int) -> int:
        """For so many tokens to be scored: what they ask grows with them, and the tables that answer with the training tokens."""
        return max(1, -(-max(self.tokens, tokens) * max(1, self.levels) // LOOKUP_TOKENS))


def _names(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _named(words: Words) -> np.ndarray:
    """The name of each code, with that of the end last, where code -1 finds it."""
    return np.append(_names(words.vocabulary), _names(pa.array([END])))


def _longer(string: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a string with one more word."""
    return mixed(string * np.uint64(0x9E3779B97F4A7C15) + word)


def _runs(named: np.ndarray, code: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 .. most: keys of the strings of k words at each place, their next words, and if no end is among the k."""
    name, end = named[code], code < 0
    string, whole = name, ~end
    for k in range(1, most + 1):
        yield string, name[k:], whole[: max(len(whole) - 1, 0)]
        string, whole = _longer(string[: max(len(string) - 1, 0)], name[k:]), whole[: max(len(whole) - 1, 0)] & ~end[k:]


def _bitmap(keys: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """A bitmap with two bits for each key (key), of 16 bits a key and most_bits (16 MB) at most: no key is missed, few others pass."""
    bits, count = BITMAP, keys.count()
    while bits < min(16 * count, most_bits):
        bits *= 2
    both = F.array(*(p.bitwiseAND(F.lit(bits - 1)) + 1 for p in (F.col("key"), F.shiftright("key", 32))))
    parts = keys.select(F.explode(both).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most most_bits / BITMAP rows
        out[(r["of"] - 1) * BITMAP // 8 : r["of"] * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _may_hold(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    last = np.uint64(8 * len(bits) - 1)
    is_set = lambda at: (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    found = is_set(key & last)
    found[found] = is_set((key[found] >> np.uint64(32)) & last)
    return found


def _common(counted: DataFrame, column: str, rows: int) -> int:
    """The least count from which on at most that many rows of counted are, in steps of a twelfth of an octave."""
    step = F.floor(F.log2(F.col(column)) * 12).cast("int")
    sizes = {r["step"]: r["n"] for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 12 * 63 rows
    least, held = math.inf, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > rows:
            break
        least = at
    return 1 << 62 if least == math.inf else math.ceil(2 ** (least / 12) - 1e-9)


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a batch with an end after each document: words, and (document, code) with code -1 for the end."""
    words = words_of(texts)
    at = np.cumsum(words.per_doc())
    return words, np.insert(words.doc, at, np.arange(words.docs)), np.insert(words.code.astype(np.int64), at, -1)


def _dealt(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    number, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))
    packed = [pa.array(number, pa.int32())]
    for column in columns.values():
        offsets = (ends * column.itemsize).astype(np.int32)
        packed.append(pa.BinaryArray.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column[order]))]))
    return pa.RecordBatch.from_arrays(packed, ["bucket", *columns])


def _joined(rows: pa.Table, name: str, kind) -> np.ndarray:
    """The bytes of a column of packed arrays as one array."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in rows.column(name).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset :] if len(chunk) else [0, 0]
        parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0] : ends[len(chunk)]] if len(chunk) else parts[0])
    return np.concatenate(parts).view(kind)


def word_counts(texts: DataFrame) -> DataFrame:
    """(name, c) over all rows of texts (text): name is the word's hash. The end of a text counts as the word ''. Null: an empty text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
            words = words_of(batch.column("text"))
            n = np.append(np.bincount(words.code, minlength=len(words.vocabulary)), batch.num_rows)
            names = np.append(_names(words.vocabulary), _names(pa.array([END])))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n, pa.int64())], ["name", "n"])

    return texts.select("text").mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("c"))


def _next_words(texts: DataFrame, contexts: DataFrame, length: int, least: int, buckets: int, table: Broadcast) -> DataFrame:
    """(ctx, key, suffix, n): how often a word follows a context of `length` words, for all that do so `least` times. key is the
    string of both, suffix that string without its first word. table: names (sorted) and numbers of the common words. Written at once,
    so that what was broadcast can go."""
    send = texts.sparkSession.sparkContext.broadcast(_bitmap(contexts.select("key")))  # 16 MB at most
    places = range(length + 1)
    schema = "bucket int, n binary, " + ", ".join(f"low{i} binary, high{i} binary, name{i} binary" for i in places)
    types = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (common, number) = send.value, table.value
        for batch in (piece for whole in batches for piece in sliced(whole, COUNT_STEP)):
            words, _, code = _tokens(batch.column("text"))
            named = _named(words)
            *_, (string, word, whole) = _runs(named, code, length)
            # both the string without its last word and the one without its first occur at least as often
            known = _may_hold(bits, string)
            at = np.flatnonzero(whole & known[:-1] & known[1:])
            key, first, n = np.unique(_longer(string[at], word[at]), return_index=True, return_counts=True)
            at, bucket, n = at[first], (key % np.uint64(buckets)).astype(np.int32), n.astype(np.int32)
            is_common, place = _place(common, named)
            numbered = np.where(is_common, number[place] if len(number) else 0, 0).astype(np.uint32)
            coded = np.logical_and.reduce([is_common[code[at + i]] for i in places])
            both = (
                (coded, lambda i, at: {f"low{i}": (x := numbered[code[at + i]]).astype(np.uint16), f"high{i}": (x >> 16).astype(np.uint8)}),  # noqa: B023
                (~coded, lambda i, at: {f"name{i}": named[code[at + i]]}),  # noqa: B023
            )
            for part, columns in both:
                if part.any():
                    own = at[part]
                    dealt = _dealt(bucket[part], n=n[part], **{k: v for i in places for k, v in columns(i, own).items()})
                    yield _filled(dict(zip(dealt.schema.names, dealt.columns, strict=True)), dealt.num_rows, types)

    def add_up(rows: pa.Table) -> pa.Table:
        common, number = table.value
        of_number = np.empty_like(common)
        of_number[number] = common
        coded, named = rows.filter(pa.compute.is_valid(rows["low0"])), rows.filter(pa.compute.is_valid(rows["name0"]))
        n = np.concatenate([_joined(part, "n", np.int32) for part in (coded, named)])
        words = [
            np.concatenate([of_number[_joined(coded, f"low{i}", np.uint16) | _joined(coded, f"high{i}", np.uint8).astype(np.uint32) << 16], _joined(named, f"name{i}", np.uint64)])
            for i in places
        ]
        key = reduce(_longer, words)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        total = np.add.reduceat(n[order].astype(np.int64), first)
        at = order[first[total >= least]]
        columns = {"ctx": reduce(_longer, [w[at] for w in words[:-1]]), "key": key[at], "suffix": reduce(_longer, [w[at] for w in words[1:]])}
        return pa.table({c: x.view(np.int64) for c, x in columns.items()} | {"n": total[total >= least]})

    found = written(texts.select("text").mapInArrow(count, schema).groupBy("bucket").applyInArrow(add_up, "ctx long, key long, suffix long, n long"), "found")
    send.destroy()
    return found


def _grown(strings: DataFrame, contexts: DataFrame, tokens: int, smoothing: float) -> DataFrame:
    """Tests every context of strings (ctx, n, root, base) against its parent and adds total, how often the context occurs by contexts
    (key, n), and rest, what a state gives all words (both null: no state), and lift, what the string's last word scores above the
    root (log10)."""
    parent = F.col("root") * F.pow(F.lit(10.0), F.col("base"))
    sums = strings.groupBy("ctx").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(parent).alias("parent"), F.sum(F.col("n") * F.log(F.col("n") / parent)).alias("listed"))
    sums = sums.join(contexts.select(F.col("key").alias("ctx"), F.col("n").alias("total")), "ctx")
    left, left_parent = F.greatest(F.col("total") - F.col("n"), F.lit(0)), F.greatest(1 - F.col("parent"), F.lit(1e-12))
    ratio = F.col("listed") - F.col("n") * F.log("total") + F.when(left > 0, left * F.log(left / F.col("total") / left_parent)).otherwise(0.0)
    states = sums.where(ratio > 0.5 * math.log(max(tokens, 2)) * (F.col("k") + 1))
    listed = (F.col("n") + smoothing * F.col("parent")) / (F.col("total") + smoothing)
    states = states.select("ctx", "total", F.log10(F.greatest(1 - listed, F.lit(1e-12)) / left_parent).alias("rest"))
    p = (F.col("n") + smoothing * parent) / (F.col("total") + smoothing)
    lift = F.when(F.col("rest").isNull(), F.col("base")).otherwise(F.log10(p / F.col("root")))
    return strings.join(states, "ctx", "left").withColumn("lift", lift)


def train(texts: DataFrame, *, context: int = CONTEXT, min_count: int = MIN_COUNT, lookup_rows: int = LOOKUP_ROWS, smoothing: float = SMOOTHING) -> SuffixTree:
    """The tree of contexts of up to `context` words over all words of texts (text).

    Null texts count as empty. No text at all gives a tree without words. lookup_rows changes how scores are found, not scores.
    """
    counts = written(word_counts(texts), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, vocabulary = int(total["n"]), int(total["v"])
    common_words = _common(counts, "c", lookup_rows)
    listed = counts.where(F.col("c") >= common_words).select("name", "c").toArrow()  # at most lookup_rows rows
    names = listed["name"].to_numpy().view(np.uint64)
    by_name = np.argsort(names)
    words, seen = names[by_name], listed["c"].to_numpy()[by_name]
    root = (F.col("c") + 1) / F.lit(float(tokens + vocabulary + 1))
    known = counts.where(F.col("c") >= min_count).select(F.col("name").alias("key"), F.col("c").alias("n"), root.alias("root"), F.lit(0.0).alias("lift"))
    number = np.empty(len(words), np.uint32)
    number[np.argsort(-seen, kind="stable")] = np.arange(len(words), dtype=np.uint32)  # small numbers for the commonest words
    table, values = texts.sparkSession.sparkContext.broadcast((words, number)), []  # 12 bytes a common word
    for length in range(1, context + 1):
        # each step's shuffles go before the next begins, and tables that nothing will read any more
        found = _next_words(texts, known, length, min_count, max(1, -(-tokens // BUCKET_TOKENS)), table)
        untested = written(found.join(known.select(F.col("key").alias("suffix"), "root", F.col("lift").alias("base")), "suffix").drop("suffix"), "strings")
        removed(found)
        grown = written(_grown(untested, known, tokens, smoothing), "tree")
        removed(untested)
        if length > 1:
            removed(known)
        known = grown
        if not known.head(1):  # nor is any longer string listed
            break
        stated = known.where("rest IS NOT NULL")
        states = stated.groupBy("ctx").agg(F.first("rest").alias("v"), F.first("total").alias("n")).select(F.col("ctx").bitwiseXOR(F.lit(STATE)).alias("key"), "v", "n")
        values.append(written(states.unionByName(stated.select("key", (F.col("lift") - F.col("base") - F.col("rest")).alias("v"), "n")), "values"))
    table.destroy()
    if values:
        removed(known)
    lookup = reduce(DataFrame.unionByName, values or [texts.sparkSession.createDataFrame([], "key long, v double, n long")])
    common_keys = _common(lookup, "n", lookup_rows)
    hot = lookup.where(F.col("n") >= common_keys).select("key", "v").toArrow()  # at most lookup_rows rows
    keys = hot["key"].to_numpy().view(np.uint64)
    by_key = np.argsort(keys)
    return SuffixTree(
        counts, tokens, vocabulary, len(values), lookup, common_words, words, seen,
        common_keys, keys[by_key], hot["v"].to_numpy()[by_key], _bitmap(lookup.select("key")),
    )


def _place(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in ordered, and where."""
    at = np.minimum(np.searchsorted(ordered, keys), max(len(ordered) - 1, 0))
    return (ordered[at] == keys) if len(ordered) else np.zeros(len(keys), bool), at


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each value of the leading bits, of which there are as many as keys or up to twice as many, where its keys begin."""
    bits = np.uint64(max(1, len(ordered).bit_length()))
    return np.searchsorted(ordered >> (np.uint64(64) - bits), np.arange(1 << int(bits), dtype=np.uint64)).astype(np.int32)


def _place_by_start(ordered: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _place, for hashes: the leading bits tell where to begin, and a few steps do the rest, instead of a binary search over all."""
    last = len(ordered) - 1
    if last < 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(starts[keys >> np.uint64(65 - len(starts).bit_length())], last)
    behind = np.flatnonzero(ordered[at] < keys)
    while len(behind):
        behind = behind[at[behind] < last]
        at[behind] += 1
        behind = behind[ordered[at[behind]] < keys[behind]]
    return ordered[at] == keys, at


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, times), sorted by document."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def _measure(model: tuple, levels: int, text: pa.Array) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Each document's sums as far as the common words and keys give them, and (document, key, times) of the words and of the keys
    that remain to be joined. Words that aren't common count as unknown here."""
    words, seen, size, keys, starts, added, bits = model
    parts, doc, code = _tokens(text)
    name = _named(parts)
    known, at = _place(words, name)
    root = np.where(known, np.log10((seen[at] + 1) / size) if len(seen) else 0.0, -np.log10(size))
    per_doc = lambda x, d: np.bincount(d, weights=x, minlength=parts.docs)
    gain, left_doc, left_key = np.zeros(parts.docs), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for string, word, whole in _runs(name, code, levels):
        ctx, of = string[:-1][whole], doc[: len(whole)][whole]
        for key in (ctx ^ np.uint64(STATE), _longer(ctx, word[whole])):
            maybe = _may_hold(bits, key)
            key, where = key[maybe], of[maybe]
            hot, place = _place_by_start(keys, starts, key)
            gain += per_doc(added[place[hot]], where[hot])
            left_doc.append(where[~hot])
            left_key.append(key[~hot])
    rare = ~known[code]
    sums = {"n": np.bincount(doc, minlength=parts.docs), "known": np.bincount(doc[~rare], minlength=parts.docs), "base": per_doc(root[code], doc), "gain": gain}
    return sums, [_repeats(doc[rare], name[code[rare]]), _repeats(np.concatenate(left_doc), np.concatenate(left_key))]


def _filled(columns: dict, rows: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def score(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) for every row of docs (doc_id, text; more columns are ignored).

    Null texts are empty: one token, the end. Repeated rows are each returned. Without any training text all
    scores are 0: the only class left is the unknown word. From SLICE_BYTES of text on, slices are scored and written one by one.
    """
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    # a slice asks for its share only, so the whole text needs as many more buckets as there would be slices
    in_slices = text_bytes >= SLICE_BYTES
    levels, buckets, size = tree.levels, tree.buckets(int(text_bytes) // TOKEN_BYTES * (1 if in_slices else SLICES)), float(tree.tokens + tree.vocabulary + 1)
    send = docs.sparkSession.sparkContext.broadcast((tree.words, tree.seen, size, tree.keys, _starts(tree.keys), tree.added, tree.bits))  # bounded by lookup_rows, and the bitmap by 16 MB
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
            sums, left = _measure(send.value, levels, batch.column("text"))
            row = batch.column("row").to_numpy()
            known = {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "bucket": pa.array((row.view(np.uint64) % np.uint64(buckets)).astype(np.int32)), **{c: pa.array(x) for c, x in sums.items()}}
            yield _filled(known, batch.num_rows, types)
            for kind, (doc, key, times) in enumerate(left):
                if len(doc):
                    dealt = _dealt((key % np.uint64(buckets)).astype(np.int32), rows=row[doc], keys=key, times=times.astype(np.int32))
                    packed = dict(zip(dealt.schema.names, dealt.columns, strict=True))
                    yield _filled(packed | {"kind": pa.repeat(pa.scalar(kind, pa.int32()), dealt.num_rows)}, dealt.num_rows, types)

    sums, sums_of = "n long, known long, base double, gain double", ("n", "known", "base", "gain")
    slim = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    schema = f"doc_id {kind}, row long, {sums}, kind int, bucket int, rows binary, keys binary, times binary"
    types = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    rare_words = tree.counts.where(F.col("c") < tree.common_words).select(F.lit(0).alias("kind"), F.col("name").alias("key"), F.log10(F.col("c") + 1.0).alias("v"))
    rare_keys = tree.lookup.where(F.col("n") < tree.common_keys).select(F.lit(1).alias("kind"), "key", "v")
    # key is a signed long here, and unsigned where the rows were dealt
    signed = F.col("key") % buckets
    bucket = F.pmod(F.when(F.col("key") < 0, signed + F.lit((1 << 64) % buckets)).otherwise(signed), F.lit(buckets)).cast("int")
    rare = rare_words.unionByName(rare_keys).withColumn("bucket", bucket)

    def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
        """The documents as they are, and what their words and keys of this bucket add to them, dealt by document.

        What is asked is looked up KEY_STEP bytes at a time, so that arrays over all keys of the bucket never exist at once.
        """
        own = asked.filter(pa.compute.is_null(asked["kind"]))
        own = own.set_column(own.schema.get_field_index("bucket"), "bucket", pa.array((own["row"].to_numpy().view(np.uint64) % np.uint64(groups)).astype(np.int32)))
        parts = {"row": [], "known": [], "base": [], "gain": []}
        held = {}
        for kind in (0, 1) if table.num_rows else ():
            values = table.filter(pa.compute.equal(table["kind"], kind))
            names = values["key"].to_numpy().view(np.uint64)
            by = np.argsort(names)
            held[kind] = names[by], values["v"].to_numpy()[by]
        step = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(asked["keys"]), 0).to_numpy(), dtype=np.int64) // KEY_STEP
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), asked.num_rows]
        for kind, first, end in ((k, a, b) for k in held for a, b in zip(cuts, cuts[1:])):  # noqa: B905
            piece = asked.slice(first, end - first)
            mine = piece.filter(pa.compute.equal(piece["kind"], kind))
            if mine.num_rows:
                hit, at = _place(held[kind][0], _joined(mine, "keys", np.uint64))
                times = _joined(mine, "times", np.int32)[hit]
                rows, of = np.unique(_joined(mine, "rows", np.int64)[hit], return_inverse=True)
                nothing, added = np.zeros(len(rows)), np.bincount(of, weights=times * held[kind][1][at[hit]], minlength=len(rows))
                count = np.bincount(of, weights=times, minlength=len(rows))
                for c, x in zip(parts, (rows, count, added, nothing) if kind == 0 else (rows, nothing, nothing, added), strict=True):
                    parts[c].append(x)
        rows, of = np.unique(np.concatenate([np.zeros(0, np.int64), *parts["row"]]), return_inverse=True)
        sums = [np.bincount(of, weights=np.concatenate([np.zeros(0), *parts[c]]), minlength=len(rows)) for c in ("known", "base", "gain")]
        out = [pa.Table.from_batches([_filled({c: own[c].combine_chunks() for c in own_names}, own.num_rows, reply)])]
        if len(rows):
            dealt = _dealt((rows.view(np.uint64) % np.uint64(groups)).astype(np.int32), rows=rows, known=sums[0].astype(np.int32), base=sums[1], gain=sums[2])
            packed = dict(zip(["bucket", "rows", "more_known", "more_base", "more_gain"], dealt.columns, strict=True))
            out.append(pa.Table.from_batches([_filled(packed, dealt.num_rows, reply)]))
        return pa.concat_tables(out)

    def add_up(table: pa.Table) -> pa.Table:
        """The documents of a group. Equal rows have one number, under which what they look up is added up."""
        own = table.filter(pa.compute.is_null(table["rows"]))
        packed = table.filter(pa.compute.is_valid(table["rows"]))
        rows, of, copies = np.unique(own["row"].to_numpy(), return_inverse=True, return_counts=True)
        _, at = _place(rows, _joined(packed, "rows", np.int64))
        more = lambda c, kind: (np.bincount(at, weights=_joined(packed, f"more_{c}", kind), minlength=len(rows)) / copies)[of]
        base = own["base"].to_numpy() + more("base", np.float64)
        known = own["known"].to_numpy() + np.rint(more("known", np.int32)).astype(np.int64)
        columns = {"doc_id": own["doc_id"], "n_tokens": own["n"], "n_known": known, "base_score": base, "score": base + own["gain"].to_numpy() + more("gain", np.float64)}
        return pa.table(columns)

    groups, own_names = max(1, buckets // 2), ("doc_id", "row", *sums_of, "bucket")
    reply_schema = f"doc_id {kind}, row long, {sums}, bucket int, rows binary, more_known binary, more_base binary, more_gain binary"
    reply = to_arrow_schema(docs.sparkSession.createDataFrame([], reply_schema).schema)

    def scored(some: DataFrame) -> DataFrame:
        looked_up = some.mapInArrow(read, schema).groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(look_up, reply_schema)
        return looked_up.groupBy("bucket").applyInArrow(add_up, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")

    if not in_slices:
        return scored(slim)
    # equal rows are in one slice, where what they look up is added up
    parts = [written(scored(slim.where(F.pmod(F.shiftright("row", 32), F.lit(SLICES)) == k)), "scores") for k in range(SLICES)]
    send.destroy()
    return reduce(DataFrame.unionByName, parts)


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tree = train(docs.where(~held_out("doc_id", 7, 2)))
    scores = score(docs, tree)
    return scores.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
