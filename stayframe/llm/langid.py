"""Language identification of documents that may mix languages.

Each language has a distribution of hashed character trigrams. Expectation-maximisation estimates a
document's proportions of languages from the likelihoods of its trigrams, and the set of languages is the one
with the highest likelihood less a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from .common import held_out, in_arrow, read_table
from .textops import code_points, letter_table, sliced, sorted_counts, steps

GRAM_BITS = 16
UNKNOWN = "und"
#: Characters that a task works on at a time.
STEP = 1_000_000


@dataclass(frozen=True)
class LanguageModel:
    """log_p: grams x languages. Its size is 2^GRAM_BITS times the number of labels, whatever the corpus."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count) of the trigrams of letters and gaps of whole texts; runs of other characters are one gap."""
    points, doc = code_points([f" {t} ".lower() for t in texts])
    letter = letter_table()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[:1] = True
    if len(doc):
        kept[1:] |= doc[1:] != doc[:-1]
    symbol, doc = np.where(letter, points, 0)[kept].astype(np.uint32), doc[kept]
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second, third = symbol[:-2], symbol[1:-1], symbol[2:]
    code = first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)
    inside = (doc[:-2] == doc[2:]) & ((first | second | third) > 0)
    keys, _, counts = sorted_counts((doc[:-2][inside].astype(np.uint64) << np.uint64(GRAM_BITS)) | code[inside])
    return (keys >> np.uint64(GRAM_BITS)).astype(np.int64), (keys & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64), counts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        names = sorted(set(langs))
        index = {x: i for i, x in enumerate(names)}
        lang_of = np.array([index[x] for x in langs], np.int64)
        for a, b in steps(np.array([len(t) for t in texts]), STEP):
            doc, gram, count = gram_counts(texts[a:b])
            keys, place = np.unique((lang_of[a:b][doc] << GRAM_BITS) | gram, return_inverse=True)
            n = np.bincount(place, weights=count, minlength=len(keys)).astype(np.int64)
            lang = pa.array(names, pa.string()).take(pa.array(keys >> GRAM_BITS))
            yield pa.RecordBatch.from_arrays([lang, pa.array(keys & ((1 << GRAM_BITS) - 1), pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def train(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows of labelled (text, lang) in which neither is null."""
    counted = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count_batches, "lang string, gram int, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most languages x grams rows
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.full((1 << GRAM_BITS, len(languages)), smoothing)
    if languages:
        index = {x: i for i, x in enumerate(languages)}
        np.add.at(counts, (table["gram"].to_numpy(), table["lang"].map(index).to_numpy()), table["n"].to_numpy())
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0, keepdims=True)) if languages else counts)


def em(p: np.ndarray, doc: np.ndarray, count: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihoods. p: likelihood of each row's gram in each language;
    rows are sorted by doc, every document has rows; languages with start 0 stay at 0."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    total = np.add.reduceat(count, first)[:, None]
    weights = start / start.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = count / np.einsum("ij,ij->i", p, weights[doc])
        weights = weights * np.add.reduceat(p * share[:, None], first, axis=0) / total
    return weights, np.add.reduceat(count * np.log(np.einsum("ij,ij->i", p, weights[doc])), first)


def mixtures(model: LanguageModel, texts: list[str], *, rounds: int = 12, penalty: float = 3.0) -> list[tuple[str, float, list[str], list[float], float]]:
    """(language, score, languages, proportions, covered) of each text.

    Languages are tried as nested sets by falling proportion; a further language must add more than
    penalty * log(number of trigrams) / 2 to the log-likelihood. The penalty of 3 allows for each letter being part
    of three trigrams. The score is the predicted language's proportion before the selection, and
    `covered` the sum of those of the selected languages. Of equal languages the first by name leads.
    """
    out: list[tuple[str, float, list[str], list[float], float]] = [(UNKNOWN, 0.0, [], [], 0.0)] * len(texts)
    doc, gram, count = gram_counts(texts)
    if not len(doc) or not model.languages:
        return out
    present, doc = np.unique(doc, return_inverse=True)
    log_p = model.log_p[gram]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(doc))
    top = np.maximum.reduceat(log_p.max(axis=1), first)
    p, count = np.exp(log_p - top[doc][:, None]), count.astype(float)  # scaled: only ratios matter
    p = np.maximum(p, 1e-300)
    n, k = np.add.reduceat(count, first), len(model.languages)
    full, full_ll = em(p, doc, count, np.ones((len(present), k)), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    single = np.add.reduceat(count[:, None] * np.log(p), first, axis=0)
    cost = penalty * np.log(np.maximum(n, 2)) / 2
    best_one = np.argmax(single, axis=1)
    order[:, 0], chosen = best_one, np.zeros_like(full)
    chosen[np.arange(len(present)), best_one] = 1.0
    best = single[np.arange(len(present)), best_one]
    reached = best.copy()
    open_docs = np.flatnonzero(full_ll - best > cost)  # no set can do better than all languages
    by_weight = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        if not len(open_docs):
            break
        rows = np.concatenate([np.arange(first[d], last[d]) for d in open_docs])
        local = np.repeat(np.arange(len(open_docs)), last[open_docs] - first[open_docs])
        start = np.zeros((len(open_docs), k))
        np.put_along_axis(start, by_weight[open_docs, :size], 1.0, axis=1)
        weights, ll = em(p[rows], local, count[rows], start, rounds)
        value = ll - (size - 1) * cost[open_docs]
        better = value > reached[open_docs]
        chosen[open_docs[better]], reached[open_docs[better]] = weights[better], value[better]
        open_docs = open_docs[full_ll[open_docs] - size * cost[open_docs] > reached[open_docs]]
    for i, d in enumerate(present):
        used = [j for j in np.argsort(-chosen[i], kind="stable") if chosen[i, j] > 0]
        lead = used[0]
        out[d] = (model.languages[lead], float(min(1.0, full[i, lead])), [model.languages[j] for j in used], [float(chosen[i, j]) for j in used], float(min(1.0, full[i, used].sum())))
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (text, more columns) with lang_pred, lang_score, lang_set and lang_shares.

    Every row stays, repeated ones too. A text that is null or has no letter is `und` with score 0; a model without
    languages finds `und` everywhere. Columns of these four names are replaced.
    """
    added = ("lang_pred", "lang_score", "lang_set", "lang_shares")
    plain = docs.drop(*added)
    send = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^GRAM_BITS doubles
    result = pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64()), ("lang_set", pa.list_(pa.string())), ("lang_shares", pa.list_(pa.float64()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [x for a, b in steps(np.array([len(t) for t in texts]), STEP) for x in mixtures(send.value, texts[a:b])]
            columns = [pa.array([x[i] for x in found], result.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(c for c in batch.columns), *columns], [*batch.schema.names, *added])

    kinds = (StringType(), DoubleType(), ArrayType(StringType()), ArrayType(DoubleType()))
    return in_arrow(plain, predict, [StructField(n, t) for n, t in zip(added, kinds, strict=True)])


def kept_by_language(docs: DataFrame, model: LanguageModel, least_share: float) -> DataFrame:
    """The rows of docs (text, more columns) whose selected languages together have at least that share, with all their columns.

    Rows are judged one by one: repeated ones stay or go together, `und` ones go, and an empty table gives no rows."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
            found = mixtures(send.value, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[4] >= least_share for x in found], pa.bool_()))

    return in_arrow(docs, run)


def op3_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    slim = identify(rows.select("doc_id", "text", "held_out"), model)
    return slim.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.array_join("lang_set", ",").alias("lang_set"))
