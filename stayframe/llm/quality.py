"""Quality classifier: random Fourier features of document statistics, ridge regression from partition-summed
normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, in_arrow, read_table, written
from .textops import code_points, letter_table, sliced, sorted_counts, steps, words_of

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "marks", "white", "lines_per_word", "ascii",
    "distinct_words", "top_word", "words_with_marks", "words_without_letters", "distinct_lines", "mark_entropy",
)
#: Random features. With the intercept, the normal equations have FEATURES + 1 rows and columns, whatever the corpus.
FEATURES = 256
FOLDS = 4
#: Cells of the score axis on which the calibration sums labels; its resolution, not a sample.
CELLS = 2000
#: Characters that a task works on at a time.
STEP = 1_000_000


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each whole text; an empty text has zeros."""
    points, doc = code_points(texts)
    n = len(texts)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n).astype(float)

    letter = letter_table()[points]
    white = (points == 32) | ((points >= 9) & (points <= 13))
    digit, upper = (points >= 48) & (points <= 57), (points >= 65) & (points <= 90)
    mark = ~(letter | white | digit)
    chars = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
    marks = per_doc(mark)
    kind, _, times = sorted_counts((doc[mark].astype(np.int64) << 21) | points[mark])
    share = times / np.maximum(marks, 1)[kind >> 21]
    entropy = np.bincount(kind >> 21, weights=-share * np.log(share), minlength=n)

    array = pa.array(texts, pa.string())
    words, lines = words_of(array), words_of(array, "\n")
    count = words.per_doc()
    some = np.maximum(count, 1).astype(float)
    distinct, _, repeats = sorted_counts((words.doc.astype(np.int64) << 32) | words.code)
    top = np.zeros(n)
    np.maximum.at(top, distinct >> 32, repeats)
    vocabulary, entry = code_points(words.vocabulary.to_pylist())
    known = len(words.vocabulary)
    has_letter = np.bincount(entry[letter_table()[vocabulary]], minlength=known) > 0
    plain = letter_table()[vocabulary] | np.isin(vocabulary, np.array([ord(c) for c in ".,;:'"], np.uint32))
    has_mark = np.bincount(entry[~plain], minlength=known) > 0
    line_keys, _, _ = sorted_counts((lines.doc.astype(np.int64) << 32) | lines.code)
    of_words = lambda flags: np.bincount(words.doc[flags[words.code]], minlength=n) / some
    return np.column_stack([
        np.log1p(np.bincount(doc, minlength=n)), np.log1p(count), np.minimum(np.bincount(doc[~white], minlength=n) / some, 40.0),
        per_doc(letter) / chars, per_doc(upper) / np.maximum(per_doc(letter), 1), per_doc(digit) / chars, marks / chars, per_doc(white) / chars,
        lines.per_doc() / some, per_doc(points < 128) / chars,
        np.bincount(distinct >> 32, minlength=n) / some, top / some, of_words(has_mark), of_words(~has_letter),
        np.bincount(line_keys >> 32, minlength=n) / np.maximum(lines.per_doc(), 1), entropy,
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in steps(np.array([len(t) for t in texts]), STEP):
            rows = statistics(texts[a:b])
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), lists], [*batch.schema.names[1:], "stats"])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and `stats` for every row of docs (text, ...)."""
    slim = docs.select("text", *keep)
    return slim.mapInArrow(_measure, ", ".join([*(f"`{n}` {t}" for n, t in slim.dtypes[1:]), "stats array<double>"]))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    cell_low: float
    cell_width: float
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return random_features((stats - self.mean) / self.scale, self.frequency, self.phase)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        at = (raw - self.cell_low) / self.cell_width - 0.5
        return np.interp(at, np.arange(len(self.calibrated)), self.calibrated)


def random_features(standard: np.ndarray, frequency: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Cosines at Gaussian frequencies: their inner products approximate a Gaussian kernel. The last column is 1."""
    waves = np.cos(np.clip(standard, -8, 8) @ frequency + phase) * np.sqrt(2.0 / frequency.shape[1])
    return np.column_stack([waves, np.ones(len(standard))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value (weighted squares), by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w2, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in pools]) if pools else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, *, features: int = FEATURES, ridge: float = 1.0, width: float = 4.0, seed: int = 7) -> QualityModel:
    """Learns from every row of stats (doc_id, stats) whose doc_id has a label (doc_id, quality 0 or 1; null and NaN labels are
    ignored, repeated ones averaged).

    Each task sums its normal equations, one set for each fold; a document's fold is a hash of its id. The
    calibration uses scores from the model of the other folds. Without labels every score is 0.5.
    """
    wanted = labels.where("quality IS NOT NULL AND NOT isnan(CAST(quality AS double)) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = written(stats.join(wanted, "doc_id").select("stats", "y", fold), "labelled")
    n = len(STATISTICS)
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    rng = np.random.default_rng(seed)
    frequency, phase = rng.normal(size=(n, features)) / width, rng.uniform(0, 2 * np.pi, features)
    if not sums["n"]:
        return QualityModel(np.zeros(n), np.ones(n), frequency, phase, np.zeros(features + 1), 0.0, 1.0, np.array([0.5]))
    mean = np.array([sums[f"m{i}"] for i in range(n)])
    scale = np.maximum(np.array([sums[f"s{i}"] for i in range(n)]), 1e-3)
    size = features + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for frame in frames:
            x = random_features((np.vstack(frame["stats"].to_numpy()) - mean) / scale, frequency, phase) if len(frame) else np.zeros((0, size))
            for f in range(FOLDS):
                own = frame["fold"].to_numpy() == f
                gram[f] += x[own].T @ x[own]
                right[f] += x[own].T @ frame["y"].to_numpy()[own]
        for f in range(FOLDS):
            yield pd.DataFrame({"fold": f, "i": np.arange(size), "row": [np.append(gram[f, i], right[f, i]) for i in range(size)]})

    partial = labelled.mapInPandas(equations, "fold int, i int, row array<double>")
    summed = partial.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    system = np.zeros((FOLDS, size, size + 1))  # FOLDS * size * (size + 1) numbers, whatever the corpus
    system[summed["fold"], summed["i"], summed["j"]] = summed["v"]
    whole = system.sum(axis=0)
    solve = lambda m: np.linalg.solve(m[:, :size] + ridge * np.diag(np.append(np.full(features, 1.0), 1e-6)), m[:, size])
    final, others = solve(whole), np.stack([solve(whole - system[f]) for f in range(FOLDS)])
    low, width_of_cell = -0.5, 2.0 / CELLS

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = random_features((np.vstack(frame["stats"].to_numpy()) - mean) / scale, frequency, phase)
                raw = np.einsum("ij,ij->i", x, others[frame["fold"].to_numpy()])
                cell = np.clip(np.floor((raw - low) / width_of_cell), 0, CELLS - 1).astype(int)
                yield pd.DataFrame({"cell": cell, "y": frame["y"].to_numpy()}).groupby("cell", as_index=False).agg(n=("y", "size"), y=("y", "sum"))

    counts = labelled.mapInPandas(cells, "cell int, n long, y double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("cell").toPandas()
    fitted = isotonic((counts["y"] / counts["n"]).to_numpy(), counts["n"].to_numpy())
    calibrated = np.interp(np.arange(CELLS), counts["cell"].to_numpy(), fitted)
    return QualityModel(mean, scale, frequency, phase, final, low, width_of_cell, calibrated)


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """stats (stats, more columns) with `score` instead of stats; every row stays."""
    send = stats.sparkSession.sparkContext.broadcast(model)
    others = [(n, t) for n, t in stats.dtypes if n not in ("stats", "score")]

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = send.value.score(np.vstack(frame["stats"].to_numpy())) if len(frame) else np.zeros(0)
            yield frame[[n for n, _ in others]].assign(score=score)

    return stats.select(*[n for n, _ in others], "stats").mapInPandas(predict, ", ".join([*(f"`{n}` {t}" for n, t in others), "score double"]))


def kept_by_score(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs (text, more columns) whose score is `least` or more, with all their columns, in one narrow pass."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, STEP)):
            score = send.value.score(statistics([t or "" for t in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(score >= least))

    return in_arrow(docs, run)


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    stats = written(measured(docs, ["doc_id", "held_out"]), "stats")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(stats.where(~F.col("held_out")).select("doc_id", "stats"), labels)
    return scored(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
