"""From raw documents to shuffled, mixed and encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Files don't keep the order of rows when they are read, so
the last stage returns each document's place in the mixture.

In every stage an empty table gives an empty table, null columns other than those named stay as they are, and columns that are none of
documents' own are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.llm import langid, minhash, mixing, pieces, quality
from stayframe.llm.common import quoted, read_table, ship, written

#: A document goes if its language is undetermined or its languages together have a smaller share than this.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language set stands out. Repeated rows stay or go together."""
    ship(spark)
    return langid.kept_by_language(docs, langid.train(docs), LEAST_SHARE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels of these documents, scores below 0.5. Repeated rows stay or go
    together; without labels every score is 0.5, and all stay."""
    stats = quality.measured(docs, ["doc_id"])
    model = quality.train(stats, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.kept_by_score(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates, one row of repeated ones (equal id and text, the
    one that comes first written as JSON), and all rows without an id."""
    columns = [quoted(c) for c in docs.columns]
    ship(spark)
    classes = minhash.near_duplicate_classes(docs.select("doc_id", "text"))
    left = docs.join(classes.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*columns)
    key = [F.col("doc_id"), F.xxhash64("text")]
    seen = left.where("doc_id IS NOT NULL").groupBy(key[0].alias("__id"), key[1].alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = written(seen.where("__n > 1").drop("__n"), "repeated")
    if not repeated.head(1):
        return left
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    once = left.join(repeated, same).groupBy("__id", "__text").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("__row"))
    return left.join(repeated, same, "left_anti").union(once.select("__row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of the mixture; every one stays, repeated ones too."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    mixed = mixing.mix_sources(docs, mixing.tempered_weights(docs), prefix=prefix)
    return mixed.orderBy(F.asc_nulls_last(f"{prefix}slot"), f"{prefix}rank").select(*map(quoted, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts with merge-dropout, whether they decode to the text, and the place in the mixture: reading by
    (mix_slot, mix_rank), slots that are null last, is the mixture, however docs come. A null text has null ids; repeated rows stay."""
    ship(spark)
    slim = docs.select("doc_id", "text", "lang", "source")
    mixed = mixing.mix_sources(slim, mixing.tempered_weights(slim))
    placed = written(mixed.select(*slim.columns, "mix_slot", "mix_rank"), "placed")
    return pieces.round_trip(placed, pieces.load(), ["doc_id", "lang", "source", "mix_slot", "mix_rank"])


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: SQL expresses neither the models nor the merges; tests/llm/test_llm_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
