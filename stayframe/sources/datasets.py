"""Reading datasets described by a manifest, lookup tables and harmonised measurement files; uniting sources."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import where_sql


@dataclass(frozen=True)
class Dataset:
    name: str
    reference_now: str | None
    tables: dict[str, DataFrame]

    def register(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def checked_path(file: str) -> str:
    """A relative path of a Parquet file below the dataset's folder; anything else is refused."""
    path = PurePosixPath(file)
    if not file or "\\" in file or "://" in file or ":" in file.split("/")[0] or path.is_absolute() or ".." in path.parts or path.suffix != ".parquet":
        raise ValueError(f"not a Parquet file below the dataset's folder: {file!r}")
    return str(path)


def read_dataset(spark: SparkSession, path: str, manifest: str = "manifest.json") -> Dataset:
    """Reads {path}/manifest.json ({"dataset", "reference_now", "tables": {name: {"files": [...]}}}) through Spark, so any
    store will do, and each table's files lazily."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/{manifest}", wholetext=True).collect())  # one small file
    found = json.loads(text)
    tables = {}
    for name, table in found.get("tables", {}).items():
        files = [f"{path}/{checked_path(f)}" for f in table["files"]]
        if not files:
            raise ValueError(f"table {name} has no files")
        tables[name] = spark.read.parquet(*files)
    return Dataset(found.get("dataset", ""), found.get("reference_now"), tables)


def read_measurements(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Only the wanted columns and rows; both reach the scan. A value that the condition can't cast is null."""
    return where_sql(spark.read.parquet(path), where).select(*columns)


def read_mapping_csv(spark: SparkSession, path: str, key: str, target: str) -> DataFrame:
    """A lookup table with text keys (leading zeros stay)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select(F.col(key).cast("string").alias("prefix"), F.col(target).alias("target"))


def unite(frames: dict[str, DataFrame], source: str | None = "data_source") -> DataFrame:
    """Frames of several sources under one another by name: missing columns are null, numbers widen, and a column that
    is a list of strings in one source becomes one in all."""
    kinds: dict[str, set[str]] = {}
    for df in frames.values():
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    lists = {c for c, t in kinds.items() if t == {"string", "array<string>"}}
    out = None
    for name, df in frames.items():
        own = dict(df.dtypes)
        wrap = {c: F.when(F.col(c).isNotNull(), F.array(c)) for c in lists if own.get(c) == "string"}
        part = df.withColumns(wrap) if wrap else df
        part = part.withColumn(source, F.lit(name)) if source else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def choose_sources(df: DataFrame, column: str, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    df = df.where(F.col(column).isin(*include)) if include else df
    return df.where(~F.col(column).isin(*exclude)) if exclude else df


def normalize_source(df: DataFrame, mapping: dict[str, str], *, sex: str | None = "sex", flags: list[str] | None = None, length_of_stay: str | None = None, admission: str | None = None, discharge: str = "icu_discharge") -> DataFrame:
    """Columns of a harmonised source under standard names. Male and Female become M and F, flags booleans; without
    admission times a stay begins on 1900-01-01, and it ends its length in days later."""
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    out = df.select(*[F.col(old).alias(new) for old, new in mapping.items()])
    if sex and sex in out.columns:
        out = out.withColumn(sex, F.when(F.col(sex) == "Male", "M").when(F.col(sex) == "Female", "F").otherwise(F.col(sex)))
    out = out.withColumns({f: F.col(f).cast("boolean") for f in flags or []}) if flags else out
    start = admission or "icu_admission"
    if start not in out.columns:
        out = out.withColumn(start, F.lit("1900-01-01").cast("timestamp_ntz"))
    if length_of_stay:
        seconds = (F.col(length_of_stay) * 86400).cast("decimal(18,6)")
        out = out.withColumn(discharge, F.col(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))
    return out
