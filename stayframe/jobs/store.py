"""Saved cohorts: every save is a new generation of tables, and a small commit record makes it the one that counts.

    folder/generations/<number>-<id>/obs, .../series/<name>     tables, never written over
    folder/commits/commit=<number>/                            one line: what the tables must hold, with its own checksum

A save that dies leaves tables that no record names, so the cohort before it stays the current one, and saving into the folder
that a cohort was read from doesn't touch the files that it still reads. The record holds each table's schema, row count and
a sum of the hashes of its keys, all read back from the files, which `load` compares with what it finds.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import shared_folder

__all__ = ["DamagedCohort", "commits", "forget_older", "load_tables", "save_tables", "shared_folder"]


class DamagedCohort(ValueError):
    """The files of a saved cohort aren't those that its record tells of."""


def table_facts(df: DataFrame, key: str) -> dict:
    """Rows and the order-free sum of the keys' hashes (null without the key): one scan of one column."""
    total = F.sum(F.xxhash64(key).cast("decimal(38,0)")) if key in df.columns else F.lit(None).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("rows"), total.alias("key_sum")).first()
    return {"rows": found["rows"], "key_sum": None if found["key_sum"] is None else str(found["key_sum"])}


@dataclass(frozen=True)
class Buckets:
    """Tables of one cohort dealt by the observation key into so many files, each sorted by it."""

    key: str
    count: int

    def write(self, df: DataFrame, path: str) -> None:
        """A table of the catalog for as long as it is being written; what stays are its files."""
        spark, name = df.sparkSession, f"stayframe_{uuid.uuid4().hex}"
        try:
            df.repartition(self.count, self.key).write.format("parquet").bucketBy(self.count, self.key).sortBy(self.key).option("path", path).saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    def read(self, spark: SparkSession, path: str, schema: StructType) -> DataFrame:
        """The files as a table that Spark knows to be dealt by the key; its name stays in the session's catalog."""
        name, key = f"stayframe_{uuid.uuid4().hex}", f"`{self.key}`"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        at = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.count} BUCKETS LOCATION '{at}'")
        return spark.table(name)


def _digest(record: str) -> str:
    return hashlib.sha256(record.encode()).hexdigest()


def commits(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The records that are whole, by number."""
    try:
        lines = spark.read.schema("value string, commit long").text(f"{folder}/commits").collect()  # one line a save
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    found = {}
    for line in lines:
        try:
            outer = json.loads(line["value"])
            if _digest(outer["record"]) == outer["sha256"]:
                found[line["commit"]] = json.loads(outer["record"])
        except (ValueError, KeyError, TypeError):
            continue  # a record that was being written
    return found


def save_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], key: str, meta: dict, buckets: int | None = None) -> int:
    """Writes the tables as a new generation, then its record. The number is one above all before; if another save took it
    meanwhile, this one ends with an error and the other stays."""
    number = max(commits(spark, folder), default=0) + 1
    place = f"generations/{number:08d}-{uuid.uuid4().hex}"
    entries = {}
    for name, df in tables.items():
        path, dealt = f"{place}/{quote(name, safe='')}", bool(buckets) and key in df.columns
        if dealt:
            Buckets(key, buckets).write(df, f"{folder}/{path}")
        else:
            df.write.parquet(f"{folder}/{path}")
        back = spark.read.schema(df.schema).parquet(f"{folder}/{path}")
        entries[name] = {"path": path, "schema": df.schema.jsonValue(), "buckets": buckets if dealt else None, **table_facts(back, key)}
    record = json.dumps({"key": key, "tables": entries, "meta": meta})
    line = json.dumps({"record": record, "sha256": _digest(record)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/commits/commit={number}")
    return number


def load_tables(spark: SparkSession, folder: str, generation: int | None = None, *, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """The tables and meta of a generation, the last one by default. With verify, rows and keys must be those of the record."""
    known = commits(spark, folder)
    if not known or (generation is not None and generation not in known):
        raise FileNotFoundError(f"no saved cohort {'' if generation is None else generation} in {folder}")
    record = known[max(known) if generation is None else generation]
    tables, wrong = {}, []
    for name, entry in record["tables"].items():
        schema, path = StructType.fromJson(entry["schema"]), f"{folder}/{entry['path']}"
        try:
            df = Buckets(record["key"], entry["buckets"]).read(spark, path, schema) if entry["buckets"] else spark.read.schema(schema).parquet(path)
            if verify and (facts := table_facts(df, record["key"])) != {k: entry[k] for k in ("rows", "key_sum")}:
                wrong.append(f"{name} has {facts['rows']} rows, {entry['rows']} were saved, or other keys")
        except AnalysisException as e:
            wrong.append(f"{name} can't be read: {str(e).splitlines()[0]}")
        else:
            tables[name] = df
    if wrong:
        raise DamagedCohort("; ".join(wrong))
    return tables, record["meta"]


def forget_older(spark: SparkSession, folder: str, keep: int = 1) -> list[int]:
    """Deletes all but the last `keep` generations, and what saves before those left behind. Nobody may still read them."""
    known = sorted(commits(spark, folder))
    if len(known) <= keep or keep < 1:
        return []
    first, path = known[-keep], spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for number in (n for n in known if n < first):  # records first: a generation without one is nobody's
        store.delete(path(f"{folder}/commits/commit={number}"), True)
    for status in store.listStatus(path(f"{folder}/generations")):
        if int(status.getPath().getName().split("-")[0]) < first:
            store.delete(status.getPath(), True)
    return [n for n in known if n < first]
