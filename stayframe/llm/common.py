"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Rows of text that Spark hands to a Python worker at once. Texts can be long, and both sides hold a batch in memory.
BATCH_ROWS = 1000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one bucket of a ranking holds on the average.
BUCKET_ROWS = 50_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that tasks can import it wherever they run, and
    lowers the session's Arrow batch size to BATCH_ROWS if it is larger."""
    batch_size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch_size)) <= BATCH_ROWS:
        spark.conf.set(batch_size, BATCH_ROWS)
    package, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app not in _SHIPPED and package.is_dir():
        _SHIPPED.add(app)
        base = Path(tempfile.mkdtemp(prefix="spark-ship-")) / package.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; whoever reads one is about to run tasks of this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder
    of its own, and a cluster, whose executors would each write to their own disk, an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table of its own in the shared folder and reads it back.

    Nothing depends on the shuffles of that write any longer, so Spark is told to remove them as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stayframe/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing will read any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """A column by its name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: list[StructField] | None = None) -> DataFrame:
    """df.mapInArrow for columns of any name: run gets batches with df's columns and returns some with these and the added ones after
    them. mapInArrow itself looks columns up by name, which fails for names with dots or back-ticks, so Spark sees numbered ones."""
    fields = [*df.schema.fields, *(added or [])]
    numbered = lambda n: [f"c{i}" for i in range(n)]
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(numbered(batch.num_columns))

    schema = StructType([StructField(n, f.dataType) for n, f in zip(numbered(len(fields)), fields, strict=True)])
    return df.toDF(*numbered(len(names))).mapInArrow(renamed, schema).toDF(*[f.name for f in fields])


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the fold that models must not learn from: crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """The first hexadecimal digits of an md5 digest as an int; bucket order agrees with digest order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def digits_for(rows: int) -> int:
    """Hexadecimal digits that give buckets of about BUCKET_ROWS rows, 3 at least."""
    return max(3, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 3


def row_digest(seed: str, doc_id: Column, text_hash: Column) -> Column:
    """The md5 digest that orders rows: of seed and doc_id, or of the text's hash where doc_id is null, so that rows without id spread."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text_hash.cast("string"), F.lit(""))))).cast("binary"))


def ranked(df: DataFrame, key: str, digest: str, order: list[str], size: str | None = None, digits: int = 3) -> DataFrame:
    """Adds `__rank` (from 0, gapless in each key) and, with size, `__before` (the sum of the sizes that
    come first), both in the order of (digest, order).

    A key may hold any share of the rows: rows are ranked inside (key, digest bucket), and the small table
    of bucket totals gives each bucket its offset. key and digest must not be null. digits_for gives digits for a number of rows.
    """
    size_of = F.col(size) if size else F.lit(0)
    split = df.withColumn("__bucket", hash_bucket(F.col(digest), digits))
    totals = split.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum(size_of).alias("__s"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(key).alias("__key"),
        F.col("__bucket").alias("__of"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
    )
    inside = Window.partitionBy(key, "__bucket").orderBy(digest, *order)
    placed = split.withColumns(
        {
            "__rank": F.row_number().over(inside) - 1,
            "__before": F.sum(size_of).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size_of,
        }
    )
    joined = placed.join(offsets, (placed[key] == offsets["__key"]) & (placed["__bucket"] == offsets["__of"]))
    out = joined.withColumns({"__rank": F.col("__rank") + F.col("__n0"), "__before": F.col("__before") + F.col("__s0")})
    return out.drop("__bucket", "__key", "__of", "__n0", "__s0", *([] if size else ["__before"]))


BITMAP = 32_768


def maybe_in(df: DataFrame, key: str, keys: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of df whose key may occur in keys (key): all that do, and few others. A filter ahead of a join, so that wide
    rows that can't match aren't shuffled.

    Keys set bits of a bitmap of 16 bits a key, most_bits (16 MB) at most, and only the bitmap is broadcast. With very many
    keys it fills up and lets more rows through, which the join then drops.
    """
    bits = BITMAP
    count = keys.count()
    while bits < min(16 * count, most_bits):
        bits *= 2
    place = lambda: F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    bitmaps = keys.select(place().alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    placed = df.withColumns({"__of": F.bitmap_bucket_number(place()), "__at": F.bitmap_bit_position(place())})
    byte = F.conv(F.hex(F.expr("substring(__bits, CAST(__at div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("getbit(__byte, CAST(__at % 8 AS int))") == 1
    found = placed.join(F.broadcast(bitmaps), "__of").withColumn("__byte", byte).where(is_set)
    return found.drop("__of", "__at", "__bits", "__byte")
