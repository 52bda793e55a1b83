"""Fill-in-middle transformation by repeated-capture matching.

A text is cut into units, each a word with the white space before it (or white space that ends the text). One fullmatch of
(unit)* by the regex library keeps every repetition of its group, so `match.ends(1)` holds the end of every unit: its length is
the number of units, and two of its entries are the places to cut at. Python tells only those three numbers; texts are put
together by Spark.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Possessive, so that a match of a long text keeps no places to go back to; what is matched first is right anyway.
UNITS = regex.compile(r"((?>[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++))*+")
CUTS = "n long, prefix_end int, middle_end int"


def cuts_of(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """The number of units, and the ends in code points of the first h1 % (n + 1) and h2 % (n + 1) of them, the smaller first."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


def unit_cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = [cuts_of(t.as_py() or "", a, b) for t, a, b in zip(text, h1.to_pylist(), h2.to_pylist(), strict=True)]
    n, first, second = zip(*found, strict=True) if found else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.int32()), pa.array(second, pa.int32())], ["n", "prefix_end", "middle_end"])


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs (doc_id, text, more columns) with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if
    plain), and output.

    `rate` of 100 documents are cut, of them `spm` of 100 with the suffix first; a hash of seed and doc_id decides, so every run
    gives the same output and repeated ids the same choices. Texts that are empty or hold a mark stay plain, so that `restored` is
    always exact. A null text counts as empty, a null doc_id as an empty one; columns of docs with those five names are replaced,
    all others kept. Every row stays; an empty table gives an empty table. Nothing is shuffled, and a task holds one text at a time in
    Python.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), F.lit("plain")).when(h[3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    work = "__fim"
    while any(c.startswith(work) for c in docs.columns):
        work = f"_{work}"
    known = docs.withColumn(work, F.arrow_udf(unit_cuts, CUTS)(text, h[0], h[1])).withColumn(f"{work}_form", form)
    p, m = F.col(f"{work}.prefix_end"), F.col(f"{work}.middle_end")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m - p), F.substring(text, m + 1, F.length(text))
    chosen = F.col(f"{work}_form")
    output = (
        F.when(chosen == "plain", text)
        .when(chosen == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    cut = chosen != "plain"
    made = {"n": F.col(f"{work}.n"), "form": chosen, "prefix_chars": F.when(cut, p).cast("long"), "middle_chars": F.when(cut, m - p).cast("long"), "output": output}
    return known.withColumns(made).drop(work, f"{work}_form")


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: no part of a cut text holds a mark, nor do a part and a mark make one together."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut
"""
