"""Ordered pattern rules over text columns: the first rule that fits gives class, confidence and rule name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_text


@dataclass(frozen=True)
class Rule:
    """Fits if every pattern of `all_of` {column: pattern} is found and, if given, each flag column has the wanted value."""

    name: str
    label: str
    confidence: str
    all_of: dict[str, str]
    flags: dict[str, bool] | None = None
    subtype: str | None = None


def classify_by_rules(df: DataFrame, rules: list[Rule], texts: list[str], flags: list[str] | None = None, default: str = "unknown") -> DataFrame:
    """df with class, confidence, rule and subtype. Rules look at one row only, so nothing is shuffled; each text is normalised once."""
    asked = {c for r in rules for c in r.flags or {}}
    if not asked <= set(flags or []):
        raise ValueError(f"rules ask for flags {sorted(asked)} that aren't named")
    others = df.drop("class", "confidence", "rule", "subtype")
    plain = others.withColumn("__plain", F.struct(*[normalize_text(F.col(t)).alias(t) for t in texts]))
    none = F.lit(None).cast("string")
    chain = None
    for r in rules:
        fits = F.lit(True)
        for column, pattern in r.all_of.items():
            fits = fits & F.col("__plain")[column].rlike(pattern)
        for column, wanted in (r.flags or {}).items():
            fits = fits & F.coalesce(F.col(column) == wanted, F.lit(False))
        found = F.struct(F.lit(r.label).alias("class"), F.lit(r.confidence).alias("confidence"), F.lit(r.name).alias("rule"), (F.lit(r.subtype) if r.subtype else none).alias("subtype"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    other = F.struct(F.lit(default).alias("class"), F.lit("none").alias("confidence"), none.alias("rule"), none.alias("subtype"))
    named = plain.withColumn("__found", chain.otherwise(other) if chain is not None else other)
    return named.select(*others.columns, "__found.*")
