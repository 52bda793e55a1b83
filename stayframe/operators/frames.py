"""Projections, filters and reshaping of single frames. Nothing here moves rows between tasks but value_counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard columns of a time series, in their order.
SERIES_COLUMNS = {
    "recordtime": "timestamp_ntz", "recordtime_end": "timestamp_ntz", "recordtime_relative": "double", "recordtime_end_relative": "double",
    "value": "double", "value_unit": "string",
}
_MAGIC = re.compile(r"^!(isin|startswith|endswith)\(\s*([\w.]+)\s*,\s*\[(.*)\]\s*\)$", re.S)


_QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""")
_CAST = re.compile(r"\bcast(?=\s*\()", re.I)
_DAYS = re.compile(r"^_d(\d+)$")


_TYPE = re.compile(r"\s*(\w+(?:\s*\(\s*\d+\s*(?:,\s*\d+\s*)?\)|\s*<[\w\s:,<>`]*>)?)")
_CLOSING = {")": "(", "]": "["}


def _operand_start(sql: str, end: int, inside: list[bool]) -> int:
    """Where the operand that ends at `end` begins: a name, number, quoted text, bracketed expression or call, with its fields and
    elements."""
    at = end
    while at and sql[at - 1].isspace():
        at -= 1
    while at:
        c = sql[at - 1]
        if inside[at - 1]:  # quoted: back to its first character
            while at and inside[at - 1]:
                at -= 1
        elif c in _CLOSING:
            depth = 0
            while at:
                at -= 1
                depth += 0 if inside[at] else (sql[at] in _CLOSING) - (sql[at] in _CLOSING.values())
                if not depth:
                    break
        elif c.isalnum() or c in "_.":
            at -= 1
        else:
            break
    return at


def tolerant(sql: str) -> str:
    """The fragment with TRY_CAST for CAST and for `value::type`, outside of quotes, so that a value that can't be cast is null and
    doesn't end the job."""
    sql = "".join(part if i % 2 else _CAST.sub("TRY_CAST", part) for i, part in enumerate(_QUOTED.split(sql)))
    while True:
        inside = [bool(i % 2) for i, part in enumerate(_QUOTED.split(sql)) for _ in part]
        found = next((i for i in range(len(sql) - 1) if sql.startswith("::", i) and not inside[i]), None)
        kind = _TYPE.match(sql, found + 2) if found is not None else None
        if not kind:
            return sql
        start = _operand_start(sql, found, inside)
        sql = f"{sql[:start]}TRY_CAST({sql[start:found].strip()} AS {kind[1]}){sql[kind.end():]}"


def where_sql(df: DataFrame, where: str | None, admission: str = "hospital_admission") -> DataFrame:
    """df where a SQL condition holds; `_dN` stands for admissions in the first N times 30 days of the extract."""
    days = _DAYS.match(where.strip()) if where else None
    if days:
        return df.where(admission_days(int(days[1]), admission))
    return df.where(F.expr(tolerant(where))) if where else df


def select_sql(df: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """Columns from SQL fragments by alias; the filter sees the source's names. Casts that fail give null."""
    return where_sql(df, where).select(*[F.expr(tolerant(sql)).alias(alias) for alias, sql in columns.items()])


def in_order(df: DataFrame, keys: list[str], time: str = "recordtime") -> DataFrame:
    """df sorted by key and time, nulls first, for output that is read in order; a shuffle by ranges that nothing else needs."""
    return df.orderBy(*keys, *([time] if time in df.columns else []))


def admission_days(number: int, column: str = "hospital_admission", first: str = "2023-01-01") -> Column:
    """Admissions from the first day to the start of the day `number` times 30 days later, both included."""
    begin = F.lit(first).cast("timestamp_ntz")
    return F.col(column).between(begin, begin + F.make_dt_interval(F.lit(number * 30)))


def condition(text: str) -> Column:
    """A row filter: `!isin(c, [a, b])`, `!startswith(c, [a])`, `!endswith(c, [a])` or a SQL condition, in which casts that fail give
    null. Struct fields are named with dots."""
    magic = _MAGIC.match(text.strip())
    if not magic:
        if re.search(r"[<>]=?[^<>=!]*[\w.]+\s*[<>]=?", text) and " and " not in text.lower() and " or " not in text.lower():
            raise ValueError(f"chained comparison in {text!r}; write BETWEEN")
        return F.expr(tolerant(text))
    kind, column, listed = magic.groups()
    values = [v.strip().strip("'\"") for v in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s][^,]*", listed)]
    if kind == "isin":
        return F.col(column).cast("string").isin(*values)
    found = F.lit(False)
    for v in values:
        found = found | (F.col(column).startswith(v) if kind == "startswith" else F.col(column).endswith(v))
    return found


def apply_cleaning(df: DataFrame, bounds: dict[str, dict[str, float]], name: str | None = None) -> DataFrame:
    """Rows within inclusive bounds {column: {"low", "high"}}; nulls in a bounded column go. `name` stands for value."""
    for column, limit in bounds.items():
        c = F.col("value" if column == name and column not in df.columns else column)
        for side, test in (("low", c >= limit.get("low")), ("high", c <= limit.get("high"))) if limit else ():
            if limit.get(side) is not None:
                df = df.where(test)
    return df


def filter_by_condition(df: DataFrame, test: Column, mode: str = "drop") -> DataFrame:
    """Drops the rows for which test holds, or keeps only those; a null test doesn't hold."""
    holds = F.coalesce(test, F.lit(False))
    return df.where(~holds if mode == "drop" else holds)


def filter_by_values(df: DataFrame, wanted: dict[str, list[str]], *, exact: bool = True, rename: dict[str, str | None] | None = None) -> DataFrame:
    """Rows whose columns hold one of the wanted values (exact) or match one of them as a pattern; then renames columns, or
    drops those renamed to None."""
    for column, values in wanted.items():
        df = df.where(F.col(column).isin(*values) if exact else F.col(column).rlike("|".join(values)))
    rename = rename or {}
    return df.drop(*[c for c, to in rename.items() if to is None]).withColumnsRenamed({c: to for c, to in rename.items() if to})


def unnest(df: DataFrame, struct: str, *, prefix: str = "", suffix: str = "", renamer: Callable[[str], str] | None = None) -> DataFrame:
    """The fields of a struct as columns in its place."""
    name = renamer or (lambda x: f"{prefix}{x}{suffix}")
    fields = df.schema[struct].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != struct], *[F.col(struct)[f].alias(name(f)) for f in fields])


def build_attributes(df: DataFrame, prefix: str = "attributes_", name: str = "attributes") -> DataFrame:
    """All columns with the prefix folded into one struct, fields by name; without such columns df is unchanged."""
    parts = sorted(c for c in df.columns if c.startswith(prefix))
    if not parts:
        return df
    return df.select(*[c for c in df.columns if c not in parts], F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in parts]).alias(name))


def unify_columns(df: DataFrame, keys: list[str], standard: dict[str, str] = SERIES_COLUMNS) -> DataFrame:
    """Keys, then the standard columns (null where missing), then all others."""
    kinds = dict(df.dtypes)
    lead = [F.col(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in standard.items()]
    return df.select(*keys, *lead, *[c for c in df.columns if c not in standard and c not in keys])


def window_columns(obs: DataFrame, keys: list[str], window) -> DataFrame:
    """Keys with the window's bounds as tmin and tmax."""
    low, high = window.bounds()
    return obs.select(*keys, low.cast("timestamp_ntz").alias("tmin"), high.cast("timestamp_ntz").alias("tmax"))


def value_counts(df: DataFrame, columns: list[str], *, decimals: int = 1, by_count: bool = True) -> DataFrame:
    """Count and percentage of all rows for each combination of values (nulls included), most frequent first."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    shared = counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("count") / F.col("__total"), decimals))
    order = [F.desc("count"), *columns] if by_count else list(columns)
    return shared.drop("__total").orderBy(*order)


def struct_measurement(df: DataFrame, column: str, keep: list[str], unit: str | None = None) -> DataFrame:
    """A struct measurement as value, attributes (its other fields) and value_unit; rows without it go."""
    fields = [f for f in df.schema[column].dataType.fieldNames() if f not in ("value", "unit")]
    m = F.col(column)
    attributes = [F.struct(*[m[f].alias(f) for f in fields]).alias("attributes")] if fields else []
    return df.where(m.isNotNull()).select(*keep, m["value"].alias("value"), F.lit(unit).alias("value_unit"), *attributes)


def calculated(df: DataFrame, expression: str, keep: list[str], where: str | None = None) -> DataFrame:
    """Key columns and a value calculated from several columns, filtered before."""
    return select_sql(df, {**{k: f"`{k}`" for k in keep}, "value": expression}, where)
