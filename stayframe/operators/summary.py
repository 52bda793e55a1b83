"""Baseline tables and group summaries: everything is one aggregate per kind of column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import Offset, fixed_micros

OVERALL = "Overall"
QUARTILES = (0.25, 0.5, 0.75)
IGNORED_KINDS = ("timestamp", "timestamp_ntz", "date", "struct", "array", "map", "binary")


def column_kinds(df: DataFrame, skip: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns; times, nested columns and those in skip are in neither."""
    numeric, other = [], []
    for c, t in df.dtypes:
        if c in skip or t.startswith(IGNORED_KINDS):
            continue
        (numeric if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else other).append(c)
    return numeric, other


def table_one_counts(df: DataFrame, columns: list[str], by: str | None = None, *, overall: bool = True, relabel_booleans: bool = True) -> DataFrame:
    """(grp, variable, level, n, percent) of categorical columns; level null counts missing values and has no percentage."""
    kinds = dict(df.dtypes)
    text = lambda c: (F.when(F.col(c), "Yes").when(~F.col(c), "No") if relabel_booleans and kinds[c] == "boolean" else F.col(c).cast("string"))
    long = df.select(_groups(by, overall), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), text(c).alias("level")) for c in columns])).alias("x"))
    counts = long.groupBy("grp", "x.variable", "x.level").agg(F.count(F.lit(1)).alias("n"))
    known = F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).over(Window.partitionBy("grp", "variable"))
    return counts.select("grp", "variable", "level", "n", F.when(F.col("level").isNotNull(), F.round(100 * F.col("n") / known, 1)).alias("percent"))


def _groups(by: str | None, overall: bool) -> Column:
    own = [F.coalesce(F.col(by).cast("string"), F.lit("Missing"))] if by else []
    return F.explode(F.array(*own, *([F.lit(OVERALL)] if overall or not by else []))).alias("grp")


#: Values of a sketch: the rank of an approximate percentile is off by a share of 1 / SKETCH at most.
SKETCH = 1000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = QUARTILES, also: dict[str, Column] | None = None, nearest: tuple[int, ...] = ()) -> DataFrame:
    """keys and `cuts`, the exact percentiles of value (nulls left out), in two scans however many values a key has. They are
    interpolated, but for those whose places in points are in nearest: these are the value of the nearest rank, halves up.

    The first scan makes a mergeable sketch for each key; its approximate percentiles a little below and above each point bracket the
    exact one for sure. The second counts what lies below each bracket, and how often each value inside it occurs: a few
    thousandths of the rows, and the only values that are ranked. Keys without a value have null cuts. also holds aggregates that the first
    scan takes along, over df's own columns and the value as `v`.
    """
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    names, margin = list(named.values()), 2 / SKETCH
    plain = df.select("*", *[F.col(k).alias(n) for k, n in named.items()], F.col(value).cast("double").alias("v"))
    ends = [x for p in points for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(SKETCH))
    first = plain.groupBy(*names).agg(F.count("v").alias("all"), sketch.alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"), *[c.alias(n) for n, c in (also or {}).items()])
    few = F.col("all") <= SKETCH  # the margin is less than a rank: all values are inside
    low = [F.when(few | F.lit(p <= margin), F.col("least")).otherwise(F.get("ends", F.lit(2 * i))) for i, p in enumerate(points)]
    high = [F.when(few | F.lit(p >= 1 - margin), F.col("most")).otherwise(F.get("ends", F.lit(2 * i + 1))) for i, p in enumerate(points)]
    brackets = first.select(*names, F.array(*[F.struct(lo.alias("low"), hi.alias("high")) for lo, hi in zip(low, high, strict=True)]).alias("brackets"), "all")

    def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        other = right.withColumnsRenamed({c: f"{c}_too" for c in names})
        test = F.lit(True)
        for c in names:
            test = test & F.col(c).eqNullSafe(F.col(f"{c}_too"))
        return left.join(other, test, how).drop(*[f"{c}_too" for c in names])

    # a value above the bracket of a point says nothing about it; one below only counts
    where = F.transform("brackets", lambda b, i: F.struct(i.alias("point"), F.when(F.col("v") >= b["low"], F.col("v")).alias("inside"), (F.col("v") <= b["high"]).alias("counts")))
    met = beside(plain.where("v IS NOT NULL").select(*names, "v"), brackets.where("all > 0"))
    each = met.select(*names, F.explode(F.filter(where, lambda x: x["counts"])).alias("x")).select(*names, "x.point", "x.inside")
    counted = each.groupBy(*names, "point", "inside").agg(F.count(F.lit(1)).alias("n"))  # what lies below is one row
    so_far = F.sum("n").over(Window.partitionBy(*names, "point").orderBy(F.asc_nulls_first("inside")))
    ranked = beside(counted.withColumn("upto", so_far), brackets.select(*names, "all"))
    of_point = F.element_at(F.array(*map(F.lit, points)), F.col("point") + 1)
    exact = of_point * (F.col("all") - 1)
    rank = F.when(F.col("point").isin(*nearest), F.floor(exact + 0.5).cast("double")).otherwise(exact) if nearest else exact
    place = ranked.withColumn("place", rank).withColumn("before", F.col("upto") - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("inside")))
    found = place.groupBy(*names, "point").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    cut = F.when(F.col("part") == 0, F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    cuts = found.groupBy(*names).agg(*[F.max(F.when(F.col("point") == i, cut)).alias(f"cut{i}") for i in range(len(points))])
    whole = beside(first, cuts, "left")
    array = F.when(F.col("all") > 0, F.array(*[F.col(f"cut{i}") for i in range(len(points))]))
    return whole.select(*[F.col(n).alias(k) for k, n in named.items()], array.alias("cuts"), *(also or {}))


def table_one_numbers(df: DataFrame, columns: list[str], by: str | None = None, *, overall: bool = True) -> DataFrame:
    """(grp, variable, n, missing, mean, sd, median, q1, q3) of numeric columns, in the two scans of exact_percentiles."""
    return _numbers(df, columns, by, overall).drop("lowest", "highest")


def _numbers(df: DataFrame, columns: list[str], by: str | None, overall: bool) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(_groups(by, overall), *columns).select("grp", each.alias("x")).select("grp", "x.variable", F.col("x.v").alias("number"))
    also = {"n": F.count("number"), "missing": F.count_if(F.col("number").isNull()), "mean": F.avg("number"), "sd": F.stddev_samp("number"), "lowest": F.min("number"), "highest": F.max("number")}
    cut = lambda i, name: F.get("cuts", F.lit(i)).alias(name)
    found = exact_percentiles(long, ["grp", "variable"], "number", also=also)
    return found.select("grp", "variable", "n", "missing", "mean", "sd", cut(1, "median"), cut(0, "q1"), cut(2, "q3"), "lowest", "highest")


def table_one(df: DataFrame, by: str | None = None, *, overall: bool = True, skip: list[str] | None = None, as_mean: list[str] | None = None, decimals: int = 1) -> DataFrame:
    """(variable, level, grp, text): median [Q1, Q3] or, for columns in as_mean, mean (SD) of numbers; n (percent) of the rest."""
    numeric, categorical = column_kinds(df, [*(skip or []), *([by] if by else [])])
    parts = []
    number = lambda c: F.format_number(c, decimals)
    if numeric:
        rows = table_one_numbers(df, numeric, by, overall=overall)
        mean = F.concat(number(F.col("mean")), F.lit(" ("), number(F.col("sd")), F.lit(")"))
        median = F.concat(number(F.col("median")), F.lit(" ["), number(F.col("q1")), F.lit(", "), number(F.col("q3")), F.lit("]"))
        parts.append(rows.select("variable", F.lit("").alias("level"), "grp", F.coalesce(F.when(F.col("variable").isin(*(as_mean or [])), mean).otherwise(median), F.lit("")).alias("text")))
        parts.append(rows.where("missing > 0").select("variable", F.lit("Missing").alias("level"), "grp", F.col("missing").cast("string").alias("text")))
    if categorical:
        rows = table_one_counts(df, categorical, by, overall=overall)
        text = F.when(F.col("level").isNull(), F.col("n").cast("string")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" ("), number(F.col("percent")), F.lit(")")))
        parts.append(rows.select("variable", F.coalesce("level", F.lit("Missing")).alias("level"), "grp", text.alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def render(table: DataFrame, kind: str = "markdown") -> str:
    """A finished table one as markdown, html or latex text. The rows are as many as variables and levels."""
    rows = table.collect()
    groups = sorted({r["grp"] for r in rows}, key=lambda g: (g != OVERALL, g))
    cells = {(r["variable"], r["level"], r["grp"]): r["text"] for r in rows}
    lines = [[v, lv, *[cells.get((v, lv, g), "") for g in groups]] for v, lv in sorted({(r["variable"], r["level"]) for r in rows})]
    head = ["", "", *groups]
    if kind == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *lines])
    if kind == "html":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in [head, *lines]) + "</table>"
    if kind == "latex":
        safe = lambda c: c.replace("%", "\\%").replace("_", "\\_").replace("&", "\\&")
        return "\\begin{tabular}{" + "l" * len(head) + "}\n" + "\n".join(" & ".join(map(safe, x)) + " \\\\" for x in [head, *lines]) + "\n\\end{tabular}"
    raise ValueError(f"unknown format {kind!r}")


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(v).alias("mean"), F.count_distinct(v).alias("distinct_values"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.count_if(v.isNull()).alias("nulls"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, missing, mean, sd, median, q1, q3) and the range, without groups."""
    return _numbers(df, columns, None, True).drop("grp")


def binned_course(df: DataFrame, by: list[str], seconds: Column, value: str, every: Offset = "6h") -> DataFrame:
    """Median, quartiles and count of value by group and time bin (whole bins since time zero)."""
    width = fixed_micros(every) // 1_000_000
    binned = df.select(*by, F.floor(seconds / width).alias("bin"), F.col(value).alias("__value"))
    found = exact_percentiles(binned, [*by, "bin"], "__value", also={"n": F.count("__value")})
    return found.select(*by, "bin", "n", F.get("cuts", F.lit(1)).alias("median"), F.get("cuts", F.lit(0)).alias("q1"), F.get("cuts", F.lit(2)).alias("q3"))


def prevalence(df: DataFrame, flags: list[str], top: int = 8) -> DataFrame:
    """The flags (0/1 or boolean columns) with the highest share, ties by name."""
    shares = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("share")) for f in flags])).alias("x")).select("x.*")
    return long.orderBy(F.desc_nulls_last("share"), "flag").limit(top)


def share_within(df: DataFrame, group: list[str], level: str) -> DataFrame:
    """Rows of each level and their share of the group."""
    counts = df.groupBy(*group, level).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def top_one(df: DataFrame, value: str, tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), tiebreak).limit(1)


def reason_overlaps(df: DataFrame, reasons: dict[str, Column], key: str | None = None) -> DataFrame:
    """(reasons, n_reasons, rows[, keys]): how many rows each combination of reasons applies to, those without any included. A null
    test doesn't apply. One pass: a row's combination is one number, by which rows are counted before they are shuffled."""
    if not 0 < len(reasons) < 63:
        raise ValueError("name 1 to 62 reasons")
    bits = F.lit(0).cast("long")
    for i, test in enumerate(reasons.values()):
        bits = bits + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    keys = [F.count_distinct(key).alias("keys")] if key else []
    counts = df.groupBy(bits.alias("__bits")).agg(F.count(F.lit(1)).alias("rows"), *keys)
    named = F.array_compact(F.array(*[F.when(F.col("__bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, name in enumerate(reasons)]))
    return counts.select(named.alias("reasons"), F.bit_count("__bits").alias("n_reasons"), "rows", *(["keys"] if key else []))


def composition_change(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: keys that stayed, came and went, and rows before and after (more than keys, if keys repeat). Null is a key. Keys are
    counted by side before they are shuffled, and meet no other column."""
    side = lambda df, old: df.select(F.col(key).alias("k"), F.lit(int(old)).cast("long").alias("old"), F.lit(int(not old)).cast("long").alias("new"))
    met = side(before, True).unionByName(side(after, False)).groupBy("k").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    count = lambda test: F.count_if(F.expr(test))
    return met.agg(
        count("old > 0 AND new > 0").alias("stayed"), count("old = 0").alias("came"), count("new = 0").alias("went"),
        F.coalesce(F.sum("old"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("new"), F.lit(0)).alias("rows_after"),
    )
