"""A cohort: observations, their time series, and the log of what was selected."""

from __future__ import annotations

import inspect
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import TimeWindow, clip_timestamps
from ..levels import ObsLevel, level_named
from ..operators import frames, joins, outcomes, summary
from ..operators.aggregates import Feature, snapshot, static_features
from . import store


@dataclass(frozen=True)
class Requirement:
    """A required variable, the window to load it in, and fields of its spec that are other ones for this requirement only."""

    variable: str
    window: str | tuple[str, str] | TimeWindow | None = "inherit"
    changes: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class DynamicSpec:
    """A time series: a base table with SQL columns and filters, looked up by a join key, optional user function,
    cleaning bounds and derived attributes.

    requires names other variables, as a tuple (loaded in the same window) or as {name: rule}, a rule being a Requirement or the
    window of one (see required_window). A name that is a column of the observations is served from there, whatever the window;
    others are loaded in the window asked for. function is called with as many as it takes of: the extracted rows, the required frames
    by name, the observations; a derived series without a base table gets None for rows. sources restricts what is required to these
    values of `data_source`. constant gives every observation one value at the start of its window. frozen keeps the spec's own window
    whatever window is asked for; levels are those it may be loaded at (empty: all). extractor, in place of columns and where, makes
    the rows from (base, observations).
    """

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    join_key: str | None = None
    window: TimeWindow | None = None
    cleaning: dict[str, dict[str, float]] = field(default_factory=dict)
    function: Callable[..., DataFrame] | None = None
    requires: tuple[str, ...] | Mapping[str, Requirement | str | tuple[str, str] | TimeWindow | None] = ()
    constant: float | str | None = None
    frozen: bool = False
    levels: tuple[str, ...] = ()
    extractor: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    sources: tuple[str, ...] = ()

    def rules(self) -> dict[str, Requirement]:
        """What is required, by the name under which the function gets it."""
        given = self.requires if isinstance(self.requires, Mapping) else dict.fromkeys(self.requires, "inherit")
        return {name: rule if isinstance(rule, Requirement) else Requirement(name, rule) for name, rule in given.items()}


def overridden(spec: dict, changes: dict) -> dict:
    """spec with changes merged in, level by level."""
    out = dict(spec)
    for k, v in changes.items():
        out[k] = overridden(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolved_order(requires: dict[str, tuple[str, ...]]) -> list[str]:
    """Names so that each comes after what it requires; a cycle is an error."""
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"variables require each other: {' -> '.join((*path, name))}")
        if name not in done:
            for other in requires.get(name, ()):
                visit(other, (*path, name))
            done.append(name)

    for name in requires:
        visit(name, ())
    return done


def required_window(parent: TimeWindow, rule: str | tuple[str, str] | TimeWindow | None) -> TimeWindow:
    """The window in which a required variable is loaded: the parent's ("inherit"), the parent's moved by (before, after), its
    own, or open (None)."""
    if rule == "inherit":
        return parent
    if isinstance(rule, tuple):
        return parent.widened(*rule)
    return rule if isinstance(rule, TimeWindow) else TimeWindow()


def per_group(df: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """A pandas function of one observation's rows, for rules that Spark's functions can't say."""
    return df.groupBy(key).applyInPandas(function, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, whose rows nothing computes again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(store.shared_folder(df.sparkSession))
    return df.checkpoint()


def called_with(function: Callable, *given):
    """The function's result for as many of the given arguments as it takes."""
    kinds = inspect.signature(function).parameters.values()
    if any(p.kind == p.VAR_POSITIONAL for p in kinds):
        return function(*given)
    return function(*given[: sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in kinds)])


def chosen_window(spec: DynamicSpec, window: TimeWindow, asked: bool) -> TimeWindow:
    """The spec's own window if it has one, unless the caller asked for another and it isn't frozen."""
    return window if spec.window is None or (asked and not spec.frozen) else spec.window


class SeriesPlan:
    """Which series a list of specs needs, each in every window that something needs it in, and each of those once.

    A request is keyed by name, window and changes; requests are collected first, so that it is known which of them several others
    use, and built afterwards in an order in which each comes after what it requires. Nothing here runs a job unless `share`
    does.
    """

    def __init__(self, cohort: Cohort, bases: Mapping[str, DataFrame], specs: list[DynamicSpec], share: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.cohort, self.bases, self.specs, self.share = cohort, bases, {s.name: s for s in specs}, share
        self.requests: dict[tuple, tuple[DynamicSpec, TimeWindow, dict[str, tuple]]] = {}
        self.uses: Counter = Counter()
        self.built: dict[tuple, DataFrame] = {}
        self.failed: dict[tuple, Exception] = {}

    def request(self, name: str, inside: TimeWindow, asked: bool, changes: Mapping[str, object] | None = None) -> tuple:
        """The key of a spec's series in a window, with all that it requires noted down."""
        spec = replace(self.specs[name], **changes) if changes else self.specs[name]
        own = chosen_window(spec, inside, asked)
        key = (name, own.identity(), repr(sorted((changes or {}).items())))
        if key not in self.requests:
            needs = {}
            for alias, rule in spec.rules().items():
                if rule.variable in self.specs and rule.variable not in self.cohort.obs.columns:
                    needs[alias] = self.request(rule.variable, required_window(own, rule.window), True, rule.changes)
                    self.uses[needs[alias]] += 1
            self.requests[key] = (spec, own, needs)
        return key

    def build(self) -> None:
        """Plans every request; what can't be planned is kept as the error of its key, and so is what requires it."""
        for key, (spec, own, needs) in self.requests.items():
            try:
                required = {}
                for alias, rule in spec.rules().items():
                    if alias in needs and needs[alias] in self.failed:
                        raise self.failed[needs[alias]]
                    frame = self.built[needs[alias]] if alias in needs else self.cohort.variable(rule.variable)
                    required[alias] = from_sources(frame, spec.sources)
                found = dynamic_series(self.bases.get(spec.name), self.cohort.obs, spec, self.cohort.level, own, required, asked=True)
                self.built[key] = self.share(found) if self.share and self.uses[key] > 1 else found
            except (AnalysisException, KeyError, ValueError) as e:  # planning errors of one variable shouldn't lose the others
                self.failed[key] = e


def from_sources(df: DataFrame, sources: tuple[str, ...], column: str = "data_source") -> DataFrame:
    """The rows of the given sources; a frame that doesn't tell its rows' source is taken whole."""
    return df.where(F.col(column).isin(*sources)) if sources and column in df.columns else df


def dynamic_series(base: DataFrame | None, obs: DataFrame, spec: DynamicSpec, level: ObsLevel, window: TimeWindow, required: dict[str, DataFrame] | None = None, *, asked: bool = False) -> DataFrame:
    """Extract, clip, fold attributes, apply the user's function, attach windows, filter by time, clean. If the observations lack
    a column that the window needs, the time filter is left out."""
    key = spec.join_key or level.key
    if spec.levels and level.name not in [level_named(x).name for x in spec.levels]:
        raise ValueError(f"{spec.name} can't be loaded at the level {level.name}")
    chosen = chosen_window(spec, window, asked)
    if spec.constant is not None:
        low, _ = chosen.bounds()
        return obs.select(level.key, low.cast("timestamp_ntz").alias("recordtime"), F.lit(spec.constant).alias("value"))
    df = None
    if base is not None:
        df = spec.extractor(base, obs) if spec.extractor else frames.select_sql(base, spec.columns, spec.where)
        df = frames.build_attributes(clip_timestamps(joins.restrict_to_cohort(df, obs, key)))
    if spec.function:
        df = called_with(spec.function, df, required or {}, obs)
        if not isinstance(df, DataFrame):
            raise TypeError(f"the function of {spec.name} must return a DataFrame")
    if df is None:
        raise ValueError(f"{spec.name} has neither a base table nor a function nor a constant")
    if chosen.fits(obs.columns):
        df = joins.time_filter(joins.attach_window(df, obs, chosen, level.key, key)).drop("tmin", "tmax")
    return frames.apply_cleaning(df, spec.cleaning, spec.name)


@dataclass(frozen=True)
class Step:
    description: str
    rows_before: int
    rows_after: int
    keys_before: int
    keys_after: int
    key_hash: int
    group: str | None = None


_STEP_SCHEMA = "step long, description string, rows_before long, rows_after long, keys_before long, keys_after long, excluded long, parent string"


class Cohort:
    """Lazy but for the log: each selection takes one aggregate over the observations. Operations return a new cohort."""

    def __init__(self, obs: DataFrame, level: ObsLevel | str, *, series: dict[str, DataFrame] | None = None, log: list[Step] | None = None, t_eligible: str | None = None, t_outcome: str | None = None, logged: DataFrame | None = None) -> None:
        self.level = level_named(level) if isinstance(level, str) else level
        self.obs, self.series, self.log = obs, dict(series or {}), list(log or [])
        self.logged = obs if logged is None else logged  # the observations of the last step of the log
        self.t_eligible, self.t_outcome = t_eligible or self.level.t_min, t_outcome or self.level.outcome

    @property
    def key(self) -> str:
        return self.level.key

    def _with(self, **changes) -> Cohort:
        own = {"obs": self.obs, "level": self.level, "series": self.series, "log": self.log, "t_eligible": self.t_eligible, "t_outcome": self.t_outcome, "logged": self.logged}
        return Cohort(**(own | changes))

    def window(self) -> TimeWindow:
        return TimeWindow.from_level(self.level)

    def validate(self) -> Cohort:
        joins.require_unique(self.obs, self.key)
        return self

    def variable(self, name: str) -> DataFrame:
        """A variable that the cohort has: key and value (and data_source, if known) of a column of the observations, which comes first,
        or a time series."""
        if name in self.obs.columns:
            return self.obs.select(*dict.fromkeys([self.key, name, *[c for c in ("data_source",) if c in self.obs.columns]]))
        return self.series[name]

    def add_series(self, base: DataFrame | None, spec: DynamicSpec, window: TimeWindow | None = None, required: dict[str, DataFrame] | None = None) -> Cohort:
        known = {alias: from_sources(self.variable(rule.variable), spec.sources) for alias, rule in spec.rules().items() if rule.variable in self.obs.columns or rule.variable in self.series}
        found = dynamic_series(base, self.obs, spec, self.level, window or self.window(), known | (required or {}), asked=window is not None)
        return self._with(series=self.series | {spec.name: found})

    def configured_window(self, margin: str = "48h") -> TimeWindow:
        """From `margin` before the level's start to `margin` after it: the window of a configured list of variables."""
        start = TimeWindow.between(self.level.t_min, self.level.t_min)
        return start.widened(f"-{margin}", margin)

    def add_all(self, bases: dict[str, DataFrame], specs: list[DynamicSpec], window: TimeWindow | None = None, *, share: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Cohort, dict[str, str]]:
        """All specs, each with what it requires in the window that it asks for: a column of the observations, a spec of the list, or
        else a series that the cohort has. Those that can't be planned are reported by name and left out, and so is what requires
        them; other errors aren't caught. However often a series is required in one window, it is planned once; share (such as
        `checkpointed`) is applied to those that several others use."""
        resolved_order({s.name: tuple(r.variable for r in s.rules().values() if r.variable not in self.obs.columns) for s in specs})  # ends a cycle
        plan = SeriesPlan(self, bases, specs, share)
        keys = {}
        for spec in specs:
            keys[spec.name] = plan.request(spec.name, window or self.window(), window is not None)
            plan.uses[keys[spec.name]] += 1
        plan.build()
        found = {name: plan.built[key] for name, key in keys.items() if key in plan.built}
        failed = {name: str(plan.failed[key]).splitlines()[0] for name, key in keys.items() if key in plan.failed}
        return self._with(series=self.series | found), failed

    def add_features(self, series: str | DataFrame, features: list[Feature], **options) -> Cohort:
        base = self.series[series] if isinstance(series, str) else series
        found = static_features(base, self.obs, features, self.key, **options)
        return self._with(obs=self.obs.drop(*[c for c in found.columns if c != self.key]).join(found, self.key, "left"))

    def add_derived(self, name: str, expression: str) -> Cohort:
        return self._with(obs=self.obs.withColumn(name, F.expr(expression)))

    def add_static(self, data: DataFrame, name: str, save_as: str | None = None) -> Cohort:
        joins.require_unique(data, self.key)
        return self._with(obs=joins.add_static(self.obs, data, self.key, name, save_as))

    def add_free_days(self, episodes: DataFrame, name: str, days: int, *, t0: str | None = None, **options) -> Cohort:
        """Event-free days in the `days` days from t0 as `<name>_<days>d`."""
        window = TimeWindow.after(t0 or self.t_eligible, f"{days}d")
        found = outcomes.free_days(self.obs, episodes, self.key, window, name=f"{name}_{days}d", **options)
        return self._with(obs=self.obs.join(found, self.key, "left"))

    def _logged(self, obs: DataFrame, description: str, group: str | None = None) -> Cohort:
        before = (self.log[-1].rows_after, self.log[-1].keys_after) if self.log and group is None else None
        if before is None:
            first = snapshot(self.obs, self.key).first()
            before = (first["rows"], first["keys"])
        after = snapshot(obs, self.key).first()
        step = Step(description, before[0], after["rows"], before[1], after["keys"], after["key_hash"], group)
        return self._with(obs=obs, log=[*self.log, step], logged=obs)

    def track(self, description: str, test: Column, mode: str = "include") -> Cohort:
        """include keeps rows where test holds, exclude drops them; a null test is neither kept nor dropped on purpose: include
        loses it, exclude keeps it."""
        return self._logged(frames.filter_by_condition(self.obs, test, "keep" if mode == "include" else "drop"), description)

    def include(self, variable: str, operation: str, label: str | None = None) -> Cohort:
        return self._criterion(variable, operation, label, "left_semi", "include")

    def exclude(self, variable: str, operation: str, label: str | None = None) -> Cohort:
        return self._criterion(variable, operation, label, "left_anti", "exclude")

    def _criterion(self, variable: str, operation: str, label: str | None, how: str, mode: str) -> Cohort:
        """A static variable's rows, or a time series' records (any of them decides), for which "variable operation" holds."""
        text = {"true": f"`{variable}` = true", "false": f"`{variable}` = false"}.get(operation.strip().lower(), f"`{variable}` {operation}")
        if variable in self.obs.columns:
            return self.track(label or text, frames.condition(text), mode)
        met = self.series[variable].withColumnRenamed("value", variable).where(frames.condition(text))
        return self._logged(self.obs.join(met.select(self.key).distinct(), self.key, how), label or text)

    def exclude_any(self, description: str, reasons: dict[str, Column]) -> Cohort:
        """Excludes rows to which any reason applies; each reason is counted on its own, so counts may overlap. One pass counts all."""
        holds = {name: F.coalesce(test, F.lit(False)) for name, test in reasons.items()}
        counts = self.obs.agg(*[F.count_if(t).alias(f"r{i}") for i, t in enumerate(holds.values())]).first()
        any_of = F.lit(False)
        for t in holds.values():
            any_of = any_of | t
        out = self._logged(self.obs.where(~any_of), description)
        main = out.log[-1]
        parts = [replace(main, description=name, rows_after=main.rows_before - counts[f"r{i}"], keys_after=main.keys_before - counts[f"r{i}"], group=description) for i, name in enumerate(holds)]
        return out._with(log=[*out.log[:-1], *parts, main])

    def set_t_eligible(self, column: str) -> Cohort:
        if not dict(self.obs.dtypes)[column].startswith("timestamp"):
            raise TypeError(f"{column} isn't a timestamp")
        return self._logged(self.obs.where(F.col(column).isNotNull()), f"{column} known")._with(t_eligible=column)

    def branch(self, obs: DataFrame | None = None) -> Cohort:
        """A cohort with an empty log, from here or from other observations."""
        start = self.obs if obs is None else obs
        return self._with(obs=start, log=[], logged=start)

    def attrition(self) -> DataFrame:
        rows = [(i, s.description, s.rows_before, s.rows_after, s.keys_before, s.keys_after, s.rows_before - s.rows_after, s.group) for i, s in enumerate(self.log, 1)]
        return self.obs.sparkSession.createDataFrame(rows, _STEP_SCHEMA)

    def profile(self, arm: str | None = None) -> dict:
        """Counts for a flow chart: screened, reasons (most frequent first), included, and the arms; they must balance."""
        main = [s for s in self.log if s.group is None]
        screened = main[0].rows_before if main else self.obs.count()
        reasons = sorted(((s.description, s.rows_before - s.rows_after) for s in main), key=lambda r: -r[1])
        included = main[-1].rows_after if main else screened
        if screened - sum(n for _, n in reasons) != included:
            raise ValueError("the log doesn't balance: observations were changed outside it")
        arms = {str(r[arm]): r["count"] for r in self.obs.groupBy(arm).count().collect()} if arm else {}
        return {"screened": screened, "reasons": [r for r in reasons if r[1]], "zero_reasons": [r[0] for r in reasons if not r[1]], "included": included, "arms": arms}

    def consistent(self) -> bool:
        """Whether the observations are still those of the last logged step."""
        now = snapshot(self.obs, self.key).first()
        return not self.log or (now["rows"], now["key_hash"]) == (self.log[-1].rows_after, self.log[-1].key_hash)

    def composition(self, since: Cohort | None = None) -> DataFrame:
        """One row: observations that stayed, came and went since another cohort, or since this one's last logged step (when
        nothing should have)."""
        return summary.composition_change(self.logged if since is None else since.obs, self.obs, self.key)

    def overlaps(self, reasons: dict[str, Column]) -> DataFrame:
        """How many observations each combination of reasons for exclusion applies to."""
        return summary.reason_overlaps(self.obs, reasons)

    def table_one(self, by: str | None = None, **options) -> DataFrame:
        ids = [self.key, *[c for c in self.obs.columns if c.endswith("_id")]]
        return summary.table_one(self.obs, by, skip=[*ids, *options.pop("skip", [])], **options)

    def export(self, folder: str, kind: str = "parquet") -> None:
        """`_obs` and one folder for each series, as parquet, csv or json (one object a line); csv holds nested columns as JSON."""
        for name, df in {"_obs": self.obs, **self.series}.items():
            if kind == "csv":
                nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
                df = df.withColumns(nested) if nested else df
                df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            elif kind in ("json", "jsonl"):
                df.write.mode("overwrite").json(f"{folder}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")

    def save(self, folder: str, *, buckets: int | None = None) -> int:
        """Saves into the folder as a new generation and returns its number; what was saved there before stays until
        `store.forget_older`. With buckets, tables are dealt by the observation key, and joins and groupings by it need no shuffle after
        loading."""
        meta = {"level": vars(self.level), "series": sorted(self.series), "t_eligible": self.t_eligible, "t_outcome": self.t_outcome, "log": [vars(s) for s in self.log]}
        tables = {"obs": self.obs, **{f"series/{name}": df for name, df in self.series.items()}}
        return store.save_tables(self.obs.sparkSession, folder, tables, self.key, meta, buckets)

    @staticmethod
    def load(spark: SparkSession, folder: str, generation: int | None = None, *, verify: bool = True) -> Cohort:
        """The cohort saved last, or as a given generation. verify compares every table with its record (one scan of the keys of
        each); that observations are unique is always checked."""
        tables, meta = store.load_tables(spark, folder, generation, verify=verify)
        series = {name: tables[f"series/{name}"] for name in meta["series"]}
        log = [Step(**s) for s in meta["log"]]
        return Cohort(tables["obs"], ObsLevel(**meta["level"]), series=series, log=log, t_eligible=meta["t_eligible"], t_outcome=meta["t_outcome"]).validate()
