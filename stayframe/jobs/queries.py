"""Registered queries of the cohort operators over the given tables, each with equivalent SQL where SQL can express it.

events plays observations (one per user), series, episodes and movements; orders and customers play stays and
patients; lineitem plays an entity-attribute-value hierarchy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import time as T
from ..functions.time import TimeWindow
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import frames as P
from ..operators import intervals as W
from ..operators import joins as J
from ..operators import outcomes as Q
from ..operators import summary as M
from ..sources import datasets, hospital
from . import store
from .cohort import Cohort, DynamicSpec, Requirement, checkpointed, overridden, per_group

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def series(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    df = table(spark, d, "events").withColumnRenamed("ts", "recordtime")
    return df.where(F.col("event_type") == kind) if kind else df


def episodes(spark: SparkSession, d: str, kind: str, per: str = "m") -> DataFrame:
    """Intervals that last `value` minutes or hours."""
    seconds = F.floor(F.col("value") * {"m": 60, "h": 3600}[per])
    end = F.col("recordtime") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return series(spark, d, kind).withColumn("recordtime_end", end)


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t_first"), F.max("ts").alias("t_last"))


OBS = "obs AS (SELECT user_id, min(ts) AS t_first, max(ts) AS t_last FROM events GROUP BY user_id)"
EPISODES = "ep AS (SELECT event_id, user_id, ts AS s, ts + to_microseconds(floor(value * {per})::BIGINT * 1000000) AS e, value, event_type FROM events WHERE event_type = '{kind}')"


def ep(kind: str, per: int = 60) -> str:
    return EPISODES.format(kind=kind, per=per)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- selection and features -------------------------------------------------------------------------------------------


@query(f"""WITH {OBS} SELECT o.user_id, max(e.value) AS top_purchase FROM obs o JOIN events e ON e.user_id = o.user_id
  AND e.event_type = 'purchase' AND e.value BETWEEN 1 AND 1000 AND e.ts BETWEEN o.t_first AND o.t_first + INTERVAL 7 DAY
  GROUP BY o.user_id HAVING max(e.value) > 50""")
def first_week_top_purchase(spark, d):
    obs = observations(spark, d)
    base = P.apply_cleaning(series(spark, d, "purchase"), {"value": {"low": 1, "high": 1000}})
    feature = A.Feature("top_purchase", "!max value", window=TimeWindow.after("t_first", "7d"))
    found = A.static_features(base, obs, [feature], "user_id")
    return found.where(P.condition("top_purchase > 50"))


FEATURES = [
    ("first_value", "!first value"), ("last_value", "!last value"), ("mean_value", "!mean value"), ("median_value", "!median value"), ("min_value", "!min value"),
    ("max_value", "!max value"), ("std_value", "!std value"), ("p90", "!perc(90) value"), ("sum_value", "!sum value"), ("n", "!count value"), ("seen", "!any value"),
]


FEATURES_SQL = f"""WITH {OBS}, w AS (SELECT e.* FROM events e JOIN obs o USING (user_id) WHERE e.event_type IN ('click', 'view')
    AND e.ts BETWEEN o.t_first + INTERVAL 2 DAY AND o.t_first + INTERVAL 9 DAY)
  SELECT o.user_id, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value, round(avg(value), 6) AS mean_value,
    round(median(value), 6) AS median_value, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 6) AS std_value,
    list_sort(list(value) FILTER (value IS NOT NULL))[floor((count(value) - 1) * 0.9 + 0.5)::INT + 1] AS p90, round(sum(value), 6) AS sum_value,
    CASE WHEN count(w.event_id) > 0 THEN count(w.event_id) END AS n, count(w.value) > 0 AS seen
  FROM obs o LEFT JOIN w USING (user_id) GROUP BY o.user_id"""


@query(FEATURES_SQL)
def features_in_window(spark, d, **options):
    window = TimeWindow.between(("t_first", "2d"), ("t_first", "9d"))
    specs = [A.Feature(name, select, "!isin(event_type, [click, view])", window) for name, select in FEATURES]
    found = A.static_features(series(spark, d), observations(spark, d), specs, "user_id", tiebreak=["event_id"], **options)
    return rounded(found, "mean_value", "median_value", "std_value", "sum_value")


@query(FEATURES_SQL)
def features_of_hot_keys(spark, d):
    return features_in_window(spark, d, spread=True)


@query(f"""WITH {OBS}, {ep("view")}, x AS (SELECT o.user_id, e.value, epoch_us(e.s) AS s, epoch_us(e.e) AS e, epoch_us(o.t_first + INTERVAL 1 DAY) AS lo, epoch_us(o.t_first + INTERVAL 8 DAY) AS hi
    FROM obs o JOIN ep e USING (user_id))
  SELECT o.user_id, round(coalesce(sum(CASE WHEN x.e <= x.s THEN x.value ELSE x.value * (least(x.e, x.hi) - greatest(x.s, x.lo)) / (x.e - x.s) END) FILTER (x.s <= x.hi AND x.e >= x.lo), 0), 6) AS exposure
  FROM obs o LEFT JOIN x USING (user_id) GROUP BY o.user_id""")
def interval_sum(spark, d):
    feature = A.Feature("exposure", "!sum_interval value", window=TimeWindow.between(("t_first", "1d"), ("t_first", "8d")))
    return rounded(A.static_features(episodes(spark, d, "view"), observations(spark, d), [feature], "user_id"), "exposure")


@query(f"""WITH {OBS}, x AS (SELECT o.user_id, e.value, e.ts, row_number() OVER (PARTITION BY o.user_id ORDER BY abs(epoch_us(e.ts) - epoch_us(o.t_first + INTERVAL 10 DAY)), e.ts, e.event_id) AS n
    FROM obs o JOIN events e ON e.user_id = o.user_id AND e.event_type = 'click' AND e.ts BETWEEN o.t_first + INTERVAL 9 DAY AND o.t_first + INTERVAL 12 DAY)
  SELECT o.user_id, x.value AS near_value, x.ts AS near_recordtime FROM obs o LEFT JOIN x ON x.user_id = o.user_id AND x.n = 1""")
def closest_record(spark, d):
    feature = A.Feature("near", "!closest(t_first, 10d, 1d 2d) value, recordtime", "event_type = 'click'")
    return A.static_features(series(spark, d), observations(spark, d), [feature], "user_id", tiebreak=["event_id"])


@query("""WITH stays AS (SELECT o_orderkey, o_custkey, o_orderdate AS t_min, o_orderdate + to_days((o_orderkey % 30 + 1)::INT) AS t_max FROM orders),
  records AS (SELECT l_orderkey, o_custkey, l_linenumber, l_shipdate, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT s.o_orderkey, count(*) AS n, sum(r.l_quantity) AS quantity FROM stays s JOIN records r USING (o_custkey) WHERE r.l_shipdate BETWEEN s.t_min AND s.t_max GROUP BY s.o_orderkey""")
def patient_records_in_stays(spark, d):
    orders = table(spark, d, "orders")
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 30 + 1).cast("int"))
    stays = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("t_min"), end.alias("t_max"))
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    windowed = J.attach_window(lines.select("o_custkey", "l_shipdate", "l_quantity"), stays, TimeWindow.between("t_min", "t_max"), "o_orderkey", "o_custkey")
    kept = J.time_filter(windowed, start="l_shipdate", end=None)
    return kept.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# --- as-of joins --------------------------------------------------------------------------------------------------------


def _asof(spark, d, strategy, slices=None):
    return J.attach_asof_value(series(spark, d, "purchase").select("event_id", "user_id", "recordtime"), series(spark, d, "view"), "view_value", by="user_id", strategy=strategy, tolerance="12h", with_matched_time=True, tiebreak="event_id", slices=slices)


_PAIRS = """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id, ts AS vts, value FROM events WHERE event_type = 'view'),
  c AS (SELECT p.*, v.vid, v.vts, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY {order}) AS n FROM p JOIN v USING (user_id) WHERE {where})
  SELECT p.event_id, p.user_id, p.ts AS recordtime, c.value AS view_value, c.vts AS view_value_recordtime FROM p LEFT JOIN c ON c.event_id = p.event_id AND c.n = 1"""


@query("WITH " + _PAIRS.format(order="v.vts DESC, v.vid DESC", where="v.vts <= p.ts AND v.vts >= p.ts - INTERVAL 12 HOUR"))
def asof_backward(spark, d):
    return _asof(spark, d, "backward")


@query("WITH " + _PAIRS.format(order="v.vts, v.vid", where="v.vts >= p.ts AND v.vts <= p.ts + INTERVAL 12 HOUR"))
def asof_forward(spark, d):
    return _asof(spark, d, "forward")


@query("WITH " + _PAIRS.format(order="abs(epoch_us(v.vts) - epoch_us(p.ts)), v.vts, v.vid DESC", where="abs(epoch_us(v.vts) - epoch_us(p.ts)) <= 43200000000"))
def asof_nearest(spark, d):
    return _asof(spark, d, "nearest")


@query(ORACLE_SQL["asof_nearest"])
def asof_in_slices(spark, d):
    return _asof(spark, d, "nearest", "1d")


@query("SELECT event_id, user_id, ts AS recordtime FROM events p WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'error' AND v.user_id = p.user_id AND abs(epoch_us(v.ts) - epoch_us(p.ts)) <= 86400000000)")
def asof_removed(spark, d):
    return J.remove_asof(series(spark, d, "click").select("event_id", "user_id", "recordtime"), series(spark, d, "error"), by="user_id")


@query("""WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
  c AS (SELECT p.event_id, v.value AS view_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n FROM p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts BETWEEN p.ts - INTERVAL 48 HOUR AND p.ts)
  SELECT p.event_id, round(p.value / nullif(c.view_value, 0), 6) AS ratio FROM p LEFT JOIN c ON c.event_id = p.event_id AND c.n = 1""")
def ratio_series(spark, d):
    paired = J.values_at(series(spark, d, "purchase").select("event_id", "user_id", "recordtime", "value"), series(spark, d, "view"), "user_id", "recordtime", "view_value", "48h")
    return rounded(paired.select("event_id", "ratio"), "ratio")


@query(f"""WITH {OBS}, c AS (SELECT e.event_id, e.user_id, e.ts AS recordtime, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY abs(epoch_us(e.ts) - epoch_us(o.t_last - INTERVAL 5 DAY)), e.ts, e.event_id) AS n
    FROM events e JOIN obs o USING (user_id) WHERE e.ts BETWEEN o.t_last - INTERVAL 5 DAY - INTERVAL 1 DAY AND o.t_last - INTERVAL 5 DAY + INTERVAL 2 DAY)
  SELECT user_id, event_id, recordtime, value FROM c WHERE n = 1""")
def nearest_rows(spark, d):
    joined = series(spark, d).join(observations(spark, d), "user_id")
    near = J.nearest_row(joined, "user_id", T.offset(F.col("t_last"), "-5d"), before="1d", after="2d", tiebreak=["event_id"])
    return near.select("user_id", "event_id", "recordtime", "value")


# --- gaps and islands ---------------------------------------------------------------------------------------------------


@query(f"""WITH {ep("view", 3600)}, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ep),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r)
  SELECT user_id, min(s) AS recordtime, max(e) AS recordtime_end FROM g GROUP BY user_id, g""")
def merged_episodes(spark, d):
    return W.merge_episodes(episodes(spark, d, "view", "h"), "user_id", "recordtime", "recordtime_end", "2h")


@query(f"""WITH {ep("click")}, r AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prior FROM ep),
  g AS (SELECT *, sum(CASE WHEN prior IS NOT NULL AND epoch_us(s) - epoch_us(prior) < 108000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
  SELECT user_id, first(value ORDER BY s, event_id) AS value, min(s) AS recordtime, last(e ORDER BY s, event_id) AS recordtime_end FROM g GROUP BY user_id, g""")
def merged_sessions(spark, d):
    return W.merge_sessions(episodes(spark, d, "click"), "user_id", "recordtime", "recordtime_end", "value", gap="30h", tiebreak=["event_id"])


_STAYS = """m AS (SELECT event_id, user_id, event_type, ts AS b, ts + to_microseconds(floor(value * 60)::BIGINT * 1000000) AS e FROM events),
  r AS (SELECT *, lag(e) OVER w AS prior, lag(event_type) OVER w AS pw FROM m WINDOW w AS (PARTITION BY user_id ORDER BY b, event_id)),
  g AS (SELECT *, sum(CASE WHEN prior IS NULL OR epoch_us(b) - epoch_us(prior) >= {gap} {ward} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS UNBOUNDED PRECEDING) AS stay FROM r)
  SELECT user_id, stay::BIGINT AS stay, min(b) AS recordtime, last(e ORDER BY b, event_id) AS recordtime_end, string_agg(event_type, ',' ORDER BY b, event_id) AS wards FROM g GROUP BY user_id, stay"""


def _stays(spark, d, ward):
    rows = series(spark, d).withColumn("recordtime_end", F.col("recordtime") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 60).cast("decimal(18,6)")))
    merged = W.merge_consecutive_stays(rows, "user_id", "recordtime", "recordtime_end", hours=6, ward=ward, lists=["event_type"], tiebreak=["event_id"])
    return merged.withColumn("wards", F.array_join("event_type", ",")).drop("event_type")


@query("WITH " + _STAYS.format(gap=21_600_000_000, ward=""))
def merged_stays(spark, d):
    return _stays(spark, d, None)


@query("WITH " + _STAYS.format(gap=21_600_000_000, ward="OR event_type IS DISTINCT FROM pw"))
def merged_stays_same_ward(spark, d):
    return _stays(spark, d, "event_type")


@query("SELECT user_id, event_id, ts AS recordtime, least(ts + INTERVAL 12 HOUR, nxt) AS recordtime_end FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def imputed_ends(spark, d):
    ended = W.impute_end(series(spark, d), "user_id", "recordtime", "recordtime_end", tiebreak=["event_id"], max_gap="12h", beyond="cap")
    return ended.select("user_id", "event_id", "recordtime", "recordtime_end")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '5 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_six_days(spark, d):
    return rounded(W.rolling_mean(series(spark, d), "user_id", "recordtime", "value", length="6d").select("event_id", "rolling"), "rolling")


@query("SELECT event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts <= f + INTERVAL 24 HOUR")
def first_day_records(spark, d):
    return W.within_first(series(spark, d), "user_id", "recordtime").select("event_id")


@query("SELECT o_custkey, o_orderkey, o_custkey || '_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS stay_id FROM orders")
def sequential_ids(spark, d):
    return W.sequential_id(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "stay_id").select("o_custkey", "o_orderkey", "stay_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_stays(spark, d):
    return W.first_per_key(series(spark, d), "user_id", ["recordtime", "event_id"]).select("user_id", "event_id", "value")


@query("""WITH c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, (sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM c""")
def ward_blocks(spark, d):
    return W.change_blocks(series(spark, d), "user_id", "event_type", ["recordtime", "event_id"]).select("event_id", "block")


@query("""WITH g AS (SELECT user_id, first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last, max(value) AS highest, count(*) AS points FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY user_id)
  SELECT user_id, first, last, highest, points, round(last / first, 6) AS last_to_first, round(highest / first, 6) AS highest_to_first,
    CASE WHEN points >= 2 THEN round(greatest(least(100 * (first - last) / first, 200), -200), 6) END AS clearance FROM g""")
def value_trends(spark, d):
    found = A.trend(series(spark, d, "view"), ["user_id"], "recordtime", "value", ["event_id"])
    return found.withColumns({c: S.round_scaled(F.col(c), 6) for c in ("last_to_first", "highest_to_first", "clearance")})


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'),
  f AS (SELECT user_id, event_id, n, ts AS kt, value AS kv, true AS kept, CAST(NULL AS DOUBLE) AS rate FROM s WHERE n = 1
    UNION ALL SELECT user_id, event_id, n, CASE WHEN ok THEN ts ELSE kt END, CASE WHEN ok THEN value ELSE kv END, ok, CASE WHEN ok THEN r END FROM (
      SELECT s.user_id, s.event_id, s.n, s.ts, s.value, f.kt, f.kv, (s.value - f.kv) / ((epoch_us(s.ts) - epoch_us(f.kt)) / 3600000000.0) AS r, abs((s.value - f.kv) / ((epoch_us(s.ts) - epoch_us(f.kt)) / 3600000000.0)) < 3.0 AND epoch_us(s.ts) > epoch_us(f.kt) AS ok
      FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1))
  SELECT user_id, event_id, round(rate, 6) AS rate FROM f WHERE kept""")
def plausible_changes(spark, d):
    kept = W.rate_of_change_filter(series(spark, d, "view"), "user_id", "recordtime", "value", 3.0, tiebreak="event_id")
    return rounded(kept.select("user_id", "event_id", "rate"), "rate")


# --- interval buckets ---------------------------------------------------------------------------------------------------

_BUCKET = """x AS (SELECT o.user_id, epoch_us(e.s) AS s, epoch_us(e.e) AS e, e.value, epoch_us(o.t_first + INTERVAL 2 DAY) AS lo, epoch_us(o.t_last - INTERVAL 2 DAY) AS hi, epoch_us(o.t_first) AS z FROM ep e JOIN obs o USING (user_id)),
  c AS (SELECT user_id, greatest(s, lo) AS cs, least(e, hi) AS ce, value * (least(e, hi) - greatest(s, lo)) / (e - s) AS cv, z FROM x WHERE e > s AND s < hi AND e > lo AND least(e, hi) > greatest(s, lo))"""


def _bucketed(spark, d, **options):
    rows = episodes(spark, d, "view", "h").join(observations(spark, d), "user_id")
    rows = rows.withColumns({"lo": T.offset(F.col("t_first"), "2d"), "hi": T.offset(F.col("t_last"), "-2d")})
    return W.interval_bucket(rows, "user_id", tmin="lo", tmax="hi", **options)


@query(f"""WITH {OBS}, {ep("view", 3600)}, {_BUCKET}, b AS (SELECT user_id, cs, ce, cv, unnest(range(cs // 86400000000, ce // 86400000000 + 1)) AS n FROM c),
  o2 AS (SELECT user_id, n, greatest(cs, n * 86400000000) AS os, least(ce, (n + 1) * 86400000000) AS oe, cs, ce, cv FROM b)
  SELECT user_id, make_timestamp(n * 86400000000) AS bucket_start, round(sum(cv * (oe - os) / (ce - cs)), 6) AS value, ((max(oe) - min(os)) // 1000000)::BIGINT AS seconds FROM o2 WHERE oe > os GROUP BY user_id, n""")
def daily_buckets(spark, d):
    return rounded(_bucketed(spark, d, every="1d"), "value").select("user_id", "bucket_start", "value", "seconds")


@query(f"""WITH {OBS}, {ep("view", 3600)}, {_BUCKET}, b AS (SELECT user_id, z, cs, ce, cv, unnest(range((cs - z) // 43200000000, (ce - z) // 43200000000 + 1)) AS n FROM c),
  o2 AS (SELECT user_id, n, greatest(cs, z + n * 43200000000) AS os, least(ce, z + (n + 1) * 43200000000) AS oe, cs, ce, cv FROM b)
  SELECT user_id, n::DOUBLE AS buckets_from_t0, round(sum(cv * (oe - os) / (ce - cs)), 6) AS value FROM o2 WHERE oe > os GROUP BY user_id, n""")
def buckets_from_start(spark, d):
    return rounded(_bucketed(spark, d, every="12h", t0="t_first"), "value").select("user_id", "buckets_from_t0", "value")


@query(f"""WITH {OBS}, {ep("view", 3600)}, {_BUCKET}, m AS (SELECT user_id, cs, ce, cv, epoch_us(o.t_first + INTERVAL 10 DAY) AS z2 FROM c JOIN obs o USING (user_id)),
  h AS (SELECT user_id, -1 AS side, cs AS os, least(ce, z2) AS oe, cs, ce, cv FROM m WHERE cs < z2 UNION ALL SELECT user_id, 1, greatest(cs, z2), ce, cs, ce, cv FROM m WHERE ce > z2)
  SELECT user_id, side, round(sum(cv * (oe - os) / (ce - cs)), 6) AS value FROM h WHERE oe > os GROUP BY user_id, side""")
def before_and_after(spark, d):
    rows = episodes(spark, d, "view", "h").join(observations(spark, d), "user_id")
    rows = rows.withColumns({"lo": T.offset(F.col("t_first"), "2d"), "hi": T.offset(F.col("t_last"), "-2d"), "mid": T.offset(F.col("t_first"), "10d")})
    return rounded(W.interval_bucket(rows, "user_id", tmin="lo", tmax="hi", t0="mid"), "value").select("user_id", "side", "value")


# --- outcomes -----------------------------------------------------------------------------------------------------------

_HORIZON = """b AS (SELECT user_id, epoch_us(t_first) AS z, epoch_us(t_first + INTERVAL 20 DAY) AS h,
    CASE WHEN user_id % 7 = 0 THEN epoch_us(t_first + to_days((user_id % 25)::INT)) END AS death, user_id % 11 = 0 AS censored FROM obs),
  r AS (SELECT b.user_id, epoch_us(s) - z AS s, least(epoch_us(e), h) - z AS e FROM {ep} JOIN b USING (user_id) WHERE least(epoch_us(e), h) > z AND epoch_us(s) < h),
  g AS (SELECT b.*, d.d * 86400000000 AS d FROM b, unnest(range(20)) d(d))"""


def _followed(spark, d):
    obs = observations(spark, d)
    death = F.when(F.col("user_id") % 7 == 0, F.col("t_first") + F.make_dt_interval((F.col("user_id") % 25).cast("int")))
    return obs.withColumns({"death": death, "censor": F.when(F.col("user_id") % 11 == 0, T.offset(F.col("t_first"), "10d"))})


@query(f"""WITH {OBS}, {ep("view", 3600)}, {_HORIZON.format(ep="ep")}
  SELECT b.user_id, CASE WHEN censored THEN NULL WHEN death <= h THEN 0 ELSE (SELECT count(*) FROM g WHERE g.user_id = b.user_id AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = b.user_id AND r.e > g.d)) END::INT AS free_days FROM b""")
def free_days_last_event(spark, d):
    return Q.free_days(_followed(spark, d), episodes(spark, d, "view", "h"), "user_id", TimeWindow.after("t_first", "20d"), death="death", censor="censor")


@query(f"""WITH {OBS}, {ep("view", 3600)}, {_HORIZON.format(ep="ep")}
  SELECT b.user_id, CASE WHEN censored THEN NULL ELSE (SELECT count(*) FROM g WHERE g.user_id = b.user_id AND (death IS NULL OR death - z >= g.d + 86400000000)
      AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = b.user_id AND r.s < g.d + 86400000000 AND r.e > g.d - 43200000000)) END::INT AS free_days FROM b""")
def free_days_grid_recovery(spark, d):
    return Q.free_days(_followed(spark, d), episodes(spark, d, "view", "h"), "user_id", TimeWindow.after("t_first", "20d"), method="day_grid", death_rule="alive_days", recovery="12h", death="death", censor="censor")


@query(f"""WITH {OBS}, {ep("view", 3600)}, q AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ep),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM q),
  me AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, g), {_HORIZON.format(ep="me")},
  p AS (SELECT b.user_id, epoch_us(ts) - z AS s, least(epoch_us(ts + to_microseconds(floor(value * 3600)::BIGINT * 1000000)), h) - z AS e FROM events JOIN b USING (user_id) WHERE event_type IN ('click', 'signup') AND epoch_us(ts) < h),
  day AS (SELECT g.user_id, g.d, NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = g.user_id AND r.s < g.d + 86400000000 AND r.e > g.d) AS free, EXISTS (SELECT 1 FROM p WHERE p.user_id = g.user_id AND p.e > 0 AND p.s < g.d + 86400000000 AND p.e > g.d) AS seen FROM g),
  k AS (SELECT user_id, count(*) FILTER (free AND seen) AS n, count(*) FILTER (free AND NOT seen) AS unseen FROM day GROUP BY user_id),
  l AS (SELECT user_id, max(e) AS last, count(*) AS n_ep FROM r GROUP BY user_id)
  SELECT b.user_id, CASE WHEN censored THEN NULL WHEN death <= h THEN -1 ELSE k.n END::INT AS free_days,
    CASE WHEN censored THEN 'censored' WHEN death <= h THEN 'died' WHEN l.last >= h - z THEN 'ongoing_at_horizon' ELSE 'liberated' END AS event_type,
    CASE WHEN NOT censored AND NOT coalesce(death <= h, false) AND NOT coalesce(l.last >= h - z, false) THEN round(coalesce((l.last // 1000000) / 86400.0, 0), 6) END AS event_time_days,
    coalesce(death <= h, false) AS died_in_horizon, censored, coalesce(l.n_ep, 0)::INT AS n_episodes, k.unseen::INT AS unobserved_days FROM b JOIN k USING (user_id) LEFT JOIN l USING (user_id)""")
def free_days_detail(spark, d):
    presence = episodes(spark, d, "click", "h").unionByName(episodes(spark, d, "signup", "h"))
    found = Q.free_days(
        _followed(spark, d), episodes(spark, d, "view", "h"), "user_id", TimeWindow.after("t_first", "20d"), method="day_grid", death_rule="negative_if_death", death="death",
        censor="censor", presence=presence, merge_gap="24h", with_detail=True,
    )
    return rounded(P.unnest(found, "free_days_detail"), "event_time_days")


# --- hierarchy, lookups, sets ---------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS a2, max(CASE WHEN l_linenumber = 5 THEN l_quantity END) AS a5
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber = 1) > 0 AND count(*) FILTER (l_linenumber = 2) > 0""")
def hierarchy_pivot(spark, d):
    roots = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("").alias("name"), F.lit(None).cast("double").alias("value"))
    child = table(spark, d, "lineitem").select(F.lit(None).cast("long").alias("id"), F.col("l_orderkey").alias("parent_id"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_quantity").alias("value"))
    return J.pivot_hierarchy(roots.unionByName(child), "", ["a1", "a2"], ["a5"])


@query("""SELECT c_custkey, string_agg(DISTINCT n.n_name, ',' ORDER BY n.n_name) AS nations FROM customer c LEFT JOIN nation n ON substr(n.n_nationkey::VARCHAR, 1, 1) = substr(c.c_nationkey::VARCHAR, 1, 1) GROUP BY c_custkey""")
def prefix_lookup(spark, d):
    mapping = table(spark, d, "nation").select(F.substring(F.col("n_nationkey").cast("string"), 1, 1).alias("prefix"), F.col("n_name").alias("target"))
    found = J.map_prefix(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", mapping, 1, "names")
    return found.select("c_custkey", F.array_join("names", ",").alias("nations"))


@query("""SELECT o_orderkey, o_custkey, 'open' AS data_source, o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate, o_orderpriority AS tags FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, o_custkey, 'closed', CAST(NULL AS DOUBLE), o_orderdate, o_orderpriority || ',' || o_orderstatus FROM orders WHERE o_orderstatus = 'F'""")
def united_sources(spark, d):
    orders = table(spark, d, "orders")
    one = orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("tags"))
    two = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return datasets.unite({"open": one, "closed": two}).withColumn("tags", F.array_join("tags", ","))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)")
def included_and_excluded(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    kept = J.keep_keys(orders, customer.where("c_mktsegment = 'BUILDING'"), "o_custkey")
    return J.drop_keys(kept, customer.where("c_acctbal < 1000"), "o_custkey").select("o_orderkey")


@query("""WITH m AS (SELECT *, (event_id % 3 + 1)::VARCHAR AS kind, event_type AS art FROM events)
  SELECT event_id FROM m WHERE (kind = '3' OR (kind = '1' AND art NOT IN ('error'))) AND user_id % 10 IN (1, 2, 3) AND ts >= TIMESTAMP '2024-01-05' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25'""")
def qualifying_movements(spark, d):
    m = table(spark, d, "events").select("event_id", F.col("ts").alias("begin"), T.offset(F.col("ts"), "1h").alias("end"), (F.col("user_id") % 10).cast("string").alias("ward"), (F.col("event_id") % 3 + 1).cast("string").alias("kind"), F.col("event_type").alias("art"))
    x = hospital.Extract("2024-01-05", "2024-01-25", wards=("1", "2", "3"), excluded_arts=("error",))
    return hospital.qualifying_movements(m, x).select("event_id")


@query("""WITH m AS (SELECT event_id, user_id, event_type, ts, sum(CASE WHEN n > 1 AND event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block
    FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
  dx AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id, props) - 1 AS block FROM events WHERE event_type = 'signup')
  SELECT m.event_id, dx.props AS admission_diagnosis FROM m LEFT JOIN dx USING (user_id, block)""")
def aligned_diagnoses(spark, d):
    e = table(spark, d, "events")
    movements = e.select("event_id", F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.col("ts").alias("begin"), F.col("event_type").alias("department"))
    diagnoses = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.col("props").alias("code"), (F.col("event_type") == "signup").alias("is_main"))
    return hospital.align_diagnoses(movements, diagnoses).select("event_id", "admission_diagnosis")


_ICU = """m AS (SELECT *, ts AS b, ts + to_microseconds(floor(value * 60)::BIGINT * 1000000) AS e FROM events WHERE event_id % 3 + 1 IN (1, 3) AND ts + to_microseconds(floor(value * 60)::BIGINT * 1000000) <= TIMESTAMP '2024-02-10'),
  r AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY b, event_id) AS prior FROM m),
  g AS (SELECT *, sum(CASE WHEN prior IS NULL OR epoch_us(b) - epoch_us(prior) >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS UNBOUNDED PRECEDING) AS stay FROM r),
  s AS (SELECT user_id, min(b) AS a, last(e ORDER BY b, event_id) AS z, string_agg(event_type, ',' ORDER BY b, event_id) AS wards FROM g GROUP BY user_id, stay)"""


@query(f"""WITH {OBS}, {_ICU} SELECT s.user_id AS case_id, s.user_id || '_' || row_number() OVER (PARTITION BY s.user_id ORDER BY s.a) AS icu_stay_id, s.a AS icu_admission, s.z AS icu_discharge, s.wards
  FROM s JOIN obs o USING (user_id) WHERE s.a >= o.t_first AND s.z <= o.t_last""")
def icu_stays(spark, d):
    e = episodes_of_all(spark, d)
    diagnoses = e.select("case_id", "seq", F.lit("x").alias("code"), F.lit(True).alias("is_main"))
    stays = observations(spark, d).select(F.col("user_id").alias("case_id"), F.col("t_first").alias("hospital_admission"), F.col("t_last").alias("hospital_discharge"))
    found = hospital.load_icu_stays(e, diagnoses, stays, hospital.Extract(end_date="2024-02-10"), merge_hours=12)
    return found.select("case_id", "icu_stay_id", "icu_admission", "icu_discharge", F.array_join("ward", ",").alias("wards"))


def episodes_of_all(spark, d):
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 60).cast("decimal(18,6)"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.col("ts").alias("begin"), end.alias("end"), F.col("event_type").alias("ward"),
        F.col("event_type").alias("department"), (F.col("event_id") % 3 + 1).cast("string").alias("kind"), F.lit("a").alias("art"),
    )


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate AS b, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days((o_orderkey % 200)::INT - 5) END AS e FROM orders WHERE o_orderkey % 60 >= 18)
  SELECT s.o_orderkey AS case_id, CASE WHEN b <= TIMESTAMP '1999-06-01' THEN b END AS hospital_admission, CASE WHEN e <= TIMESTAMP '1999-06-01' THEN e END AS hospital_discharge,
    CASE WHEN b > e THEN 'Implausible' WHEN b IS NULL THEN 'Incomplete' WHEN b > TIMESTAMP '1999-06-01' AND e IS NULL THEN 'Planned' WHEN e IS NULL AND b >= TIMESTAMP '1999-06-01' - INTERVAL 90 DAY THEN 'Ongoing'
      WHEN e IS NULL THEN 'Incomplete' WHEN b > TIMESTAMP '1999-06-01' THEN 'Planned' WHEN e > TIMESTAMP '1999-06-01' THEN 'Ongoing' ELSE 'Finalised' END AS hospital_status, c.c_mktsegment AS sex
  FROM s LEFT JOIN customer c ON c.c_custkey = s.o_custkey""")
def hospital_stays(spark, d):
    end = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 200 - 5).cast("int")))
    stays = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("begin"), end.alias("end"), (F.col("o_orderkey") % 60).alias("age"), F.col("o_orderstatus").alias("discharge_type"))
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("sex"))
    x = hospital.Extract(reference_now="1999-06-01", require_movement=False)
    found = hospital.load_stays(stays.withColumn("case_id", F.col("case_id").cast("string")), patients, patients, x)
    return found.select(F.col("case_id").cast("long").alias("case_id"), "hospital_admission", "hospital_discharge", "hospital_status", "sex")


# --- scalars and filters --------------------------------------------------------------------------------------------------


@query("""SELECT event_id, ts + INTERVAL 3 DAY + INTERVAL 12 HOUR AS shifted, ts - INTERVAL 1 MONTH - INTERVAL 90 MINUTE AS earlier, date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS icu_day FROM events""")
def shifted_times(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", T.offset(ts, "3d12h").alias("shifted"), T.offset(ts, "-1mo", "-90m").alias("earlier"), T.truncate_to_day(ts, "6h").alias("icu_day"))


@query(f"""WITH {OBS}, x AS (SELECT e.event_id, trunc((epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1000000.0)::BIGINT AS sec FROM events e)
  SELECT event_id, sec AS seconds, floor(sec / 60.0)::BIGINT AS minutes, round(sec / 3600.0, 6) AS hours FROM x""")
def time_differences(spark, d):
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    diff = lambda unit, whole=True: T.time_difference(F.col("ts"), noon, unit, whole=whole)
    return table(spark, d, "events").select("event_id", diff("s").alias("seconds"), diff("m").alias("minutes"), F.round(diff("h", False), 6).alias("hours"))


@query(f"""WITH {OBS}, {ep("click", 3600)}, w AS (SELECT user_id, t_first + INTERVAL 5 DAY AS lo, t_first + INTERVAL 12 DAY AS hi FROM obs)
  SELECT e.event_id, CASE WHEN s <= hi AND e.e >= lo THEN CASE WHEN s >= lo AND e.e <= hi THEN 'CONTAINED' WHEN e.e <= hi THEN 'OVERLAPS_LEFT' WHEN s >= lo THEN 'OVERLAPS_RIGHT' ELSE 'COVERS_WINDOW' END END AS relation FROM ep e JOIN w USING (user_id)""")
def interval_relations(spark, d):
    windows = P.window_columns(observations(spark, d), ["user_id"], TimeWindow.between(("t_first", "5d"), ("t_first", "12d")))
    joined = episodes(spark, d, "click", "h").join(windows, "user_id")
    return joined.select("event_id", T.relation(F.col("recordtime"), F.col("recordtime_end"), F.col("tmin"), F.col("tmax")).alias("relation"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 1 ELSE 0 END AS points,
  CASE WHEN value < 20 THEN 'low' WHEN value < 150 THEN 'normal' ELSE 'high' END AS band, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'other' END AS code, greatest(value, event_id % 100) AS worst FROM events""")
def scores_and_bands(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", S.threshold_score(v, [(200, 4), (100, 3), (50, 1)], below=0).alias("points"), S.band_label(v, [(20, "low"), (150, "normal")], "high").alias("band"),
        S.recode(F.col("event_type"), {"click": "C", "view": "V"}, F.lit("other")).alias("code"), F.greatest(v, F.col("event_id") % 100).alias("worst"),
    )


@query("""SELECT event_id, value FROM events WHERE event_type IN ('click', 'view') AND (props LIKE '{"k": 1%' OR props LIKE '{"k": 2%') AND value BETWEEN 5 AND 300""")
def filtered_records(spark, d):
    df = table(spark, d, "events").where(P.condition("!isin(event_type, ['click', 'view'])")).where(P.condition("!startswith(props, ['{\"k\": 1', '{\"k\": 2'])"))
    return P.select_sql(P.apply_cleaning(df, {"value": {"low": 5, "high": 300}}), {"event_id": "event_id", "value": "value"})


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 60, 6) AS rate FROM events WHERE event_type = 'error' AND value * 60 <= 5000""")
def struct_attributes(spark, d):
    df = series(spark, d, "error").withColumn("attributes_k", S.safe_cast(F.get_json_object("props", "$.k"), "bigint")).withColumn("attributes_unit", F.lit(" mg/kg/min "))
    built = P.build_attributes(df)
    flat = P.unnest(built.withColumn("rate", S.rate_per_hour(F.col("value"), F.col("attributes.unit"), cap=5000.0)), "attributes")
    return rounded(flat.where("rate IS NOT NULL").select("event_id", "k", "rate"), "rate")


@query("""WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)
  SELECT user_id, array_to_string(list_filter(x, lambda v, i: i = 1 OR v IS DISTINCT FROM x[i - 1]), ',') AS path FROM l""")
def event_paths(spark, d):
    lists = A.ordered_lists(series(spark, d), ["user_id"], ["recordtime", "event_id"], ["event_type"])
    return lists.select("user_id", F.array_join(S.drop_consecutive_duplicates(F.col("event_type")), ",").alias("path"))


RULES = [
    C.Rule("junk_marks", "junk", "high", {"text": r"(###|%%%|&&&)"}),
    C.Rule("table", "table", "high", {"text": r"\|"}, subtype="pipes"),
    C.Rule("german_source", "german", "medium", {"lang": "^de$", "source": r"^src[0-4]$"}, {"long": True}, "long"),
    C.Rule("german", "german", "low", {"lang": "^de$"}),
]


@query(r"""WITH t AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars > 2000, false) AS long FROM documents)
  SELECT doc_id, CASE WHEN regexp_matches(text, '###|%%%|&&&') THEN 'junk' WHEN contains(text, '|') THEN 'table' WHEN lang = 'de' THEN 'german' ELSE 'unknown' END AS class,
    CASE WHEN regexp_matches(text, '###|%%%|&&&') THEN 'high' WHEN contains(text, '|') THEN 'high' WHEN lang = 'de' AND regexp_matches(source, '^src[0-4]$') AND long THEN 'medium' WHEN lang = 'de' THEN 'low' ELSE 'none' END AS confidence FROM t""")
def classified_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", (F.col("n_chars") > 2000).alias("long"))
    return C.classify_by_rules(docs, RULES, ["text", "lang", "source"], ["long"]).select("doc_id", "class", "confidence")


# --- summaries and the log ------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS percent FROM orders GROUP BY ALL")
def counted_values(spark, d):
    return P.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH g AS (SELECT c_mktsegment AS grp, c_acctbal, c_nationkey FROM customer UNION ALL SELECT 'Overall', c_acctbal, c_nationkey FROM customer),
  l AS (SELECT grp, 'c_acctbal' AS variable, c_acctbal AS v FROM g UNION ALL SELECT grp, 'c_nationkey', c_nationkey FROM g)
  SELECT grp, variable, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3 FROM l GROUP BY grp, variable""")
def baseline_numbers(spark, d):
    return rounded(M.table_one_numbers(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"), "mean", "sd", "median", "q1", "q3")


@query("""WITH t AS (SELECT lang AS grp, source, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS good FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT * FROM t UNION ALL SELECT 'Overall', source, good FROM t),
  l AS (SELECT coalesce(grp, 'Missing') AS grp, 'source' AS variable, source AS level FROM g UNION ALL SELECT coalesce(grp, 'Missing'), 'good', good FROM g), c AS (SELECT grp, variable, level, count(*) AS n FROM l GROUP BY ALL)
  SELECT grp, variable, level, n, CASE WHEN level IS NOT NULL THEN round(100.0 * n / sum(n) FILTER (level IS NOT NULL) OVER (PARTITION BY grp, variable), 1) END AS percent FROM c""")
def baseline_counts(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return M.table_one_counts(table(spark, d, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left"), ["source", "good"], "lang")


@query("SELECT event_type, count(*) AS rows, round(avg(value), 6) AS mean, count(DISTINCT value) AS distinct_values, min(value) AS lowest, max(value) AS highest, count(*) - count(value) AS nulls FROM events GROUP BY event_type")
def summary_by_type(spark, d):
    return rounded(M.group_summary(table(spark, d, "events"), ["event_type"], "value"), "mean")


@query(f"""WITH {OBS} SELECT e.event_type, floor(trunc((epoch_us(e.ts) - epoch_us(o.t_first)) / 1000000.0) / 21600)::BIGINT AS bin, count(e.value) AS n, round(quantile_cont(e.value, 0.5), 6) AS median, round(quantile_cont(e.value, 0.25), 6) AS q1, round(quantile_cont(e.value, 0.75), 6) AS q3
  FROM events e JOIN obs o USING (user_id) GROUP BY ALL""")
def six_hour_course(spark, d):
    joined = series(spark, d).join(observations(spark, d), "user_id")
    return rounded(M.binned_course(joined, ["event_type"], T.time_difference(F.col("recordtime"), F.col("t_first"), "s"), "value"), "median", "q1", "q3")


@query("""WITH c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey, c_mktsegment)
  SELECT n_regionkey, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY n_regionkey), 6) AS share FROM c""")
def segment_shares(spark, d):
    named = table(spark, d, "customer").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return rounded(M.share_within(named, ["n_regionkey"], "c_mktsegment"), "share")


@query("""WITH p AS (SELECT avg((o_orderstatus = 'F')::INT) AS closed, avg((o_totalprice > 250000)::INT) AS dear, avg((o_orderpriority = '1-URGENT')::INT) AS urgent FROM orders)
  SELECT flag, round(share, 6) AS share FROM (SELECT 'closed' AS flag, closed AS share FROM p UNION ALL SELECT 'dear', dear FROM p UNION ALL SELECT 'urgent', urgent FROM p) ORDER BY share DESC LIMIT 2""")
def top_flags(spark, d):
    flags = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("closed"), (F.col("o_totalprice") > 250000).alias("dear"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return rounded(M.prevalence(flags, ["closed", "dear", "urgent"], 2), "share")


@query("SELECT count(*) AS stays, count(DISTINCT o_custkey) AS patients, round((count(*) - count(DISTINCT o_custkey)) / count(DISTINCT o_custkey), 6) AS readmissions_per_patient FROM orders")
def readmissions(spark, d):
    return rounded(A.readmission_rate(table(spark, d, "orders"), "o_custkey"), "readmissions_per_patient")


@query("""WITH t AS (SELECT quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'quality' AS "column", count(*) - count(quality) AS missing, round(100.0 * (count(*) - count(quality)) / count(*), 2) AS percent FROM t
  UNION ALL SELECT 'toxic', count(*) - count(toxic), round(100.0 * (count(*) - count(toxic)) / count(*), 2) FROM t UNION ALL SELECT 'lang', count(*) - count(lang), round(100.0 * (count(*) - count(lang)) / count(*), 2) FROM t""")
def missing_values(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return A.missingness(joined, ["quality", "toxic", "lang"])


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, min(value) AS lowest, max(value) AS highest, count(*) - count(value) AS nulls, count(*) FILTER (value < 1 OR value > 300) AS impossible FROM events")
def series_checks(spark, d):
    return A.series_quality(table(spark, d, "events"), "user_id", "value", 1, 300)


@query("""WITH a AS (SELECT * FROM customer WHERE c_acctbal >= 0), b AS (SELECT * FROM a WHERE NOT coalesce(c_mktsegment = 'MACHINERY', false) AND NOT coalesce(c_nationkey < 5, false)),
  o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000), c AS (SELECT * FROM b WHERE c_custkey IN (SELECT o_custkey FROM o))
  SELECT 1::BIGINT AS step, 'account in credit' AS description, (SELECT count(*) FROM customer) AS rows_before, (SELECT count(*) FROM a) AS rows_after, CAST(NULL AS VARCHAR) AS parent
  UNION ALL SELECT 2, 'machinery', (SELECT count(*) FROM a), (SELECT count(*) FROM a) - (SELECT count(*) FROM a WHERE c_mktsegment = 'MACHINERY'), 'unsuitable'
  UNION ALL SELECT 3, 'far away', (SELECT count(*) FROM a), (SELECT count(*) FROM a) - (SELECT count(*) FROM a WHERE c_nationkey < 5), 'unsuitable'
  UNION ALL SELECT 4, 'unsuitable', (SELECT count(*) FROM a), (SELECT count(*) FROM b), NULL UNION ALL SELECT 5, 'a large order', (SELECT count(*) FROM b), (SELECT count(*) FROM c), NULL""")
def attrition_log(spark, d):
    obs = table(spark, d, "customer").withColumnRenamed("c_custkey", "case_id")
    large = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("value"))
    cohort = Cohort(obs, "hospital_stay", series={"order": large}).include("c_acctbal", ">= 0", "account in credit")
    cohort = cohort.exclude_any("unsuitable", {"machinery": F.col("c_mktsegment") == "MACHINERY", "far away": F.col("c_nationkey") < 5})
    cohort = cohort.include("order", "> 400000", "a large order")
    return cohort.attrition().select("step", "description", "rows_before", "rows_after", "parent")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.event_type = 'view' AND b.event_type = 'click'")
def same_hour_pairs(spark, d):
    hourly = lambda kind, name: series(spark, d, kind).select("user_id", F.date_trunc("HOUR", "recordtime").alias("hour"), F.col("event_id").alias(name))
    return J.same_instant(hourly("view", "left_id"), hourly("click", "right_id"), "user_id", "hour").select("left_id", "right_id")


@query(f"WITH {OBS} SELECT e.event_id, round((epoch_us(e.ts) - epoch_us(o.t_first)) / 1000000.0, 6) AS recordtime_relative FROM events e JOIN obs o USING (user_id)")
def relative_seconds(spark, d):
    found = J.relative_times(series(spark, d), observations(spark, d), "user_id", "t_first", ("recordtime",))
    return rounded(found.select("event_id", "recordtime_relative"), "recordtime_relative")


@query(f"WITH {OBS} SELECT e.event_id, e.ts AS recordtime FROM events e JOIN obs o USING (user_id) WHERE e.user_id % 2 = 0 UNION ALL SELECT e.event_id, TIMESTAMP '1900-01-01' + (e.ts - o.t_first) FROM events e JOIN obs o USING (user_id) WHERE e.user_id % 2 = 1")
def absolute_again(spark, d):
    obs = observations(spark, d)
    relative = J.relative_times(series(spark, d), obs, "user_id", "t_first", ("recordtime",)).drop("recordtime")
    known = obs.withColumn("t_first", F.when(F.col("user_id") % 2 == 0, F.col("t_first")))
    return J.absolute_times(relative, known, "user_id", "recordtime_relative", t_min="t_first").select("event_id", "recordtime")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN NULL ELSE date_trunc('minute', ts) END AS parsed,
  CASE WHEN event_id % 5 > 0 THEN event_id % 100 END AS number FROM events""")
def parsed_texts(spark, d):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).when(kind == 2, F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    number = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 100).cast("string")).otherwise(F.lit("n/a"))
    return table(spark, d, "events").select("event_id", T.parse_timestamp(text).alias("parsed"), S.safe_cast(number, "bigint").alias("number"))


@query("""SELECT o_orderkey AS icu_stay_id, CASE o_orderstatus WHEN 'Male' THEN 'M' ELSE o_orderstatus END AS sex, o_orderkey % 3 = 0 AS died, TIMESTAMP '1900-01-01' AS icu_admission,
  TIMESTAMP '1900-01-01' + to_microseconds(((o_orderkey % 50) * 0.25 * 86400 * 1000000)::BIGINT) AS icu_discharge FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'""")
def harmonised_source(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("Stay"), F.col("o_orderstatus").alias("Gender"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("Died"), ((F.col("o_orderkey") % 50) * 0.25).alias("Days"), "o_orderpriority")
    chosen = datasets.choose_sources(datasets.choose_sources(raw, "o_orderpriority", include=["1-URGENT", "2-HIGH"]), "Gender", exclude=["P"])
    named = datasets.normalize_source(chosen, {"Stay": "icu_stay_id", "Gender": "sex", "Died": "died", "Days": "days"}, flags=["died"], length_of_stay="days")
    return named.drop("days")


@query("""WITH p AS (SELECT c_custkey::VARCHAR AS patient_id, TIMESTAMP '1990-01-01' + to_days((c_custkey % 9000)::INT) AS birthdate, CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2012-01-01' END AS death_timestamp FROM customer)
  SELECT patient_id, birthdate, death_timestamp, coalesce(death_timestamp, TIMESTAMP '2020-06-01') AS censordate FROM p
  WHERE birthdate <= coalesce(death_timestamp, TIMESTAMP '2020-06-01') - INTERVAL 18 YEAR AND patient_id IN (SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')""")
def adult_patients(spark, d):
    patients = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), (F.lit("1990-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 9000).cast("int"))).alias("birthdate"), F.when(F.col("c_custkey") % 6 == 0, F.lit("2012-01-01").cast("timestamp_ntz")).alias("death_timestamp"))
    movements = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("patient_id"), F.when(F.col("o_orderstatus") == "F", "3").otherwise("2").alias("kind"), F.lit("x").alias("art"), F.lit("w").alias("ward"), F.col("o_orderdate").alias("begin"), F.col("o_orderdate").alias("end"))
    return hospital.load_patients(patients, movements, hospital.Extract(reference_now="2020-06-01"))


@query("""SELECT 'o_totalprice' AS variable, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders""")
def described_columns(spark, d):
    found = M.describe(table(spark, d, "orders"), ["o_totalprice"])
    return rounded(rounded(found, "median", "q1", "q3", digits=4), "mean", "sd", digits=2)


@query("""WITH w AS (SELECT e.user_id, e.ts, e.value FROM events e JOIN (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo, min(ts) + INTERVAL 20 DAY AS hi FROM events GROUP BY user_id) o USING (user_id) WHERE e.event_type = 'view' AND e.ts BETWEEN lo AND hi AND e.value >= 2)
  SELECT user_id AS case_id, count(*) AS n, max(value) AS highest FROM w GROUP BY user_id""")
def series_by_definition(spark, d):
    obs = observations(spark, d).select(F.col("user_id").alias("case_id"), F.col("t_first").alias("hospital_admission"), F.col("t_last").alias("hospital_discharge"))
    spec = DynamicSpec("view", {"case_id": "user_id", "recordtime": "ts", "value": "value", "attributes_props": "props"}, "event_type = 'view'", window=TimeWindow.between(("hospital_admission", "1d"), ("hospital_admission", "20d")), cleaning={"view": {"low": 2}})
    found = Cohort(obs, "hospital_stay").add_series(table(spark, d, "events"), spec).series["view"]
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))


@query("""SELECT '' AS level, grp, variable, printf('%.1f [%.1f, %.1f]', m, a, b) AS text FROM (
  SELECT 'Overall' AS grp, 'value' AS variable, round(quantile_cont(value, 0.5), 6) AS m, round(quantile_cont(value, 0.25), 6) AS a, round(quantile_cont(value, 0.75), 6) AS b FROM events
  UNION ALL SELECT event_type, 'value', round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.25), 6), round(quantile_cont(value, 0.75), 6) FROM events GROUP BY event_type)""")
def table_one_text(spark, d):
    return M.table_one(table(spark, d, "events").select("event_type", "value"), "event_type")


@query("SELECT user_id, n, round(rate, 6) AS rate FROM (SELECT user_id, count(*) AS n, count(*) / nullif(sum(value), 0) AS rate FROM events GROUP BY user_id) ORDER BY rate DESC NULLS LAST, user_id LIMIT 1")
def busiest_user(spark, d):
    rates = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)), F.sum("value")).alias("rate"))
    return rounded(M.top_one(rates, "rate", "user_id"), "rate")


# --- queries of definitions, sources and helpers --------------------------------------------------------------------------

_CASES = "c AS (SELECT user_id AS case_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id)"


def _cases(spark, d) -> Cohort:
    return Cohort(observations(spark, d).select(F.col("user_id").alias("case_id"), F.col("t_first").alias("hospital_admission"), F.col("t_last").alias("hospital_discharge")), "hospital_stay")


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '<5' WHEN event_id % 3 = 1 THEN 'junk' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number, 'CAST(' || event_type AS kind
  FROM events WHERE event_id % 3 = 2 AND event_id > 10""")
def junk_numbers(spark, d):
    texts = table(spark, d, "events").withColumn("t", F.expr("CASE WHEN event_id % 3 = 0 THEN '<5' WHEN event_id % 3 = 1 THEN 'junk' ELSE CAST(event_id AS string) END"))
    return P.select_sql(texts, {"event_id": "event_id", "number": "CAST(t AS DOUBLE)", "kind": "concat('CAST(', event_type)"}, "cast(t AS double) > 10")


def _purchase_rate(rows, required, obs):
    """Whole hours since the last purchase: rows are views, purchases are required in a wider window."""
    bought = required["purchase"].select("case_id", F.col("recordtime").alias("bought"), F.col("value").alias("paid"))
    last = rows.join(bought, "case_id").where("bought <= recordtime").groupBy("case_id", "recordtime", "event_id").agg(F.max("bought").alias("bought"))
    return last.withColumn("value", T.time_difference(F.col("recordtime"), F.col("bought"), "h"))


@query(f"""WITH {_CASES}, v AS (SELECT c.case_id, event_id, ts FROM events e JOIN c ON e.user_id = c.case_id WHERE event_type = 'view' AND ts BETWEEN lo + INTERVAL 10 DAY AND lo + INTERVAL 40 DAY),
  p AS (SELECT c.case_id, ts FROM events e JOIN c ON e.user_id = c.case_id WHERE event_type = 'purchase' AND ts BETWEEN lo + INTERVAL 3 DAY AND lo + INTERVAL 41 DAY)
  SELECT v.case_id, v.event_id, (epoch_us(v.ts) - epoch_us(max(p.ts))) // 3600000000 AS hours FROM v JOIN p ON p.case_id = v.case_id AND p.ts <= v.ts GROUP BY v.case_id, v.event_id, v.ts""")
def derived_from_required(spark, d):
    events = table(spark, d, "events")
    columns = {"case_id": "user_id", "recordtime": "ts", "value": "value", "event_id": "event_id"}
    window = TimeWindow.between(("hospital_admission", "10d"), ("hospital_admission", "40d"))
    specs = [
        DynamicSpec("since_purchase", columns, "event_type = 'view'", window=window, function=_purchase_rate, requires={"purchase": ("-7d", "1d")}),
        DynamicSpec("purchase", columns, "event_type = 'purchase'"),
    ]
    cohort, failed = _cases(spark, d).add_all({"since_purchase": events, "purchase": events}, specs)
    if failed:
        raise ValueError(str(failed))
    return cohort.series["since_purchase"].select("case_id", "event_id", F.col("value").cast("long").alias("hours"))


@query(f"""WITH {_CASES} SELECT c.case_id, count(e.event_id) AS n FROM c LEFT JOIN events e ON e.user_id = c.case_id AND e.event_type = 'view' AND e.ts BETWEEN lo - INTERVAL 48 HOUR AND lo + INTERVAL 48 HOUR GROUP BY c.case_id""")
def configured_list(spark, d):
    cohort = _cases(spark, d)
    spec = DynamicSpec("view", {"case_id": "user_id", "recordtime": "ts", "value": "value"}, "event_type = 'view'")
    cohort, _ = cohort.add_all({"view": table(spark, d, "events")}, [spec], cohort.configured_window())
    n = cohort.series["view"].groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return cohort.obs.select("case_id").join(n, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_CASES} SELECT case_id, lo AS recordtime, 1.5::DOUBLE AS value FROM c")
def constant_series(spark, d):
    return _cases(spark, d).add_series(None, DynamicSpec("dose", constant=1.5)).series["dose"]


@query("""WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS lo, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '1997-01-01' END AS hi FROM orders)
  SELECT o_orderkey, epoch_us(hi) - epoch_us(lo) AS duration, lo IS NULL OR hi IS NULL AS null_bound, coalesce(year(lo) = 9999, false) OR coalesce(year(hi) = 9999, false) AS never, lo > hi AS reversed FROM w""")
def window_validity(spark, d):
    low = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp_ntz"))
    high = F.when(F.col("o_orderkey") % 5 == 0, F.lit("9999-12-31")).otherwise(F.lit("1997-01-01")).cast("timestamp_ntz")
    orders = table(spark, d, "orders").select("o_orderkey", low.alias("lo"), high.alias("hi"))
    w = TimeWindow.between("lo", "hi")
    return orders.select("o_orderkey", w.duration().alias("duration"), w.has_null_bound().alias("null_bound"), w.ends_in_year_9999().alias("never"), w.is_reversed().alias("reversed"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 10000 DAY BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-07-30'")
def admissions_of_months(spark, d):
    later = table(spark, d, "orders").withColumn("admitted", F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 10000 DAY"))
    return P.where_sql(later, "_d7", "admitted").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_returnflag IN ('R', 'A') AND regexp_matches(l_linestatus, 'F')")
def values_of_interest(spark, d):
    found = P.filter_by_values(table(spark, d, "lineitem"), {"l_returnflag": ["R", "A"]}, rename={"l_comment": None})
    found = P.filter_by_values(found, {"l_linestatus": ["F"]}, exact=False, rename={"l_quantity": "value", "l_tax": None})
    return found.select("l_orderkey", "l_linenumber", "value", (F.col("l_extendedprice") / F.col("value")).alias("price"))


@query("""SELECT user_id, event_id, value, 'u' AS value_unit, event_type AS kind, epoch_us(ts) AS at FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL""")
def struct_measurements(spark, d):
    rows = table(spark, d, "events").withColumn("m", F.when(F.col("value").isNotNull() & F.col("event_type").isNotNull(), F.struct("value", F.lit("u").alias("unit"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))))
    found = P.struct_measurement(rows, "m", ["user_id", "event_id"], "u")
    return found.select("user_id", "event_id", "value", "value_unit", "attributes.kind", "attributes.at")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'")
def calculated_values(spark, d):
    return P.calculated(table(spark, d, "lineitem"), "l_extendedprice * (1 - l_discount)", ["l_orderkey", "l_linenumber"], "l_shipdate >= '1996-01-01'")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F'""")
def records_with_ids(spark, d):
    obs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.attach_obs_ids(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), obs, ["l_orderkey", "o_custkey"])


@query("SELECT user_id, ts AS recordtime, NULL::TIMESTAMP AS recordtime_end, NULL::DOUBLE AS recordtime_relative, NULL::DOUBLE AS recordtime_end_relative, value, NULL::VARCHAR AS value_unit, event_type FROM events")
def unified_columns(spark, d):
    return P.unify_columns(series(spark, d).select("event_type", "value", "user_id", "recordtime"), ["user_id"])


@query("""SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, 0.21) * 713 - l_quantity / 0.8 - l_tax, 6) AS gradient FROM lineitem""")
def gradients(spark, d):
    fraction = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.alveolar_gradient(F.col("l_tax"), F.col("l_quantity"), fraction).alias("gradient")), "gradient")


@query("""SELECT trim(part) AS code, count(*) AS n FROM (SELECT unnest(string_split(p_name || ', ' || p_type, ',')) AS part FROM part) WHERE trim(part) <> '' GROUP BY ALL""")
def listed_codes(spark, d):
    parts = table(spark, d, "part").select(F.explode(S.split_codes(F.concat("p_name", F.lit(", "), "p_type"))).alias("code"))
    return parts.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_custkey AS case_id, o_orderkey, o_orderdate AS t, o_orderpriority AS a, o_orderstatus AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS stay FROM orders),
  x AS (SELECT case_id, stay, t, 0 AS place, a AS ward FROM s UNION ALL SELECT case_id, stay, t, 1, b FROM s)
  SELECT case_id, stay::INT AS stay, ward, row_number() OVER (PARTITION BY case_id ORDER BY stay, place)::INT AS step FROM x""")
def ward_timeline(spark, d):
    icu = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.struct("o_orderdate", "o_orderkey").alias("icu_admission"), F.array("o_orderpriority", "o_orderstatus").alias("ward"))
    return hospital.movement_timeline(icu).select("case_id", "stay", "ward", "step")


@query("""WITH o AS (SELECT * FROM orders WHERE o_totalprice IS NOT NULL), a AS (SELECT count(*) AS n FROM o), b AS (SELECT count(*) AS n FROM o WHERE o_totalprice >= 100000), c AS (SELECT count(*) AS n FROM o WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F')
  SELECT 'not F' AS reason, b.n - c.n AS n, a.n AS screened, c.n AS included FROM a, b, c UNION ALL SELECT 'large', a.n - b.n, a.n, c.n FROM a, b, c""")
def flow_profile(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), "o_totalprice", "o_orderstatus", F.col("o_orderdate").alias("hospital_admission"), F.col("o_orderdate").alias("hospital_discharge"))
    c = Cohort(orders.where("o_totalprice IS NOT NULL"), "hospital_stay").include("o_totalprice", ">= 100000", "large").exclude("o_orderstatus", "= 'F'", "not F")
    found = c.profile()
    return spark.createDataFrame([(name, n, found["screened"], found["included"]) for name, n in found["reasons"]], "reason string, n long, screened long, included long")


@query("SELECT user_id, count(*) AS n FROM events WHERE value >= 50 GROUP BY user_id")
def struct_field_threshold(spark, d):
    rows = table(spark, d, "events").select("user_id", F.struct("value").alias("m"))
    return rows.where(P.condition("m.value >= 50")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, epoch_us(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin') - epoch_us(ts) AS shift FROM events")
def local_times(spark, d):
    local = T.utc_to_local(F.col("ts").cast("timestamp"), "Europe/Berlin")
    return table(spark, d, "events").select("event_id", (T.micros(local) - T.micros(F.col("ts").cast("timestamp_ntz"))).alias("shift"))


# --- saved cohorts, planned variables, tolerant filters, composition ------------------------------------------------------


@query(f"""WITH {_CASES}, v AS (SELECT c.case_id, value FROM c JOIN events e ON e.user_id = c.case_id AND e.event_type = 'view' AND e.ts BETWEEN lo AND hi),
  k AS (SELECT DISTINCT case_id FROM v WHERE value > 80)
  SELECT case_id, epoch_us(hi) - epoch_us(lo) AS length, (SELECT count(*) FROM v WHERE v.case_id = c.case_id) AS views, 2 AS generations, 1 AS steps FROM c WHERE case_id IN (SELECT case_id FROM k)""")
def saved_and_reloaded(spark, d):
    """Saved, loaded, selected from and saved into the same folder."""
    folder = f"{store.shared_folder(spark)}/stayframe/cohort-{uuid.uuid4().hex}"
    spec = DynamicSpec("view", {"case_id": "user_id", "recordtime": "ts", "value": "value"}, "event_type = 'view'")
    _cases(spark, d).add_series(table(spark, d, "events"), spec).save(folder, buckets=8)
    Cohort.load(spark, folder).include("view", "> 80", "much viewed").save(folder)
    back = Cohort.load(spark, folder)
    views = back.series["view"].groupBy("case_id").agg(F.count(F.lit(1)).alias("views"))
    length = T.micros(F.col("hospital_discharge")) - T.micros(F.col("hospital_admission"))
    return back.obs.join(views, "case_id").select("case_id", length.alias("length"), "views", F.lit(len(store.commits(spark, folder))).alias("generations"), F.lit(len(back.log)).alias("steps"))


def _pair(rows, required, obs):
    """The sum of two required series at the same instant."""
    right = required["right"].select("case_id", "recordtime", "event_id", F.col("value").alias("other"))
    return required["left"].join(right, ["case_id", "recordtime", "event_id"]).select("case_id", "recordtime", "event_id", (F.col("value") + F.col("other")).alias("value"))


@query(f"""WITH {_CASES} SELECT c.case_id, event_id, round(value * 16, 4) AS value FROM events e JOIN c ON e.user_id = c.case_id WHERE event_type = 'click' AND ts BETWEEN lo AND lo + INTERVAL 12 DAY""")
def series_that_share_inputs(spark, d):
    """Four layers of two series, each made of both below: every one is planned once, and written once."""
    columns = {"case_id": "user_id", "recordtime": "ts", "value": "value", "event_id": "event_id"}
    specs = [DynamicSpec(f"{side}0", columns, "event_type = 'click'") for side in "ab"]
    for i in range(1, 4):
        specs += [DynamicSpec(f"{side}{i}", function=_pair, requires={"left": Requirement(f"a{i - 1}"), "right": Requirement(f"b{i - 1}")}) for side in "ab"]
    top = DynamicSpec("top", function=_pair, requires={"left": Requirement("a3"), "right": Requirement("b3")})
    events = table(spark, d, "events")
    cohort, failed = _cases(spark, d).add_all({"a0": events, "b0": events}, [top, *specs], TimeWindow.after("hospital_admission", "12d"), share=checkpointed)
    if failed:
        raise ValueError(str(failed))
    return rounded(cohort.series["top"].select("case_id", "event_id", "value"), "value", digits=4)


def _hours_left(rows, required, obs):
    end = required["hospital_discharge"]
    return rows.join(end, "case_id").withColumn("value", T.time_difference(F.col("hospital_discharge"), F.col("recordtime"), "h"))


@query(f"""WITH {_CASES} SELECT c.case_id, event_id, (epoch_us(hi) - epoch_us(ts)) // 3600000000 AS hours FROM events e JOIN c ON e.user_id = c.case_id
  WHERE event_type = 'error' AND ts BETWEEN lo AND lo + INTERVAL 20 DAY AND c.case_id % 2 = 0""")
def derived_from_static(spark, d):
    """A series that requires a column of the observations: it is the same in every window, and only of the sources asked for."""
    obs = _cases(spark, d).obs.withColumn("data_source", F.when(F.col("case_id") % 2 == 0, "one").otherwise("two"))
    columns = {"case_id": "user_id", "recordtime": "ts", "value": "value", "event_id": "event_id"}
    spec = DynamicSpec("left", columns, "event_type = 'error'", function=_hours_left, requires={"hospital_discharge": ("-900d", "-800d")}, sources=("one",), window=TimeWindow.after("hospital_admission", "20d"))
    cohort, failed = Cohort(obs, "hospital_stay").add_all({"left": table(spark, d, "events")}, [spec])
    if failed:
        raise ValueError(str(failed))
    return cohort.series["left"].select("case_id", "event_id", F.col("value").cast("long").alias("hours"))


_TEXTS = "t AS (SELECT event_id, user_id, ts, value, CASE WHEN event_id % 4 = 0 THEN '>90' WHEN event_id % 4 = 1 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) END AS txt FROM events)"


@query(f"""WITH {_CASES}, {_TEXTS}, k AS (SELECT DISTINCT user_id FROM t WHERE TRY_CAST(txt AS INT) > 90)
  SELECT c.case_id, count(*) FILTER (TRY_CAST(txt AS DOUBLE) > 20 AND ts BETWEEN lo AND lo + INTERVAL 30 DAY) AS high,
    max(value) FILTER (TRY_CAST(txt AS INT) % 2 = 0 AND ts BETWEEN lo AND lo + INTERVAL 30 DAY) AS even_value FROM c JOIN t ON t.user_id = c.case_id
  WHERE c.case_id IN (SELECT user_id FROM k) GROUP BY c.case_id HAVING count(*) FILTER (TRY_CAST(txt AS DOUBLE) > 20 AND ts BETWEEN lo AND lo + INTERVAL 30 DAY) > 0""")
def junk_in_filters(spark, d):
    """Casts of junk are null in the filters of features, series and selections, written either way."""
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN '>90' WHEN event_id % 4 = 1 THEN 'n/a' ELSE CAST(event_id % 100 AS string) END")
    texts = table(spark, d, "events").withColumn("txt", text)
    columns = {"case_id": "user_id", "recordtime": "ts", "value": "value", "txt": "txt"}
    marks = DynamicSpec("mark", columns | {"value": "txt"}, window=TimeWindow())
    cohort = _cases(spark, d).add_series(texts, DynamicSpec("all", columns, window=TimeWindow())).add_series(texts, marks).include("mark", ":: INT > 90", "marked")
    month = TimeWindow.after("hospital_admission", "30d")
    wanted = [A.Feature("high", "!count value", "CAST(txt AS DOUBLE) > 20", month), A.Feature("even_value", "!max value", "(txt::INT) % 2 = 0", month)]
    return cohort.add_features("all", wanted).obs.where("high IS NOT NULL").select("case_id", "high", "even_value")


@query(f"""WITH {_CASES}, r AS (SELECT case_id, hour(hi) < 12 AS a, case_id % 3 = 0 AS b, minute(lo) % 2 = 1 AS c FROM c)
  SELECT concat_ws('+', CASE WHEN a THEN 'ends early' END, CASE WHEN b THEN 'third' END, CASE WHEN c THEN 'odd minute' END) AS reasons, a::INT + b::INT + c::INT AS n_reasons, count(*) AS rows FROM r GROUP BY a, b, c""")
def overlapping_reasons(spark, d):
    cohort = _cases(spark, d)
    reasons = {"ends early": F.hour("hospital_discharge") < 12, "third": F.col("case_id") % 3 == 0, "odd minute": F.minute("hospital_admission") % 2 == 1}
    return cohort.overlaps(reasons).select(F.array_join("reasons", "+").alias("reasons"), F.col("n_reasons").cast("int").alias("n_reasons"), "rows")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
  SELECT count(*) FILTER (o.k IS NOT NULL AND a.k IS NOT NULL) AS stayed, count(*) FILTER (o.k IS NULL) AS came, count(*) FILTER (a.k IS NULL) AS went, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS rows_before,
    coalesce(sum(a.n), 0)::BIGINT AS rows_after FROM o FULL JOIN a ON a.k = o.k""")
def changed_composition(spark, d):
    orders = table(spark, d, "orders")
    return M.composition_change(orders.where("o_totalprice > 200000"), orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")


_MEETINGS = f"""WITH {{ep}}, w AS (SELECT event_id AS window_id, user_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS lo, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + to_hours((event_id % 90)::INT) END AS hi FROM events WHERE event_type = 'purchase')
  SELECT ep.event_id, w.window_id, ep.user_id FROM ep JOIN w USING (user_id) WHERE (hi IS NULL OR s <= hi) AND (lo IS NULL OR e >= lo)"""


def _visit_windows(spark, d):
    visits = table(spark, d, "events").where("event_type = 'purchase'")
    length = F.make_dt_interval(F.lit(0), (F.col("event_id") % 90).cast("int"))
    bounds = {"tmin": F.when(F.col("event_id") % 13 != 0, F.col("ts")), "tmax": F.when(F.col("event_id") % 11 != 0, F.col("ts") + length)}
    return visits.withColumns(bounds).select(F.col("event_id").alias("window_id"), "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in bounds])


@query(_MEETINGS.replace("{ep}", ep("view", 3600)))
def intervals_in_windows(spark, d):
    """Intervals of hours and windows of days, some of them open, met in bins of time."""
    met = J.interval_join(episodes(spark, d, "view", "h"), _visit_windows(spark, d), "user_id")
    return met.select("event_id", "window_id", "user_id")


@query(_MEETINGS.replace("{ep}", ep("view", 3600)) + " AND NOT (lo IS NULL OR s >= lo) AND (hi IS NULL OR e <= hi) OR (s <= hi AND e >= lo AND s < lo AND e > hi)")
def intervals_over_window_starts(spark, d):
    met = J.interval_join(episodes(spark, d, "view", "h"), _visit_windows(spark, d), "user_id", relations=("OVERLAPS_LEFT", "COVERS_WINDOW"))
    return met.select("event_id", "window_id", "user_id")


@query(ORACLE_SQL["merged_episodes"])
def merged_episodes_in_slices(spark, d):
    return W.merge_episodes(episodes(spark, d, "view", "h"), "user_id", "recordtime", "recordtime_end", "2h", slices="4d")


@query("""WITH v AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS was, lead(ts) OVER w AS nxt, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, user_id || '_' || n AS stay_id, sum(CASE WHEN n > 1 AND was <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS block, epoch_us(nxt) - epoch_us(ts) AS lasts FROM v""")
def blocks_and_ids_in_slices(spark, d):
    """Sequential ids, runs of one kind and the time to the next record, scanned in slices of three days."""
    order = ["recordtime", "event_id"]
    rows = series(spark, d).select("event_id", "user_id", "recordtime", "event_type")
    named = W.sequential_id(rows, "user_id", order, "stay_id", slices="3d")
    blocks = W.change_blocks(named, "user_id", "event_type", order, slices="3d")
    ends = W.impute_end(rows, "user_id", "recordtime", "end", tiebreak=["event_id"], slices="3d").select("event_id", "end")
    lasts = (T.micros(F.col("end")) - T.micros(F.col("recordtime"))).alias("lasts")
    return blocks.join(ends, "event_id", "left").select("event_id", "stay_id", F.col("block").cast("long").alias("block"), lasts)


# --- procedures, static joins, overrides, user code -------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_custkey AS c, o_orderkey AS seq, o_orderpriority AS ward, min(o_orderdate + to_hours((l_linenumber * 2 - 5)::INT)) AS began, string_agg('5-' || (l_partkey % 7), '+' ORDER BY l_linenumber, l_partkey % 7) AS codes
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL),
  n AS (SELECT o_orderkey, p.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch_us(began) - epoch_us(o_orderdate)) , began, CASE WHEN began > o_orderdate THEN seq ELSE -seq END) AS i FROM orders JOIN p ON c = o_custkey AND abs(epoch_us(began) - epoch_us(o_orderdate)) <= 14400000000)
  SELECT o_custkey AS case_id, o_orderdate AS or_time_begin, o_orderdate + to_hours((o.o_orderkey % 9)::INT) AS or_time_end, o_orderdate + INTERVAL 30 MINUTE AS or_time_incision, began AS or_time_ops, coalesce(codes, '') AS codes, ward AS bw_ward
  FROM orders o LEFT JOIN n ON n.o_orderkey = o.o_orderkey AND i = 1""")
def procedures_of_cases(spark, d):
    """Orders as treatments of a hierarchy, with times as text, and their lines as coded procedures of the customer."""
    orders = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz"))
    text = lambda hours: F.date_format(F.col("t") + F.make_dt_interval(F.lit(0), hours), "yyyy-MM-dd HH:mm:ss")
    node = lambda n, parent, name, value=None: F.struct((F.col("o_orderkey") * 10 + n).alias("id"), (F.col("o_orderkey") * 10 + parent if parent is not None else F.lit(None).cast("long")).alias("parent_id"), F.lit(name).alias("name"), (value if value is not None else F.lit(None).cast("string")).alias("value"))
    half_past = F.date_format(F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30)), "yyyy-MM-dd HH:mm:ss")
    nodes = [node(0, None, "treatment"), node(1, 0, "begin", text(F.lit(0))), node(2, 0, "end", text((F.col("o_orderkey") % 9).cast("int"))), node(3, 0, "operation"), node(4, 3, "event", F.lit("CUT")), node(5, 3, "at", half_past)]
    hierarchy = orders.select(F.col("o_custkey").alias("case_id"), F.explode(F.array(*nodes)).alias("x")).select("case_id", "x.*")
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "t"), "l_orderkey")
    code = F.concat(F.when(F.col("l_returnflag") == "R", "5-").otherwise("8-"), (F.col("l_partkey") % 7).cast("string"))
    begin = F.col("t") + F.make_dt_interval(F.lit(0), (F.col("l_linenumber") * 2 - 5).cast("int"))
    coded = lines.select(F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("seq"), code.alias("code"), begin.alias("begin"))
    movements = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("ward"), F.col("o_orderstatus").alias("department"))
    names = {"treatment": "treatment", "begin": "begin", "end": "end", "operation": "operation", "event": "event", "event_time": "at"}
    found = hospital.build_procedures(hierarchy, coded, movements, names=names, events={"CUT": "or_time_incision"}, zone="UTC")
    return found.select("case_id", "or_time_begin", "or_time_end", "or_time_incision", "or_time_ops", F.array_join("ops_code", "+").alias("codes"), "bw_ward")


@query("""SELECT c_custkey, c_mktsegment, n AS orders_n, spent AS orders_spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def static_values_joined(spark, d):
    """One row a key joined to the observations under another name; what they had under that name goes."""
    obs = table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumns({"orders": F.lit(1), "orders_old": F.lit(2)})
    data = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("count_n"), F.round(F.sum("o_totalprice"), 2).alias("count_spent"))
    return J.add_static(obs, data, "c_custkey", "count", "orders", replace="prefix")


@query(f"""WITH {_CASES} SELECT c.case_id, count(*) AS n FROM events e JOIN c ON e.user_id = c.case_id WHERE event_type = 'view' AND value <= 50 AND ts BETWEEN lo AND lo + INTERVAL 5 DAY GROUP BY c.case_id""")
def overridden_definition(spark, d):
    """A definition with a window of its own that no other replaces, and cleaning that a project changes."""
    definition = {"where": "event_type = 'view'", "cleaning": {"value": {"low": 0.0, "high": 900.0}}, "frozen": True}
    given = overridden(definition, {"cleaning": {"value": {"high": 50.0}}})
    columns = {"case_id": "user_id", "recordtime": "ts", "value": "value"}
    spec = DynamicSpec("view", columns, window=TimeWindow.after("hospital_admission", "5d"), levels=("hospital_stay",), **given)
    found = _cases(spark, d).add_series(table(spark, d, "events"), spec, TimeWindow.after("hospital_admission", "90d")).series["view"]
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CASES}, x AS (SELECT c.case_id, floor((epoch_us(ts) - epoch_us(lo)) / 86400000000)::BIGINT AS day FROM c JOIN events e ON e.user_id = c.case_id AND event_type = 'error' AND ts >= lo AND ts < lo + INTERVAL 14 DAY)
  SELECT c.case_id, (14 - (SELECT count(DISTINCT day) FROM x WHERE x.case_id = c.case_id))::INT AS quiet_14d FROM c""")
def quiet_days(spark, d):
    """The horizon variable: days of the first 14 without an error; an error lasts a moment."""
    columns = {"case_id": "user_id", "recordtime": "ts", "recordtime_end": "CAST(ts AS timestamp_ntz) + INTERVAL 0.000001 SECOND"}
    errors = P.select_sql(table(spark, d, "events"), columns, "event_type = 'error'")
    return _cases(spark, d).add_free_days(errors, "quiet", 14, method="day_grid").obs.select("case_id", "quiet_14d")


@query(f"""WITH {_CASES}, {ep("view", 3600)}, p AS (SELECT c.case_id, epoch_us(s) AS s, epoch_us(e) AS e, value, CASE WHEN c.case_id % 5 = 0 THEN NULL ELSE epoch_us(lo + INTERVAL 3 DAY) END AS lo, epoch_us(lo + INTERVAL 9 DAY) AS hi FROM ep JOIN c ON ep.user_id = c.case_id WHERE e > s),
  k AS (SELECT case_id, value * (least(e, hi) - greatest(s, coalesce(lo, s))) / (e - s) AS part FROM p WHERE s < hi AND (lo IS NULL OR e > lo))
  SELECT case_id, round(sum(part), 6) AS total, round(sqrt(sum(part * part)), 6) AS root FROM k GROUP BY case_id""")
def clipped_sums(spark, d):
    """One value a key, with open bounds kept; besides the sum an aggregate of the user's own."""
    cases = _cases(spark, d).obs
    low = F.when(F.col("case_id") % 5 != 0, T.offset(F.col("hospital_admission"), "3d"))
    bounds = cases.select(F.col("case_id").alias("user_id"), low.alias("lo"), T.offset(F.col("hospital_admission"), "9d").alias("hi"))
    rows = episodes(spark, d, "view", "h").join(bounds, "user_id")
    one = lambda aggregate, name: W.interval_bucket(rows, "user_id", tmin="lo", tmax="hi", missing="keep", aggregate=aggregate).select(F.col("user_id").alias("case_id"), F.round("value", 6).alias(name))
    return one(F.sum, "total").join(one(lambda v: F.sqrt(F.sum(v * v)), "root"), "case_id")


def _halves(rows):
    """Sums of a user's values in the first and the second half of its rows: a rule of the user's own that needs them in order."""
    ordered = rows.sort_values(["ts", "event_id"])
    middle = len(ordered) // 2
    sums = [[float(part["value"].sum())] for part in (ordered.iloc[:middle], ordered.iloc[middle:])]
    return ordered[["user_id"]].head(1).assign(early=sums[0], late=sums[1])


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type = 'click')
  SELECT user_id, round(coalesce(sum(value) FILTER (n <= c // 2), 0), 4) AS early, round(coalesce(sum(value) FILTER (n > c // 2), 0), 4) AS late FROM r GROUP BY user_id""")
def halves_by_user_code(spark, d):
    clicks = table(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id", "ts", "value")
    found = per_group(clicks, "user_id", _halves, "user_id long, early double, late double")
    return rounded(found, "early", "late", digits=4)
