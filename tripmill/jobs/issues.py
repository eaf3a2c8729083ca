"""Registered queries on issue codes and screens, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import chains, issues

from .queries import BACK, DAY, diary, query

LABELS = issues.Labels(BACK, ["purchase"], ["purchase"], ["click"], "view")
HOUSE = ["hh", "day"]

# The diary with mirrored trips that the capture filled in, starts at 23:01, nights, and half of
# the people's companions (numbered -1 - person), some of them twelve hours off.
CODED = """, b AS (SELECT *, lag(origin) OVER w AS po, lag(start) OVER w AS ps, lag(minutes) OVER w AS pm, event_id % 9 = 0 AND lag(trip) OVER w IS NOT NULL AS mirrored
  FROM diary WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
m AS (SELECT hh, person, day, trip, event_id, home, motive, CASE WHEN mirrored THEN po ELSE dest END AS dest, origin, CASE WHEN mirrored THEN pm ELSE minutes END AS minutes,
  CASE WHEN mirrored THEN ps + CASE WHEN event_id % 2 = 0 THEN 61 ELSE 301 END WHEN event_id % 23 = 0 THEN 1381 WHEN event_id % 5 = 0 AND start >= 1080 THEN start - 1080 ELSE start END AS start,
  CASE WHEN mirrored THEN (event_id - 1) % 2 ELSE event_id % 2 END AS mode, event_id % 17 = 0 AS edited FROM b),
two AS (SELECT *, 0 AS shadow FROM m UNION ALL SELECT * REPLACE (-1 - person AS person, start + event_id % 4 * 9 + CASE WHEN event_id % 10 = 0 THEN 720 ELSE 0 END AS start), 1 FROM m WHERE person % 2 = 0),
coded AS (SELECT *, CASE WHEN dest = home THEN CASE WHEN event_id % 4 = 0 THEN 'shop' ELSE 'home' END WHEN event_id % 6 = 0 THEN 'home' ELSE 'place' END AS kind,
  CASE WHEN person % 3 = 0 THEN 'shop' ELSE 'home' END AS answer FROM two)"""
V = "(PARTITION BY hh, day, person ORDER BY trip)"
WALK = f""", s0 AS (SELECT *, CASE WHEN motive IS DISTINCT FROM 'signup' THEN false WHEN dest = home THEN true END AS sig, first(origin = home) OVER {V} AS f FROM coded),
s1 AS (SELECT *, coalesce(motive = 'signup' AND coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY hh, day, person ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f), false) AS non_trip FROM s0),
s2 AS (SELECT *, coalesce(lead(trip) OVER {V} IS NULL AND motive = 'signup' AND lag(motive) OVER {V} = 'purchase' AND lag(start) OVER {V} >= 1080 AND lag(dest) OVER {V} = origin
  AND first(motive) OVER (PARTITION BY hh, day, person ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'signup'
  AND first(origin) OVER (PARTITION BY hh, day, person ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = origin, false) AS morning FROM s1 WHERE NOT non_trip),
t AS (SELECT * FROM s2 WHERE NOT morning)"""


def wraps_of(table: str, x: str = "") -> str:
    """CTEs that end in q (after the prefix x): table plus wraps and days."""
    whole = "(PARTITION BY hh, day, person ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f""", {x}n0 AS (SELECT *, lag(start) OVER {V} AS prev, lag(motive) OVER {V} AS prem, coalesce(max((motive = 'purchase')::INT) OVER (PARTITION BY hh, day, person ORDER BY trip ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM {table}),
{x}n1 AS (SELECT *, coalesce(((start <= 360 AND (prev >= 1080 OR (prev >= 720 AND motive = 'signup'))) OR (motive = 'signup' AND prem = 'purchase' AND prev >= 1080 AND start < 600)) AND later = 0, false) AS night FROM {x}n0),
{x}n2 AS (SELECT *, start + 1440 * sum(night::INT) OVER {V} AS clock FROM {x}n1),
{x}n3 AS (SELECT *, night AND coalesce(max(clock) OVER {whole} - first(clock) OVER {whole} < 1440, false) AS wraps FROM {x}n2),
{x}q AS (SELECT *, sum(wraps::INT) OVER {V} AS days FROM {x}n3)"""


def _clock(a: str, b: str) -> str:
    return f"least(abs({a} - {b}) % 1440, 1440 - abs({a} - {b}) % 1440)"


def _links(table: str, start: str) -> str:
    """CTE links: companion trips of table by the starts of that column."""
    side = lambda p: f"""coalesce(a.{p}o = b.{p}o AND a.{p}d = b.{p}d AND a.{p}m = b.{p}m AND a.{p}m <> 'click' AND {_clock(f"a.{p}s", f"b.{p}s")} <= 20 AND a.{p}s <= b.{p}e AND b.{p}s <= a.{p}e, false)"""
    beside = ", ".join(f"{f}({c}) OVER {V} AS {p}{n}" for p, f in (("v", "lag"), ("x", "lead")) for c, n in (("origin", "o"), ("dest", "d"), ("motive", "m"), (start, "s"), (f"{start} + minutes", "e")))
    same = "e.gap <= 20 AND e.hh = p.hh AND e.day = p.day AND e.person_a = p.person_a AND e.person_b = p.person_b"
    return f""", near AS (SELECT *, {beside} FROM {table}),
pairs AS (SELECT a.hh, a.day, a.person AS person_a, a.trip AS trip_a, b.person AS person_b, b.trip AS trip_b, a.start AS start_a, b.start AS start_b, {_clock(f"a.{start}", f"b.{start}")} AS gap,
  {side("v")} OR {side("x")} AS linked FROM near a JOIN near b ON a.hh = b.hh AND a.day = b.day AND a.origin = b.origin AND a.dest = b.dest AND a.motive = b.motive AND a.person < b.person),
links AS (SELECT * FROM pairs p WHERE linked AND NOT EXISTS (SELECT 1 FROM pairs e WHERE {same} AND e.trip_a = p.trip_a AND e.trip_b <> p.trip_b)
  AND NOT EXISTS (SELECT 1 FROM pairs e WHERE {same} AND e.trip_b = p.trip_b AND e.trip_a <> p.trip_a))"""


ISSUES = [
    ("inverted", "inv"), ("overnight", "wraps"), ("earlier", "start < prev AND NOT inv AND NOT wraps"), ("same_minute", "start = prev AND NOT inv"),
    ("overlap", "start > prev AND start < arrival AND NOT inv"), ("discontinuous", "NOT first AND origin IS DISTINCT FROM pd"), ("return_elsewhere", "motive = 'signup' AND dest <> home"),
    ("doubtful_kind", "motive = 'signup' AND dest = home AND kind <> 'home'"), ("first_away", "first AND answer <> 'home'"), ("first_other_zone", "first AND answer = 'home' AND origin <> home"),
    ("last_away", "last AND NOT (motive IS NOT DISTINCT FROM 'signup' AND dest = home)"), ("activity_at_home", "motive IS DISTINCT FROM 'signup' AND kind = 'home'"), ("daycare", "motive = 'view'"),
    ("start_2301", "start = 1381 AND NOT edited"), ("gap_61", "mirror AND start - prev = 61"), ("gap_301", "mirror AND start - prev = 301"),
    ("early_start", "first AND coalesce(motive NOT IN ('signup', 'purchase'), true) AND start < 300"), ("companion_12h", "half"),
]


def issues_of(t: str) -> str:
    """CTEs that end in r, the trips of t with what the codes read."""
    return (
        wraps_of(t) + f", l0 AS (SELECT *, CASE WHEN NOT edited THEN start END AS told FROM {t})" + _links("l0", "told")
        + f""", h AS (SELECT hh, day, person_a AS person, trip_a AS trip FROM links WHERE 720 - gap <= 20 UNION SELECT hh, day, person_b, trip_b FROM links WHERE 720 - gap <= 20),
r AS (SELECT q.*, lag(trip) OVER {V} IS NULL AS first, lead(trip) OVER {V} IS NULL AS last, lag(start + minutes) OVER {V} AS arrival, lag(dest) OVER {V} AS pd,
  coalesce(start < lag(start + minutes) OVER {V} - 15 AND NOT wraps, false) AS inv, coalesce(origin = lag(dest) OVER {V} AND dest = lag(origin) OVER {V} AND minutes = lag(minutes) OVER {V}
  AND mode = lag(mode) OVER {V} AND NOT edited AND NOT lag(edited) OVER {V}, false) AS mirror, (hh, day, person, trip) IN (SELECT (hh, day, person, trip) FROM h) AS half FROM q)"""
    )


CODES = "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in ISSUES) + ")"
ISSUES_SQL = (
    CODED + WALK + issues_of("t") + f"SELECT event_id, shadow, {CODES} AS issues FROM r"
    + " UNION ALL SELECT event_id, shadow, 'no_trip_next_morning' FROM s2 WHERE morning UNION ALL SELECT event_id, shadow, 'no_trip_at_home' FROM s1 WHERE non_trip"
)


def _coded(spark, folder):
    w = chains.over(DAY)
    event, was = F.col("event_id"), lambda c: F.lag(c).over(w)
    d = diary(spark, folder).withColumn("_m", (event % 9 == 0) & was("trip").isNotNull())
    night = F.when(event % 23 == 0, 1381).when((event % 5 == 0) & (F.col("start") >= 1080), F.col("start") - 1080).otherwise(F.col("start"))
    m = d.select(
        "hh", "person", "day", "trip", "event_id", "home", "motive", F.when(F.col("_m"), was("origin")).otherwise(F.col("dest")).alias("dest"), "origin",
        F.when(F.col("_m"), was("minutes")).otherwise(F.col("minutes")).alias("minutes"),
        F.when(F.col("_m"), was("start") + F.when(event % 2 == 0, 61).otherwise(301)).otherwise(night).alias("start"),
        F.when(F.col("_m"), (event - 1) % 2).otherwise(event % 2).alias("mode"), (event % 17 == 0).alias("edited"), F.lit(0).alias("shadow"),
    )
    late = F.col("start") + event % 4 * 9 + F.when(event % 10 == 0, 720).otherwise(0)
    two = m.unionByName(m.where("person % 2 = 0").withColumns({"person": -1 - F.col("person"), "start": late, "shadow": F.lit(1)}))
    kind = F.when(F.col("dest") == F.col("home"), F.when(event % 4 == 0, "shop").otherwise("home")).when(event % 6 == 0, "home").otherwise("place")
    return two.withColumns({"kind": kind, "answer": F.when(F.col("person") % 3 == 0, "shop").otherwise("home")})


@query(ISSUES_SQL, diary=True)
def issue_codes(spark, folder):
    return issues.issue_codes(_coded(spark, folder), HOUSE, "person", LABELS).select("event_id", "shadow", "issues")


SCREENS_SQL = (
    CODED + wraps_of("coded") + f""", a AS (SELECT *, start + 1440 * days AS moment, lag(trip) OVER {V} IS NULL AS first, lead(trip) OVER {V} IS NULL AS last, lag(motive) OVER {V} = 'purchase' AS was_work FROM q),
y AS (SELECT *, lead(moment) OVER {V} - moment - minutes AS stay FROM a), told AS (SELECT *, start - CASE WHEN edited THEN 40 ELSE 0 END AS told FROM coded)"""
    + _links("told", "told")
    + f""", c AS (SELECT DISTINCT hh, day, person, trip, kind FROM (SELECT *, CASE WHEN gap <= 20 AND {_clock("start_a", "start_b")} > 20 THEN 'apart' WHEN gap > 20 AND 720 - {_clock("start_a", "start_b")} <= 20 THEN 'half' END AS kind, person_a AS person, trip_a AS trip FROM links UNION ALL SELECT *, CASE WHEN gap <= 20 AND {_clock("start_a", "start_b")} > 20 THEN 'apart' WHEN gap > 20 AND 720 - {_clock("start_a", "start_b")} <= 20 THEN 'half' END, person_b, trip_b FROM links) WHERE kind IS NOT NULL),
k AS (SELECT hh, day, person, count(*) FILTER (kind = 'apart') AS apart, count(*) FILTER (kind = 'half') AS half FROM c GROUP BY ALL),
g AS (SELECT hh, day, person, count(*) FILTER (stay = 0) AS zero_stays, count(*) FILTER (stay = 0 AND motive = 'purchase') AS zero_work_stays, count(*) FILTER (motive = 'purchase' AND stay < 30) AS short_work_stays,
  count(*) FILTER (stay = 0 AND motive NOT IN ('signup', 'purchase', 'click')) AS zero_away_stays, CAST(coalesce(sum(greatest(stay, 0)) FILTER (motive = 'purchase'), 0) AS BIGINT) AS work_minutes,
  CAST(max(moment + minutes) - min(moment) AS BIGINT) AS day_minutes, count(*) FILTER (stay >= 480 AND motive NOT IN ('signup', 'purchase')) AS long_errands,
  coalesce(bool_or(first AND motive NOT IN ('signup', 'purchase') AND start < 300), false) AS early_start, coalesce(bool_or(last AND motive = 'signup' AND was_work AND moment >= 1440 AND moment < 2040), false) AS night_shift_end
  FROM y GROUP BY ALL),
z AS (SELECT g.*, coalesce(apart, 0) AS companion_apart_trips, coalesce(half, 0) AS companion_12h_trips FROM g LEFT JOIN k USING (hh, day, person))
SELECT *, zero_stays > 0 AS zero_stay, zero_work_stays > 0 AS zero_work, short_work_stays > 0 AS short_work, work_minutes > 840 AS long_workday, day_minutes > 1200 AS long_day, long_errands > 0 AS long_errand,
  companion_apart_trips > 0 AS companion_apart, companion_12h_trips > 0 AS companion_12h, zero_away_stays + short_work_stays + early_start::BIGINT + long_errands + (day_minutes > 1200 AND NOT night_shift_end)::BIGINT + companion_apart_trips + companion_12h_trips AS problems FROM z"""
)


@query(SCREENS_SQL, diary=True)
def chain_screens(spark, folder):
    told = F.col("start") - F.when(F.col("edited"), 40).otherwise(0)
    return issues.chain_screens(_coded(spark, folder).withColumn("told", told), HOUSE, "person", LABELS, "told")
