"""The registered queries of the whole survey cleaning, and the SQL of its rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tripmill.operators import survey

from .issues import CODES, HOUSE, issues_of, wraps_of
from .queries import BACK, DAY, DIARY, ORACLE_SQL, diary, query, slide_sql

RULES = survey.SurveyRules(
    BACK, "other", "home", ["purchase"], ["purchase"], ["view"], "click", "view", {"p0": "view", "p1": "purchase"}, ["p2"],
    same={"mode": 1.5, "same_place_motive": 2.0, "within_zone": 1.0, "from_home": 1.0, "is_first": 1.0, "next_is_return": 1.0}, numeric={"log_minutes": 1.0, "next_hour": 1.0},
)
PLAIN = replace(RULES, impute=False, read_hours=False)
W = "(PARTITION BY person, day ORDER BY trip)"
ALL = "(PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _step(name: str, source: str, hit: str, code: str, changes: str, extra: str = "") -> str:
    """CTE name: source with changes (column = value, ...) where hit, and the code noted."""
    sets = ", ".join(f"CASE WHEN hit THEN {v} ELSE {c} END AS {c}" for c, v in (x.split(" := ") for x in changes.split("; ") if x))
    noted = "CASE WHEN hit THEN " + (code if code.startswith("list_concat") else f"list_append(fx, '{code}')") + " ELSE fx END AS fx"
    return f""", {name} AS (SELECT * EXCLUDE (hit) REPLACE ({sets}{", " if sets else ""}{noted}) FROM (SELECT *, coalesce({hit}, false) AS hit{extra} FROM {source}))"""


def _idle(name: str, source: str) -> str:
    """CTE name: source plus idle, a return made at home."""
    return f""", {name}_s AS (SELECT *, CASE WHEN motive IS DISTINCT FROM 'signup' THEN false WHEN dest = home THEN true END AS sig, first(coalesce(answer = 'home' AND origin = home, false)) OVER {W} AS f FROM {source}),
{name} AS (SELECT * EXCLUDE (sig, f), motive IS NOT DISTINCT FROM 'signup' AND coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f) AS idle FROM {name}_s)"""


SAYS = "CASE {} WHEN 'p0' THEN 'view' WHEN 'p1' THEN 'purchase' ELSE 'other' END"
MINUTES = "CAST(list_sum(list_transform(range(1, 2 + event_id % 3), lambda l: event_id * l % 20 + 1)) AS BIGINT)"
CLEAN = (
    "WITH RECURSIVE " + DIARY
    + f""", b0 AS (SELECT event_id, person, day, trip, hh, home, start, dest, CASE WHEN trip = 1 THEN (home + person % 4 + 1) % 5 WHEN event_id % 7 = 0 THEN home ELSE origin END AS origin,
    CASE WHEN event_id % 11 <> 0 THEN motive END AS motive, {MINUTES} AS own, person % 90 AS age, person % 4 AS occupation, event_id % 2 AS mode FROM diary),
s0 AS (SELECT * EXCLUDE (own), own + CASE WHEN event_id % 31 = 0 THEN 5 ELSE 0 END AS minutes, event_id % 31 = 0 AS corrected, CASE WHEN event_id % 31 = 0 THEN ['minutes:review'] ELSE CAST([] AS VARCHAR[]) END AS fx,
    CASE WHEN dest = home THEN CASE WHEN event_id % 4 = 0 THEN 'p0' ELSE 'home' END WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 'home' ELSE 'p' || dest % 3 END AS kind,
    CASE person % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'p1' ELSE 'p0' END AS answer, home + 300 AS home_zone, (dest * 7 + event_id % 5) % 5 + 100 AS dest_zone, (origin * 3 + event_id % 5) % 5 + 200 AS origin_zone FROM b0),
p1 AS (SELECT *, coalesce(motive IS NULL AND origin <> home AND dest = home AND lead(motive) OVER {W} = 'signup' AND lead(origin) OVER {W} = home AND lead(dest) OVER {W} = home, false) AS pair,
    lead(motive) OVER {W} AS nm, lead(kind) OVER {W} AS nk FROM s0),
p2 AS (SELECT *, coalesce(lag(pair) OVER {W}, false) AS gone FROM p1),
s1 AS (SELECT * EXCLUDE (pair, nm, nk, gone) REPLACE (CASE WHEN pair THEN nm ELSE motive END AS motive, CASE WHEN pair THEN nk ELSE kind END AS kind,
    CASE WHEN pair THEN list_append(fx, 'motive:duplicate') ELSE fx END AS fx) FROM p2 WHERE NOT gone)"""
    + _step("s2", "s1", "motive = 'signup' AND dest <> home AND kind <> 'home'", "motive:kind", "motive := " + SAYS.format("kind"))
    + _step("s3", "s2", "motive = 'signup' AND dest = origin AND dest <> home", "dest:copy", "dest := home; dest_zone := home_zone")
    + _step("s4", "s3", f"lag(trip) OVER {W} IS NOT NULL AND motive <> 'signup' AND kind = 'home' AND dest = home AND origin <> home", "motive:home", "motive := 'signup'")
    + _step("s5", "s4", "motive = 'view' AND age >= 12", "motive:daycare", "motive := 'click'")
    + _idle("w5", "s5")
    + f""", v0 AS (SELECT person, day, dest, motive, kind, count(*) AS n FROM w5 WHERE NOT idle AND motive <> 'signup' GROUP BY ALL),
v1 AS (SELECT person, day, dest, motive, sum(n) AS n, min((-n, kind)) FILTER (kind IS NOT NULL) AS k FROM v0 GROUP BY ALL),
v2 AS (SELECT person, day, dest, motive AS um, k[2] AS uk FROM v1 QUALIFY row_number() OVER (PARTITION BY person, day, dest ORDER BY n DESC, motive) = 1),
e0 AS (SELECT w5.*, um, uk, first(origin) OVER (PARTITION BY w5.person, w5.day, idle ORDER BY trip) AS began FROM w5 LEFT JOIN v2 USING (person, day, dest)),
e1 AS (SELECT * EXCLUDE (began), coalesce(um, CASE WHEN began = dest AND answer <> 'home' THEN {SAYS.format("answer")} END) AS m FROM e0)"""
    + _step("e2", "e1", "NOT idle AND motive = 'signup' AND dest <> home AND dest <> origin AND m IS NOT NULL", "motive:place", "motive := m; kind := CASE WHEN um IS NOT NULL THEN uk ELSE answer END")
    + ", s6 AS (SELECT * EXCLUDE (um, uk, m, idle) FROM e2)"
    + _idle("w6", "s6")
    + f""", m1 AS (SELECT *, coalesce(lead(trip) OVER {W} IS NULL AND motive = 'signup' AND origin <> home AND lag(motive) OVER {W} = 'purchase' AND lag(dest) OVER {W} = origin AND lag(start) OVER {W} >= 1080
    AND first(motive) OVER {ALL} = 'signup' AND first(origin) OVER {ALL} = origin, false) AS morning FROM w6 WHERE NOT idle),
rest AS (SELECT *, 'no_trip_at_home' AS no_trip FROM w6 WHERE idle UNION ALL SELECT * EXCLUDE (morning), 'no_trip_next_morning' FROM m1 WHERE morning),
tt AS (SELECT * EXCLUDE (morning), lag(dest) OVER {W} AS ld, lag(dest_zone) OVER {W} AS lz, lag(motive) OVER {W} = 'signup' AND lag(dest) OVER {W} = home AS homeward,
    coalesce(origin <> lag(dest) OVER {W}, false) AS broken FROM m1 WHERE NOT morning)"""
    + _step("t1", "tt", "broken", "list_concat(fx, [CASE WHEN homeward THEN 'origin:home' ELSE 'origin:before' END])", "origin := ld; origin_zone := lz")
    + f""", t2 AS (SELECT *, lag(trip) OVER {W} IS NULL AND motive IS DISTINCT FROM 'signup' AND origin <> home AS away FROM t1),
t3 AS (SELECT *, away AND origin = dest AS copied, coalesce(away AND origin <> dest AND dest <> home AND answer = 'home', false) AS answered,
    coalesce(away AND origin <> dest AND dest <> home AND answer = kind AND answer <> 'p2', false) AS typed FROM t2)"""
    + _step("t4", "t3", "copied OR answered OR typed", "list_concat(fx, list_filter([CASE WHEN copied THEN 'origin:copy' END, CASE WHEN answered THEN 'origin:answer' END, CASE WHEN typed THEN 'origin:kind' END], lambda x: x IS NOT NULL))", "origin := home; origin_zone := home_zone")
    + f""", t5 AS (SELECT *, coalesce(lag(trip) OVER {W} IS NULL AND motive IS DISTINCT FROM 'signup' AND origin <> home AND dest = home AND (lead(trip) OVER {W} IS NULL OR lead(origin) OVER {W} = home)
    AND (answer = 'home' OR coalesce(lead(motive) OVER {W} = 'signup' AND lead(dest) OVER {W} = home, false)), false) AS rot FROM t4),
t6 AS (SELECT *, coalesce(lag(rot) OVER {W}, false) AS onward, lag(origin) OVER {W} AS place, lag(origin_zone) OVER {W} AS pz, coalesce(kind = 'home' AND answer <> 'home', false) AS named FROM t5)"""
    + _step("t7", "t6", "rot", "list_concat(fx, CASE WHEN named THEN ['origin:rotated', 'dest:rotated', 'kind:rotated'] ELSE ['origin:rotated', 'dest:rotated'] END)",
            "origin := home; dest := origin; origin_zone := home_zone; dest_zone := origin_zone; kind := CASE WHEN named THEN answer ELSE kind END")
    + _step("t8", "t7", "onward", "list_concat(fx, CASE WHEN broken THEN [] ELSE ['origin:before'] END)", "origin := place; origin_zone := pz")
    + f""", a0 AS (SELECT event_id, person, day, trip, hh, home, start, dest, origin, motive, age, occupation, mode, minutes, corrected, fx, kind, answer, home_zone, dest_zone, origin_zone, '' AS no_trip, copied OR typed OR rot AS mv FROM t8
  UNION ALL SELECT event_id, person, day, trip, hh, home, start, dest, origin, motive, age, occupation, mode, minutes, corrected, fx, kind, answer, home_zone, dest_zone, origin_zone, no_trip, false FROM rest),
a1 AS (SELECT *, bool_or(mv) OVER (PARTITION BY person, day) AND answer <> 'home' AS cp FROM a0)"""
    + _step("a2", "a1", "cp", "answer:copy", "answer := 'home'")
    + f""", a3 AS (SELECT *, no_trip = '' AND motive = 'signup' AND origin <> home AND answer = 'home' AND row_number() OVER (PARTITION BY person, day, no_trip ORDER BY trip) = 1 AS opens FROM a2),
seen AS (SELECT * FROM a3 WHERE no_trip = '' AND motive IS DISTINCT FROM 'signup' AND kind <> 'home'),
k1 AS (SELECT person, day, dest, kind FROM seen GROUP BY person, day, dest, kind QUALIFY row_number() OVER (PARTITION BY person, day, dest ORDER BY count(*) DESC, kind) = 1),
k2 AS (SELECT hh, dest, kind FROM seen GROUP BY hh, dest, kind QUALIFY row_number() OVER (PARTITION BY hh, dest ORDER BY count(*) DESC, kind) = 1),
k3 AS (SELECT occupation, dest, kind FROM seen GROUP BY occupation, dest, kind QUALIFY row_number() OVER (PARTITION BY occupation, dest ORDER BY count(*) DESC, kind) = 1
    AND sum(count(*)) OVER (PARTITION BY occupation, dest) >= 5 AND count(*) >= 0.6 * sum(count(*)) OVER (PARTITION BY occupation, dest)),
said AS (SELECT a.person, a.day, coalesce(k1.kind, k2.kind, k3.kind, 'other') AS said FROM a3 a LEFT JOIN k1 ON k1.person = a.person AND k1.day = a.day AND k1.dest = a.origin
    LEFT JOIN k2 ON k2.hh = a.hh AND k2.dest = a.origin LEFT JOIN k3 ON k3.occupation = a.occupation AND k3.dest = a.origin WHERE coalesce(a.opens, false)),
a4 AS (SELECT a3.*, said FROM a3 LEFT JOIN said USING (person, day))"""
    + _step("a5", "a4", "said IS NOT NULL", "answer:return", "answer := said")
    + f""", o0 AS (SELECT * EXCLUDE (mv, cp, opens, said), coalesce(motive = 'signup' AND dest <> home, false) AS short, lead(trip) OVER {W} IS NULL
    AND NOT EXISTS (SELECT 1 FROM a5 o WHERE o.no_trip = '' AND o.person = d.person AND o.day = d.day AND (o.origin = d.dest OR (o.dest = d.dest AND o.trip <> d.trip))) AS alone FROM a5 d WHERE no_trip = '')"""
    + _step("o1", "o0", "short AND alone", "dest:home", "dest := home; dest_zone := home_zone")
    + _step("o2", "o1", "short AND NOT alone", "motive:other", "motive := 'other'; kind := 'other'")
    + f""", o3 AS (SELECT *, lead(start) OVER {W} - start AS gap FROM o2)"""
    + _step("o4", "o3", "motive = 'signup' AND dest = home AND NOT corrected AND gap >= 0 AND minutes - gap > 15 AND gap >= 0.5 * minutes", "minutes:return", "minutes := gap")
    + wraps_of("o4", "z")
    + f", g AS (SELECT *, row_number() OVER {W} AS rn FROM zq)"
    + slide_sql("g")
    + """, t AS (SELECT g.* EXCLUDE (rn, wraps, days, prev, prem, later, night, clock) REPLACE (w.moved_start AS start, CASE WHEN w.moved_start <> g.start THEN list_append(fx, 'hour:arrival') ELSE fx END AS fx),
    w.moved_start <> g.start AS edited FROM g JOIN walk w ON w.person = g.person AND w.day = g.day AND w.rn = g.rn)"""
)
FIELDS = "event_id, origin, dest, origin_zone, dest_zone, motive, kind, answer, start, minutes"
DONE = (
    CLEAN + issues_of("t")
    + f""", done AS (SELECT {FIELDS}, hh, person, array_to_string(fx, ';') AS fixes, {CODES} AS issues FROM r UNION ALL SELECT {FIELDS}, hh, person, array_to_string(fx, ';'), no_trip FROM a5 WHERE no_trip <> '')"""
)


def _survey(spark, folder):
    """(trips, legs, corrections) made of the diary."""
    event, person = F.col("event_id"), F.col("person")
    d = diary(spark, folder)
    place = (F.col("home") + person % 4 + 1) % 5
    d = d.withColumns(
        {
            "origin": F.when(F.col("trip") == 1, place).when(event % 7 == 0, F.col("home")).otherwise(F.col("origin")), "motive": F.when(event % 11 != 0, F.col("motive")),
            "age": person % 90, "occupation": person % 4, "mode": event % 2, "home_zone": F.col("home") + 300,
            "kind": F.when(F.col("dest") == F.col("home"), F.when(event % 4 == 0, "p0").otherwise("home")).when(event % 13 == 0, F.lit(None))
            .when(event % 6 == 0, "home").otherwise(F.concat(F.lit("p"), (F.col("dest") % 3).cast("string"))),
            "answer": F.when(person % 3 == 0, "home").when(person % 3 == 1, "p1").otherwise("p0"),
        }
    ).drop("minutes", "weight")
    d = d.withColumns({"dest_zone": (F.col("dest") * 7 + event % 5) % 5 + 100, "origin_zone": (F.col("origin") * 3 + event % 5) % 5 + 200})
    legs = d.select(*DAY, "trip", "event_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + event % 3)).alias("leg"))
    legs = legs.select(*DAY, "trip", "leg", (event * F.col("leg") % 20 + 1).alias("minutes"))
    own = F.aggregate(F.sequence(F.lit(1).cast("long"), 1 + event % 3), F.lit(0).cast("long"), lambda a, leg: a + event * leg % 20 + 1)
    d = d.withColumn("minutes", own)
    corrections = d.where(event % 31 == 0).select(*DAY, "trip", F.col("minutes").alias("before"), (F.col("minutes") + 5).alias("after"))
    return d, legs, corrections


def _cleaned(spark, folder, rules):
    trips, legs, corrections = _survey(spark, folder)
    return survey.clean_survey(trips, legs, DAY, "event_id", rules, HOUSE, "person", corrections)


@query()
def clean_survey(spark, folder):
    return _cleaned(spark, folder, PLAIN)[0].select(*FIELDS.split(", "), "fixes", "issues")


@query()
def clean_survey_legs(spark, folder):
    return _cleaned(spark, folder, PLAIN)[1]


@query()
def clean_survey_counts(spark, folder):
    return survey.clean_counts(_cleaned(spark, folder, PLAIN)[0])


@query()
def clean_survey_whole(spark, folder):
    """All rules, with neighbours for lost starts and motives and the hour search; no SQL form."""
    trips, legs, corrections = _survey(spark, folder)
    trips = trips.withColumn("start", F.when(F.col("event_id") % 19 != 0, F.col("start")))
    done = survey.clean_survey(trips, legs, DAY, "event_id", RULES, HOUSE, "person", corrections)[0]
    return done.select(*FIELDS.split(", "), "fixes", "issues")


ORACLE_SQL["clean_survey"] = DONE + f" SELECT {FIELDS}, fixes, issues FROM done"
ORACLE_SQL["clean_survey_counts"] = (
    DONE + """, c AS (SELECT person, 'fixes' AS side, unnest(string_split(fixes, ';')) AS code FROM done UNION ALL SELECT person, 'issues', unnest(string_split(issues, ';')) FROM done)
SELECT side, code, count(*) AS rows, count(DISTINCT person) AS persons FROM c WHERE code <> '' GROUP BY side, code"""
)
ORACLE_SQL["clean_survey_legs"] = (
    DONE + """, x AS (SELECT d.person, d.day, d.trip, l.leg, d.event_id * l.leg % 20 + 1 AS m, c.minutes AS total, c.fixes LIKE '%minutes:%' AS changed
  FROM done c JOIN diary d USING (event_id), (SELECT unnest(range(1, 4)) AS leg) l WHERE l.leg <= 1 + d.event_id % 3),
y AS (SELECT *, count(*) OVER e AS n, (total - count(*) OVER e) * m / sum(m) OVER e AS share FROM x WINDOW e AS (PARTITION BY person, day, trip)),
z AS (SELECT *, floor(round(share, 9)) AS f, round(share - floor(round(share, 9)), 9) AS rem FROM y)
SELECT person, day, trip, leg, CAST(CASE WHEN changed THEN 1 + f + (row_number() OVER (PARTITION BY person, day, trip ORDER BY rem DESC, leg) <= total - n - sum(f) OVER (PARTITION BY person, day, trip))::INT ELSE m END AS BIGINT) AS minutes FROM z"""
)
