"""The registered query of the whole chain cleaning, and its SQL rule by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import cleaning

from .queries import BACK, DAY, DIARY, ORACLE_SQL, diary, query, slide_sql, wraps_sql

RULES = cleaning.ChainRules(
    BACK, "other", ["purchase"], ["purchase"], daycare="view", escort="click", place_motives={0: "view"}, night_places=["0"], read_hours=False
)
W = "(PARTITION BY person, day ORDER BY trip)"
ALL = "(PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _walk(table: str, name: str) -> str:
    """CTE name: table plus non_trip."""
    return f"""{name}_s AS (SELECT *, CASE WHEN motive IS DISTINCT FROM 'signup' THEN false WHEN dest = home THEN true END AS sig, first(origin = home) OVER {W} AS f FROM {table}),
{name} AS (SELECT * EXCLUDE (sig, f), coalesce(motive = 'signup' AND coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f), false) AS non_trip FROM {name}_s)"""


CLEAN_SQL = (
    "WITH RECURSIVE " + DIARY + """, c0 AS (SELECT event_id, person, day, trip, hh, home, minutes, start, origin, dest, person % 90 AS age, event_id % 3 = 0 AS says_home, origin % 2 AS ft, dest % 2 AS tt,
    CASE WHEN event_id % 11 <> 0 THEN motive END AS motive FROM (SELECT * REPLACE (CASE WHEN trip = 1 THEN (home + person % 4 + 1) % 5 WHEN event_id % 7 = 0 THEN home ELSE origin END AS origin) FROM diary)),
"""
    + f"""p1 AS (SELECT *, coalesce(motive IS NULL AND dest = home AND origin <> home AND lead(motive) OVER {W} = 'signup' AND lead(start) OVER {W} IS NOT NULL AND lead(origin) OVER {W} = home AND lead(dest) OVER {W} = home, false) AS f1, lead(motive) OVER {W} AS m FROM c0),
g1 AS (SELECT *, coalesce(lag(f1) OVER {W}, false) AS gone FROM p1),
c1 AS (SELECT * EXCLUDE (m, gone) REPLACE (CASE WHEN f1 THEN m ELSE motive END AS motive) FROM g1 WHERE NOT gone),
c2 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'view' ELSE motive END AS motive), hit AS f2 FROM (SELECT *, coalesce(motive = 'signup', false) AND dest <> home AND dest = 0 AS hit FROM c1)),
c3 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN home ELSE dest END AS dest), hit AS f3 FROM (SELECT *, coalesce(motive = 'signup', false) AND dest = origin AND origin <> home AS hit FROM c2)),
c4 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'signup' ELSE motive END AS motive), hit AS f4 FROM (SELECT *, row_number() OVER {W} > 1 AND dest = home AND origin <> home AND motive IS DISTINCT FROM 'signup' AS hit FROM c3)),
c5 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'click' ELSE motive END AS motive), hit AS f5 FROM (SELECT *, coalesce(motive = 'view' AND age >= 12, false) AS hit FROM c4)),
"""
    + _walk("c5", "c6")
    + f""", own AS (SELECT person, dest, motive AS usual FROM (SELECT person, dest, motive, row_number() OVER (PARTITION BY person, dest ORDER BY count(*) DESC, motive) AS n
  FROM c6 WHERE NOT non_trip AND motive <> 'signup' GROUP BY person, dest, motive) WHERE n = 1),
c7 AS (SELECT * EXCLUDE (non_trip, usual, hit) REPLACE (CASE WHEN hit THEN usual ELSE motive END AS motive), hit AS f6 FROM (SELECT c6.*, usual, NOT non_trip AND coalesce(motive = 'signup', false) AND c6.dest <> home AND usual IS NOT NULL AS hit
  FROM c6 LEFT JOIN own ON own.person = c6.person AND own.dest = c6.dest)),
"""
    + _walk("c7", "c8")
    + f""", m1 AS (SELECT *, coalesce(lead(trip) OVER {W} IS NULL AND motive = 'signup' AND lag(motive) OVER {W} = 'purchase' AND lag(start) OVER {W} >= 1080
  AND lag(dest) OVER {W} = origin AND first(motive) OVER {ALL} = 'signup' AND first(origin) OVER {ALL} = origin, false) AS morning FROM c8 WHERE NOT non_trip),
c9 AS (SELECT * REPLACE (fresh AS origin), fresh IS DISTINCT FROM origin AS f7 FROM (SELECT *, coalesce(lag(dest) OVER {W}, origin) AS fresh FROM m1 WHERE NOT morning)),
c10 AS (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN home ELSE origin END AS origin), hit AS f8 FROM (SELECT *, coalesce(lag(trip) OVER {W} IS NULL AND motive IS DISTINCT FROM 'signup' AND origin <> home
  AND (origin = dest OR says_home OR (ft = tt AND ft <> 0)), false) AS hit FROM c9)),
r1 AS (SELECT *, coalesce(row_number() OVER {W} = 1 AND origin <> home AND dest = home AND lead(origin) OVER {W} = home, false) AS rot FROM c10),
r2 AS (SELECT *, CASE WHEN rot THEN home WHEN lag(rot) OVER {W} THEN lag(origin) OVER {W} ELSE origin END AS o2, CASE WHEN rot THEN origin ELSE dest END AS d2 FROM r1),
c11 AS (SELECT * EXCLUDE (o2, d2, rot) REPLACE (o2 AS origin, d2 AS dest), o2 IS DISTINCT FROM origin OR d2 IS DISTINCT FROM dest AS f9 FROM r2),
s1 AS (SELECT *, coalesce(motive = 'signup' AND dest <> home, false) AS off, lead(trip) OVER {W} IS NULL
  AND NOT EXISTS (SELECT 1 FROM c11 o WHERE o.person = d.person AND o.day = d.day AND o.trip <> d.trip AND (o.origin = d.dest OR o.dest = d.dest)) AS alone FROM c11 d),
c12 AS (SELECT * EXCLUDE (off, alone) REPLACE (CASE WHEN off AND alone THEN home ELSE dest END AS dest, CASE WHEN off AND NOT alone THEN 'other' ELSE motive END AS motive), off AS f10 FROM s1),
c13 AS (SELECT * EXCLUDE (hit, gap) REPLACE (CASE WHEN hit THEN gap ELSE minutes END AS minutes), hit AS f11 FROM (SELECT *, coalesce(motive = 'signup' AND dest = home AND minutes - gap > 15 AND gap >= 0.5 * minutes, false) AS hit
  FROM (SELECT *, lead(start) OVER {W} - start AS gap FROM c12)))"""
    + wraps_sql("c13")
    + f", g AS (SELECT *, row_number() OVER {W} AS rn FROM q)"
    + slide_sql("g")
    + f""", c14 AS (SELECT g.* REPLACE (w.moved_start AS start), w.moved_start <> g.start AS f12 FROM g JOIN walk w ON w.person = g.person AND w.day = g.day AND w.rn = g.rn),
codes AS (SELECT event_id, concat_ws(';', CASE WHEN start < lag(start) OVER {W} THEN 'earlier' END, CASE WHEN start = lag(start) OVER {W} THEN 'same_minute' END,
  CASE WHEN start < lag(start + minutes) OVER {W} THEN 'overlap' END, CASE WHEN lag(trip) OVER {W} IS NOT NULL AND lag(dest) OVER {W} IS DISTINCT FROM origin THEN 'discontinuous' END,
  CASE WHEN motive = 'signup' AND dest <> home THEN 'return_elsewhere' END, CASE WHEN lag(trip) OVER {W} IS NULL AND origin <> home THEN 'first_away' END,
  CASE WHEN lead(trip) OVER {W} IS NULL AND dest <> home THEN 'last_away' END) AS issues FROM c14),
done AS (SELECT event_id, origin, dest, motive, start, minutes, f1, f2, f3, f4, f5, f6, f7, f8, f9, f10, f11, f12, issues FROM c14 JOIN codes USING (event_id)
  UNION ALL SELECT event_id, origin, dest, motive, start, minutes, f1, f2, f3, f4, f5, f6, false, false, false, false, false, false, 'no_trip_next_morning' FROM m1 WHERE morning
  UNION ALL SELECT event_id, origin, dest, motive, start, minutes, f1, f2, f3, f4, f5, f6, false, false, false, false, false, false, 'no_trip_at_home' FROM c8 WHERE non_trip)"""
)
FIXES = ("repeated_return", "motive_of_place", "dest_copied", "motive_home", "motive_escort", "motive_usual", "origin_before", "origin_home", "rotated", "short_return", "minutes_home", "arrival")
CODES = "concat_ws(';', " + ", ".join(f"CASE WHEN f{k} THEN '{name}' END" for k, name in enumerate(FIXES, 1)) + ")"


def _cleaned(spark, folder):
    d = diary(spark, folder)
    place = (F.col("home") + F.col("person") % 4 + 1) % 5
    kind = lambda c: (F.col(c) % 2).cast("string")
    d = d.withColumns(
        {
            "origin": F.when(F.col("trip") == 1, place).when(F.col("event_id") % 7 == 0, F.col("home")).otherwise(F.col("origin")),
            "motive": F.when(F.col("event_id") % 11 != 0, F.col("motive")), "age": F.col("person") % 90,
            "answer": F.when(F.col("event_id") % 3 == 0, "home").otherwise("elsewhere"),
        }
    )
    d = d.withColumns({"from_type": kind("origin"), "to_type": kind("dest")})
    return cleaning.clean_chains(d, DAY, "person", RULES)


@query()
def clean_chains(spark, folder):
    return _cleaned(spark, folder).select("event_id", "origin", "dest", "motive", "start", "minutes", "fixes", "issues")


@query()
def chain_counts(spark, folder):
    return cleaning.chain_counts(_cleaned(spark, folder))


ORACLE_SQL["clean_chains"] = CLEAN_SQL + f"SELECT event_id, origin, dest, motive, start, minutes, {CODES} AS fixes, issues FROM done"
ORACLE_SQL["chain_counts"] = (
    CLEAN_SQL
    + f""", told AS (SELECT 'fixes' AS kind, unnest(string_split({CODES}, ';')) AS code FROM done UNION ALL SELECT 'issues', unnest(string_split(issues, ';')) FROM done)
SELECT kind, code, count(*) AS rows FROM told WHERE code <> '' GROUP BY kind, code"""
)
