"""Registered queries on companions, returns and start times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import chains, companions, joins, returns, timing
from tripmill.sources.tables import read

from .queries import BACK, DAY, DIARY, ORACLE_SQL, diary, query

# -- companions -------------------------------------------------------------------------

# Half of the people have a companion, number -1 - person, who makes their trips a little later.
PARTY = """, party AS (SELECT hh, person, day, trip, origin, dest, motive, start, minutes FROM diary
  UNION ALL SELECT hh, -1 - person, day, trip, origin, dest, motive, start + event_id % 4 * 9 + CASE WHEN event_id % 10 = 0 THEN 720 ELSE 0 END, minutes FROM diary WHERE person % 2 = 0),
near AS (SELECT *, lag(origin) OVER w AS po, lag(dest) OVER w AS pd, lag(motive) OVER w AS pm, lag(start) OVER w AS ps, lag(start + minutes) OVER w AS pe,
  lead(origin) OVER w AS no, lead(dest) OVER w AS nd, lead(motive) OVER w AS nm, lead(start) OVER w AS ns, lead(start + minutes) OVER w AS ne
  FROM party WINDOW w AS (PARTITION BY hh, day, person ORDER BY trip)),
pairs AS (SELECT a.hh, a.day, a.person AS person_a, a.trip AS trip_a, b.person AS person_b, b.trip AS trip_b, a.start AS start_a, b.start AS start_b,
  least(abs(a.start - b.start) % 1440, 1440 - abs(a.start - b.start) % 1440) AS gap,
  coalesce(a.po = b.po AND a.pd = b.pd AND a.pm = b.pm AND a.pm <> 'click' AND least(abs(a.ps - b.ps) % 1440, 1440 - abs(a.ps - b.ps) % 1440) <= 20 AND a.ps <= b.pe AND b.ps <= a.pe, false) AS prv,
  coalesce(a.no = b.no AND a.nd = b.nd AND a.nm = b.nm AND a.nm <> 'click' AND least(abs(a.ns - b.ns) % 1440, 1440 - abs(a.ns - b.ns) % 1440) <= 20 AND a.ns <= b.ne AND b.ns <= a.ne, false) AS nxt
  FROM near a JOIN near b ON a.hh = b.hh AND a.day = b.day AND a.origin = b.origin AND a.dest = b.dest AND a.motive = b.motive AND a.person < b.person),
links AS (SELECT p.*, CASE WHEN prv THEN 'previous' ELSE 'next' END AS via FROM pairs p WHERE (prv OR nxt)
  AND NOT EXISTS (SELECT 1 FROM pairs e WHERE e.gap <= 20 AND e.hh = p.hh AND e.day = p.day AND e.person_a = p.person_a AND e.person_b = p.person_b AND e.trip_a = p.trip_a AND e.trip_b <> p.trip_b)
  AND NOT EXISTS (SELECT 1 FROM pairs e WHERE e.gap <= 20 AND e.hh = p.hh AND e.day = p.day AND e.person_a = p.person_a AND e.person_b = p.person_b AND e.trip_b = p.trip_b AND e.trip_a <> p.trip_a))
"""


def _party(spark, folder):
    d = diary(spark, folder).select("hh", "person", "day", "trip", "origin", "dest", "motive", "start", "minutes", "event_id")
    late = F.col("start") + F.col("event_id") % 4 * 9 + F.when(F.col("event_id") % 10 == 0, 720).otherwise(0)
    shadow = d.where("person % 2 = 0").withColumns({"person": -1 - F.col("person"), "start": late})
    return d.unionByName(shadow).drop("event_id")


@query(PARTY + "SELECT hh, day, person_a, trip_a, person_b, trip_b, via FROM links", diary=True)
def companion_links(spark, folder):
    return companions.companion_links(_party(spark, folder), ["hh", "day"], "person", ["click"])


@query(
    PARTY + """SELECT hh, day, person_a, trip_a, person_b, trip_b, start_a, start_b,
  CASE WHEN gap <= 20 THEN 'same_entry' WHEN 720 - gap <= 20 THEN 'half_day' ELSE 'apart' END AS status FROM links""",
    diary=True,
)
def companion_checks(spark, folder):
    party = _party(spark, folder)
    links = companions.companion_links(party, ["hh", "day"], "person", ["click"]).drop("via")
    return companions.companion_checks(links, party, ["hh", "day"])


@query(
    """, c AS (SELECT day, hh, person, list(motive ORDER BY trip) AS sig, list(start ORDER BY trip) AS s FROM diary GROUP BY day, hh, person HAVING count(*) >= 2),
p AS (SELECT a.day, a.person, b.person AS twin, list_max(list_transform(list_zip(a.s, b.s), lambda x: abs(x[1] - x[2]))) AS max_offset
  FROM c a JOIN c b ON a.day = b.day AND a.sig = b.sig AND a.hh <> b.hh),
r AS (SELECT *, person % 3 = twin % 3 AS same, row_number() OVER (PARTITION BY day, person ORDER BY max_offset, person % 3 <> twin % 3, twin) AS n FROM p WHERE max_offset <= 240)
SELECT day, person, twin, max_offset, same, CASE WHEN max_offset <= 10 THEN 'minutes' WHEN max_offset <= 60 THEN 'hour' ELSE 'hours' END AS offset_class FROM r WHERE n = 1""",
    diary=True,
)
def closest_twin(spark, folder):
    d = diary(spark, folder)
    found = joins.diaries_of(d, ["day"], "hh", "person", "trip", "start", ["motive"])
    persons = found.select(F.col("p").alias("person")).distinct().withColumn("kind", F.col("person") % 3)
    return companions.closest_twin(found, persons, ["day"], "person", ["kind"], 240, [(10, "minutes"), (60, "hour")], "hours")


# -- returns ----------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN motive = 'view' AND person % 90 >= 12 THEN 'click' ELSE motive END AS motive FROM diary", diary=True)
def age_recode(spark, folder):
    return returns.age_recode(diary(spark, folder).withColumn("age", F.col("person") % 90), "view", "click").select("event_id", "motive")


NIGHT = """, away AS (SELECT * REPLACE (CASE WHEN trip = 1 THEN (home + person % 4 + 1) % 5 ELSE origin END AS origin) FROM diary)"""


def _away(spark, folder):
    place = (F.col("home") + F.col("person") % 4 + 1) % 5
    return diary(spark, folder).withColumn("origin", F.when(F.col("trip") == 1, place).otherwise(F.col("origin")))


@query(
    NIGHT + """SELECT event_id, coalesce(lead(trip) OVER w IS NULL AND motive = 'signup' AND lag(motive) OVER w IN ('purchase', 'view', 'click') AND lag(start) OVER w >= 600
  AND lag(dest) OVER w = origin AND first(motive) OVER a = 'signup' AND first(origin) OVER a = origin, false) AS next_morning
FROM away WINDOW w AS (PARTITION BY person, day ORDER BY trip), a AS (PARTITION BY person, day ORDER BY trip ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    diary=True,
)
def next_morning_returns(spark, folder):
    return returns.next_morning_returns(_away(spark, folder), DAY, BACK, ["purchase", "view", "click"], 600).select("event_id", "next_morning")


@query(
    """, t AS (SELECT *, motive = 'signup' AND dest <> home AS off, lead(trip) OVER (PARTITION BY person, day ORDER BY trip) IS NULL
  AND NOT EXISTS (SELECT 1 FROM diary o WHERE o.person = d.person AND o.day = d.day AND o.trip <> d.trip AND (o.origin = d.dest OR o.dest = d.dest)) AS alone FROM diary d)
SELECT event_id, CASE WHEN off AND alone THEN home ELSE dest END AS dest, CASE WHEN off AND NOT alone THEN 'other' ELSE motive END AS motive FROM t""",
    diary=True,
)
def short_returns(spark, folder):
    return returns.short_returns(diary(spark, folder), DAY, BACK, "other").select("event_id", "dest", "motive")


@query(
    NIGHT + """, f AS (SELECT *, CASE WHEN trip = 1 AND motive <> 'signup' AND origin <> home THEN CASE WHEN origin = dest THEN 'copied_origin'
  WHEN event_id % 3 = 0 THEN 'answer' WHEN origin % 2 = dest % 2 AND origin % 2 <> 0 THEN 'copied_type' END END AS rule FROM away)
SELECT event_id, rule, CASE WHEN rule IS NOT NULL THEN home ELSE origin END AS origin FROM f""",
    diary=True,
)
def first_origins_home(spark, folder):
    answer = F.when(F.col("event_id") % 3 == 0, "home").otherwise("elsewhere")
    kind = lambda c: (F.col(c) % 2).cast("string")
    d = _away(spark, folder).withColumns({"answer": answer, "from_type": kind("origin"), "to_type": kind("dest")})
    return returns.first_origins_home(d, DAY, BACK, "answer", "home", "from_type", "to_type", ["0"]).select("event_id", "rule", "origin")


@query(
    NIGHT + """, d AS (SELECT *, person % 6 AS job, CASE WHEN event_id % 10 < 7 THEN 'a' || dest ELSE motive END AS kind, trip = 1 AND motive = 'signup' AND origin <> home AS target FROM away),
own AS (SELECT person, dest, kind, row_number() OVER (PARTITION BY person, dest ORDER BY count(*) DESC, kind) AS n FROM d WHERE NOT target GROUP BY person, dest, kind),
fam AS (SELECT hh, dest, kind, row_number() OVER (PARTITION BY hh, dest ORDER BY count(*) DESC, kind) AS n FROM d WHERE NOT target GROUP BY hh, dest, kind),
oc AS (SELECT job, dest, kind, count(*) AS c FROM d WHERE NOT target GROUP BY job, dest, kind),
occ AS (SELECT *, row_number() OVER (PARTITION BY job, dest ORDER BY c DESC, kind) AS n, sum(c) OVER (PARTITION BY job, dest) AS t FROM oc)
SELECT event_id, CASE WHEN target THEN coalesce(own.kind, fam.kind, occ.kind, 'other') END AS start_type FROM d
LEFT JOIN own ON own.n = 1 AND own.person = d.person AND own.dest = d.origin LEFT JOIN fam ON fam.n = 1 AND fam.hh = d.hh AND fam.dest = d.origin
LEFT JOIN occ ON occ.n = 1 AND occ.t >= 5 AND occ.c >= 0.6 * occ.t AND occ.job = d.job AND occ.dest = d.origin""",
    diary=True,
)
def first_return_answers(spark, folder):
    kind = F.when(F.col("event_id") % 10 < 7, F.concat(F.lit("a"), F.col("dest").cast("string"))).otherwise(F.col("motive"))
    d = _away(spark, folder).withColumns({"job": F.col("person") % 6, "kind": kind})
    target = (F.col("trip") == 1) & (F.col("motive") == BACK) & (F.col("origin") != F.col("home"))
    return returns.first_return_answers(d, "person", "hh", "job", target, "kind", "other").select("event_id", "start_type")


# -- start times ------------------------------------------------------------------------

KNN = """, f AS (SELECT *, lead(start) OVER w AS next_start, lag(start + minutes) OVER w AS prev_arrival, greatest(lead(start) OVER w - start - minutes, 0) AS stay
  FROM diary WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
t AS (SELECT * FROM f WHERE event_id % 29 = 0), o AS (SELECT * FROM f WHERE event_id % 29 <> 0 AND next_start - start - minutes >= 0 AND (prev_arrival IS NULL OR start >= prev_arrival - 15)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, donor) AS n FROM (SELECT t.event_id, o.event_id AS donor,
  round(2 * (t.dest <> o.dest)::INT + (t.home <> o.home)::INT + 0.01 * abs(t.minutes - o.minutes) + 0.25 * abs(t.trip - o.trip), 9)::DOUBLE AS distance FROM t, o)) WHERE n <= 30)
"""


def _near(spark, folder):
    f = chains.donor_mask(chains.trip_features(diary(spark, folder), DAY, ["purchase"]))
    f = f.withColumn("stay", F.greatest(F.col("next_start") - F.col("start") - F.col("minutes"), F.lit(0)))
    donors = f.where("donor AND event_id % 29 <> 0").withColumnRenamed("event_id", "donor_id")
    near = timing.nearest_donors(f.where("event_id % 29 = 0"), donors, "event_id", "donor_id", {"dest": 2.0, "home": 1.0}, {"minutes": 0.01, "trip": 0.25})
    return near, donors


@query(KNN + "SELECT event_id, donor AS donor_id, distance FROM near", diary=True)
def nearest_donors(spark, folder):
    return _near(spark, folder)[0]


@query(
    KNN + """, v AS (SELECT near.event_id, o.motive, count(*) AS n, round(sum(distance), 6) AS far, median(o.start) AS start, median(o.stay) AS stay FROM near JOIN o ON donor = o.event_id GROUP BY ALL)
SELECT event_id, motive, start, stay, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, far, motive) AS k FROM v) WHERE k = 1""",
    diary=True,
)
def knn_impute(spark, folder):
    near, donors = _near(spark, folder)
    return timing.knn_impute(near, donors, "event_id", "donor_id", "motive", "start", "stay")


@query()
def place_untimed(spark, folder):
    d = diary(spark, folder).withColumn("start", F.when(F.col("event_id") % 3 != 0, F.col("start"))).withColumn("duration", F.col("event_id") % 50)
    return timing.place_untimed(d, DAY)


ORACLE_SQL["place_untimed"] = (
    "WITH RECURSIVE "
    + DIARY
    + """, e AS (SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN start END AS start) FROM diary),
p AS (SELECT *, lag(start + minutes) OVER w AS arrival, row_number() OVER (PARTITION BY person, day ORDER BY trip DESC) AS k FROM e WINDOW w AS (PARTITION BY person, day ORDER BY trip)),
walk AS (SELECT person, day, trip, k, start, start AS placed FROM p WHERE k = 1
  UNION ALL SELECT p.person, p.day, p.trip, p.k, p.start, CASE WHEN p.start IS NOT NULL THEN p.start WHEN walk.placed IS NOT NULL
    THEN least(greatest(walk.placed - p.minutes - p.event_id % 50, coalesce(p.arrival, -100000)), walk.placed - p.minutes) END
  FROM walk JOIN p ON p.person = walk.person AND p.day = walk.day AND p.k = walk.k + 1)
SELECT person, day, trip, start, placed FROM walk"""
)


@query()
def repair_start_hours(spark, folder):
    back = F.when((F.col("event_id") % 13 == 0) & (F.col("start") >= 720), F.col("start") - 720).otherwise(F.col("start"))
    out = timing.repair_start_hours(diary(spark, folder).withColumn("start", back), DAY, ["purchase"], back=BACK, work=["purchase"], errands=["view"])
    return out.select("person", "day", "trip", "start", "repaired")


@query()
def isotonic_starts(spark, folder):
    return timing.isotonic_starts(diary(spark, folder), DAY, away=F.col("dest") != F.col("home")).select("person", "day", "trip", "start", "moved_start")
