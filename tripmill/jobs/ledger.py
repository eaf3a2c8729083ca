"""Registered queries on the decision ledger, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.operators import ledger
from tripmill.sources.staging import stage
from tripmill.sources.tables import read

from .queries import query

# Orders as trips of customers. The rules dropped some rows and changed motives; the decisions
# are of every outcome.
TABLES = """lg AS (SELECT l_orderkey AS trip, l_linenumber AS leg, CASE min(l_partkey) % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'BUS' ELSE 'CAR' END AS m FROM lineitem GROUP BY 1, 2),
modes AS (SELECT trip, count(*) AS n, first(m ORDER BY leg) AS mode, list(m) AS modes FROM lg GROUP BY 1),
shipped AS (SELECT o_custkey AS person, o_orderkey AS trip, o_orderstatus AS motive, o_orderkey % 7 AS area, o_orderkey % 7 % 3 AS zone, m.mode, 'a' || o_custkey % 3 AS answer FROM orders JOIN modes m ON m.trip = o_orderkey),
rules AS (SELECT * REPLACE (CASE WHEN trip % 5 = 0 THEN 'R' ELSE motive END AS motive), CASE WHEN trip % 5 = 0 THEN 'motive:rule' ELSE '' END AS fixes FROM shipped WHERE trip % 17 <> 0),
dec AS (SELECT person, trip, 'status' AS field, '' AS before, 'Dropped' AS after FROM shipped WHERE trip % 23 = 0
  UNION ALL SELECT person, -trip, 'status', '', 'dropped' FROM shipped WHERE trip % 101 = 0
  UNION ALL SELECT person, trip, 'status', '', 'restored' FROM shipped WHERE trip % 34 = 0 AND trip % 23 <> 0
  UNION ALL SELECT person, trip, 'status', '', 'restored' FROM shipped WHERE trip % 29 = 0 AND trip % 34 <> 0 AND trip % 23 <> 0
  UNION ALL SELECT person, trip, 'status', '', 'maybe' FROM shipped WHERE trip % 97 = 0 AND trip % 29 <> 0 AND trip % 34 <> 0 AND trip % 23 <> 0
  UNION ALL SELECT person, trip, 'motive', CASE WHEN trip % 3 = 0 THEN 'X' WHEN trip % 34 = 0 THEN motive WHEN trip % 5 = 0 THEN 'R' ELSE motive END, CASE WHEN trip % 11 = 0 THEN 'zz' WHEN trip % 4 = 0 THEN 'f' ELSE ' new ' END FROM shipped WHERE trip % 7 = 0
  UNION ALL SELECT person, -trip, 'motive', 'F', 'new' FROM shipped WHERE trip % 103 = 0
  UNION ALL SELECT person, trip, 'area', CAST(area AS VARCHAR), CAST((area + 1) % 7 AS VARCHAR) FROM shipped WHERE trip % 13 = 0
  UNION ALL SELECT person, trip, 'mode', mode, 'AIR' FROM shipped WHERE trip % 6 = 0
  UNION ALL SELECT person, trip, 'foo', '', 'x' FROM shipped WHERE trip % 89 = 0
  UNION ALL SELECT person, trip, 'note', '', 'see' FROM shipped WHERE trip % 83 = 0
  UNION ALL SELECT person, trip, 'answer', answer, 'b' FROM shipped WHERE trip % 41 = 0
  UNION ALL SELECT DISTINCT person, 0, 'answer', answer, 'b' FROM shipped WHERE person % 5 = 0)"""
OUTCOMES = TABLES + """, st AS (SELECT d.*, lower(trim(after)) AS told, EXISTS (SELECT 1 FROM rules r WHERE r.trip = d.trip) AS now, EXISTS (SELECT 1 FROM shipped s WHERE s.trip = d.trip) AS was FROM dec d),
s1 AS (SELECT *, CASE told WHEN 'dropped' THEN CASE WHEN now THEN 'apply' WHEN was THEN 'holds' ELSE 'stale' END WHEN 'restored' THEN CASE WHEN now THEN 'holds' WHEN was THEN 'apply' ELSE 'stale' END ELSE 'problem' END AS outcome FROM st WHERE field = 'status'),
back AS (SELECT trip FROM s1 WHERE outcome = 'apply' AND told = 'restored'), gone AS (SELECT trip FROM s1 WHERE told = 'dropped'),
held AS (SELECT *, false AS back FROM rules UNION ALL SELECT *, '', true FROM shipped WHERE trip IN (SELECT trip FROM back)),
ppl AS (SELECT person, min_by(answer, trip) AS answer, bool_or(trip NOT IN (SELECT trip FROM gone)) AS keeps FROM held GROUP BY 1),
head AS (SELECT person, min(trip) AS head FROM rules GROUP BY 1),
f0 AS (SELECT d.*, CASE d.field WHEN 'motive' THEN CASE lower(trim(d.after)) WHEN 'f' THEN 'F' WHEN 'o' THEN 'O' WHEN 'p' THEN 'P' WHEN 'r' THEN 'R' WHEN 'new' THEN 'NEW' END ELSE trim(d.after) END AS value, h.trip IS NOT NULL AS there,
    CASE d.field WHEN 'motive' THEN h.motive WHEN 'area' THEN CAST(h.area AS VARCHAR) WHEN 'mode' THEN h.mode END AS cur, CASE WHEN h.back THEN CASE d.field WHEN 'motive' THEN s.motive WHEN 'area' THEN CAST(s.area AS VARCHAR) WHEN 'mode' THEN s.mode END
    ELSE CASE d.field WHEN 'motive' THEN h.motive WHEN 'area' THEN CAST(h.area AS VARCHAR) WHEN 'mode' THEN h.mode END END AS shown, p.answer AS ans, p.keeps, head, m.n, m.modes
  FROM st d LEFT JOIN held h USING (trip) LEFT JOIN shipped s ON s.trip = d.trip LEFT JOIN ppl p ON p.person = d.person LEFT JOIN head ON head.person = d.person LEFT JOIN modes m ON m.trip = d.trip WHERE d.field NOT IN ('status', 'note')),
f1 AS (SELECT *, CASE WHEN field = 'foo' THEN 'problem' WHEN field = 'answer' THEN CASE WHEN trip <> 0 AND trip IS DISTINCT FROM head THEN 'moot' WHEN keeps IS NULL THEN 'stale' WHEN NOT keeps THEN 'moot' WHEN ans = value THEN 'holds'
      WHEN ans IS DISTINCT FROM before THEN 'stale' ELSE 'apply' END
    WHEN trip IN (SELECT trip FROM gone) THEN 'moot' WHEN NOT there THEN 'stale' WHEN value IS NULL THEN 'problem' WHEN cur = value THEN 'holds'
    WHEN field = 'mode' AND n > 1 AND NOT list_contains(modes, value) THEN 'problem' WHEN shown IS DISTINCT FROM before THEN 'stale' ELSE 'apply' END AS outcome FROM f0),
res AS (SELECT person, trip, field, before, after, told AS value, outcome FROM s1 UNION ALL SELECT person, trip, field, before, after, NULL, 'note' FROM dec WHERE field = 'note'
  UNION ALL SELECT person, trip, field, before, after, value, outcome FROM f1)"""


def _tables(spark, folder):
    o, lines = read(spark, folder, "orders"), read(spark, folder, "lineitem")
    part = F.min("l_partkey") % 3
    # written once: decisions, rules and the ledger read shipped and legs many times
    legs = stage(lines.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("leg")).agg(F.when(part == 0, "AIR").when(part == 1, "BUS").otherwise("CAR").alias("mode")))
    modes = legs.groupBy("trip").agg(F.min_by("mode", "leg").alias("mode"))
    key = F.col("o_orderkey")
    shipped = o.select(
        F.col("o_custkey").alias("person"), key.alias("trip"), F.col("o_orderstatus").alias("motive"), (key % 7).alias("area"), (key % 7 % 3).alias("zone"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("answer"), F.lit("").alias("fixes"),
    ).join(modes, "trip")
    shipped = stage(shipped)
    five = F.col("trip") % 5 == 0
    rules = shipped.where("trip % 17 <> 0").withColumns({"motive": F.when(five, "R").otherwise(F.col("motive")), "fixes": F.when(five, "motive:rule").otherwise("")})
    legs = legs.join(shipped.select("trip", "person"), "trip").select("person", "trip", "leg", "mode")
    return shipped, rules, legs


def _decisions(shipped) -> DataFrame:
    """All decisions of a row in one pass, and one of every fifth person."""
    t, m = F.col("trip"), lambda n: F.col("trip") % n == 0

    def row(test, field, before, after, trip=t):
        made = F.struct(trip.alias("trip"), F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))
        return F.when(test, made)

    none, text = F.lit(""), F.lit
    shown = F.when(m(3), "X").when(m(34), F.col("motive")).when(m(5), "R").otherwise(F.col("motive"))
    rows = F.array_compact(F.array(
        row(m(23), "status", none, text("Dropped")), row(m(101), "status", none, text("dropped"), -t), row(m(34) & ~m(23), "status", none, text("restored")),
        row(m(29) & ~m(34) & ~m(23), "status", none, text("restored")), row(m(97) & ~m(29) & ~m(34) & ~m(23), "status", none, text("maybe")),
        row(m(7), "motive", shown, F.when(m(11), "zz").when(m(4), "f").otherwise(" new ")), row(m(103), "motive", text("F"), text("new"), -t),
        row(m(13), "area", F.col("area"), (F.col("area") + 1) % 7), row(m(6), "mode", F.col("mode"), text("AIR")), row(m(89), "foo", none, text("x")),
        row(m(83), "note", none, text("see")), row(m(41), "answer", F.col("answer"), text("b")),
    ))
    persons = shipped.where("person % 5 = 0").select("person", F.lit(0).cast("long").alias("trip"), F.lit("answer").alias("field"), F.col("answer").alias("before"), F.lit("b").alias("after")).distinct()
    return shipped.select("person", F.explode(rows).alias("d")).select("person", "d.*").unionByName(persons)


def _ledger(shipped) -> ledger.Ledger:
    zone_of = shipped.select("area", "zone").distinct()
    return ledger.Ledger({"motive": ["F", "O", "P", "R", "NEW"], "area": None, "mode": None, "answer": None}, "answer", "mode", {"area": ("zone", zone_of)})


def _resolved(spark, folder):
    shipped, rules, legs = _tables(spark, folder)
    return shipped, rules, legs, ledger.resolve(_decisions(shipped), rules, rules, shipped, _ledger(shipped), legs=legs)


@query("WITH " + OUTCOMES + " SELECT person, trip, field, before, after, value, outcome FROM res")
def ledger_outcomes(spark, folder):
    return _resolved(spark, folder)[3]


def _applied(spark, folder):
    shipped, rules, legs, resolved = _resolved(spark, folder)
    fine = resolved.where("outcome <> 'problem'")
    ruled = legs.where("trip % 17 <> 0")
    persons = rules.groupBy("person").agg(F.count("*").alias("trips"))
    return ledger.apply_ledger(rules, ruled, persons, fine, rules, shipped, legs, _ledger(shipped), skip_stale=True)


APPLIED = OUTCOMES + """, go AS (SELECT * FROM res WHERE outcome = 'apply'), g AS (SELECT trip, max(value) FILTER (field = 'motive') AS vm, max(value) FILTER (field = 'area') AS va, max(value) FILTER (field = 'mode') AS vo FROM go WHERE field IN ('motive', 'area', 'mode') GROUP BY 1),
pa AS (SELECT person, max(value) AS va FROM go WHERE field = 'answer' GROUP BY 1), out AS (SELECT trip FROM go WHERE field = 'status' AND value = 'dropped'),
x AS (SELECT h.person, h.trip, coalesce(g.vm, motive) AS motive, coalesce(CAST(g.va AS BIGINT), area) AS area, coalesce(CAST(g.va AS BIGINT) % 3, zone) AS zone, coalesce(g.vo, mode) AS mode, h.answer, back, pa.va FROM held h LEFT JOIN g USING (trip) LEFT JOIN pa USING (person)
  WHERE h.trip NOT IN (SELECT trip FROM out)),
y AS (SELECT * EXCLUDE (answer, va), coalesce(va, first(answer) OVER (PARTITION BY person ORDER BY trip)) AS answer FROM x)"""


@query(
    "WITH " + APPLIED + """ SELECT y.person, y.trip, y.motive, y.area, y.zone, y.mode, y.answer, concat_ws(';', CASE WHEN r.fixes <> '' AND y.motive = r.motive AND y.motive <> s.motive THEN r.fixes END,
  CASE WHEN y.motive IS DISTINCT FROM r.motive AND y.motive <> s.motive THEN 'motive:revision' END, CASE WHEN y.area IS DISTINCT FROM r.area AND y.area <> s.area THEN 'area:revision' END,
  CASE WHEN y.mode IS DISTINCT FROM r.mode AND y.mode <> s.mode THEN 'mode:revision' END, CASE WHEN y.answer IS DISTINCT FROM r.answer AND y.answer <> s.answer THEN 'answer:revision' END,
  CASE WHEN r.trip IS NULL THEN 'row:revision' END) AS fixes FROM y JOIN shipped s ON s.trip = y.trip LEFT JOIN rules r ON r.trip = y.trip"""
)
def ledger_apply(spark, folder):
    return _applied(spark, folder)[0].select("person", "trip", "motive", "area", "zone", "mode", "answer", "fixes")


@query(
    "WITH " + APPLIED + """
SELECT y.person, y.trip, l.leg, CASE WHEN modes.n = 1 AND g.vo IS NOT NULL THEN g.vo ELSE l.m END AS mode FROM lg l JOIN y USING (trip) JOIN modes USING (trip) LEFT JOIN g USING (trip)"""
)
def ledger_legs(spark, folder):
    return _applied(spark, folder)[1]


@query(
    "WITH " + APPLIED + """, c AS (SELECT person, count(*) FILTER (value = 'restored') - count(*) FILTER (value = 'dropped') AS d FROM go WHERE field = 'status' GROUP BY 1)
SELECT r.person, r.n + coalesce(d, 0) AS trips FROM (SELECT person, count(*) AS n FROM rules GROUP BY 1) r LEFT JOIN c USING (person)"""
)
def ledger_counts(spark, folder):
    return _applied(spark, folder)[2]
