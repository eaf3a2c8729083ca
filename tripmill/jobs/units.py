"""Registered queries on census units and constraint expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.operators import targets, units
from tripmill.operators.targets import Constraint
from tripmill.sources.tables import read

from .queries import query


def _squares(spark, folder):
    """Zones 0 to 3: unit squares around (2, 2), (8, 2), (2, 8) and (8, 8)."""
    n = F.col("n_nationkey")
    at = lambda i, j: F.struct((n % 2 * 6 + 2 + i).cast("double").alias("x"), (F.floor(n / 2) * 6 + 2 + j).cast("double").alias("y"))
    return read(spark, folder, "nation").where("n_nationkey < 4").select(n.cast("long").alias("zone"), F.array(at(-1, -1), at(-1, 1), at(1, 1), at(1, -1)).alias("ring"))


SQUARES = "sq AS (SELECT k AS zone, k % 2 * 6 + 2.0 AS cx, k // 2 * 6 + 2.0 AS cy FROM range(4) v(k))"
FAR = "sqrt(greatest(abs(x - cx) - 1, 0) ** 2 + greatest(abs(y - cy) - 1, 0) ** 2)"


@query(
    f"""WITH {SQUARES}, u AS (SELECT c_custkey AS unit, c_custkey % 90 AS population, c_custkey * 37 % 101 / 10.0 AS x, c_custkey * 71 % 103 / 10.0 AS y FROM customer),
i AS (SELECT o_custkey AS unit, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 END AS zone, sum(1 + o_orderkey % 3) AS w FROM orders GROUP BY 1, 2),
p AS (SELECT unit, zone AS polygon_zone FROM i QUALIFY row_number() OVER (PARTITION BY unit ORDER BY w DESC, zone IS NULL DESC, zone) = 1),
k AS (SELECT unit, count(*) AS pieces FROM i GROUP BY 1),
b AS (SELECT unit, zone AS best FROM i WHERE zone IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY w DESC, zone) = 1),
c AS (SELECT u.*, p.polygon_zone, pieces, best, CASE WHEN unit % 4 = 0 THEN unit % 3 END AS survey_zone, CASE WHEN unit % 5 < 2 THEN unit % 4 END AS trip_zone
  FROM u LEFT JOIN p USING (unit) LEFT JOIN k USING (unit) LEFT JOIN b USING (unit)),
z AS (SELECT *, coalesce(survey_zone, trip_zone, polygon_zone, best) AS z FROM c),
n AS (SELECT unit, sq.zone AS near FROM z, sq WHERE z IS NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round({FAR}, 9), sq.zone) = 1)
SELECT unit, population, polygon_zone, survey_zone, trip_zone, coalesce(z, near) AS zone, CASE
    WHEN survey_zone IS NOT NULL THEN CASE WHEN survey_zone IS DISTINCT FROM polygon_zone THEN 'survey over polygon' ELSE 'survey' END
    WHEN trip_zone IS NOT NULL THEN CASE WHEN trip_zone IS DISTINCT FROM polygon_zone THEN 'trip ends over polygon' ELSE 'trip ends' END
    WHEN polygon_zone IS NOT NULL THEN CASE WHEN pieces > 1 THEN 'majority' ELSE 'polygon' END ELSE 'nearest polygon' END AS rule
FROM z LEFT JOIN n USING (unit)"""
)
def assign_urban_units(spark, folder):
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 90).alias("population"))
    unit = F.col("unit")
    points = c.select("unit", (unit * 37 % 101 / 10.0).alias("x"), (unit * 71 % 103 / 10.0).alias("y"))
    o = read(spark, folder, "orders")
    inside = o.select(F.col("o_custkey").alias("unit"), F.when(F.col("o_orderkey") % 5 < 4, F.col("o_orderkey") % 5).alias("zone"), (1 + F.col("o_orderkey") % 3).alias("weight"))
    told = lambda test, source, zone: c.where(test).select(unit.alias("code"), F.lit(source).alias("source"), zone.alias("zone"), F.lit(3).alias("n"))
    codes = told(unit % 4 == 0, "dwellings", unit % 3).unionByName(told(unit % 5 < 2, "destinations", unit % 4))
    found = units.urban_units(c, inside, codes, points, _squares(spark, folder))
    return found.select("unit", "population", "polygon_zone", "survey_zone", "trip_zone", "zone", "rule")


@query(
    f"""WITH {SQUARES}, l AS (SELECT CAST(p_partkey AS VARCHAR) AS unit, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS VARCHAR) END AS area, p_partkey % 70 AS population,
    p_partkey % 9 AS dwellings, CASE WHEN p_partkey % 6 < 2 THEN p_partkey % 4 END AS polygon_zone, p_partkey * 37 % 101 / 10.0 AS x, p_partkey * 71 % 103 / 10.0 AS y FROM part),
codes AS (SELECT CAST(k AS VARCHAR) AS area, k % 4 AS coded, CASE WHEN k % 3 = 0 THEN 10 + k END AS need FROM (SELECT DISTINCT p_size AS k FROM part UNION SELECT 100 + n_nationkey FROM nation) WHERE k % 3 < 2),
d AS (SELECT l.*, coded, need, round({FAR}, 9) AS far FROM l LEFT JOIN codes USING (area) LEFT JOIN sq ON sq.zone = coded),
a AS (SELECT *, max(polygon_zone IS NOT NULL AND coded IS NOT NULL) OVER (PARTITION BY area) AS anyin, row_number() OVER (PARTITION BY area ORDER BY far NULLS LAST, population DESC, unit) AS nth FROM d),
f AS (SELECT *, coded IS NOT NULL AND (polygon_zone IS NOT NULL OR (NOT anyin AND nth = 1)) AS framed FROM a),
h AS (SELECT *, coalesce(sum(dwellings) FILTER (framed) OVER (PARTITION BY area), 0)
    + sum(dwellings) FILTER (NOT framed) OVER (PARTITION BY area ORDER BY far NULLS LAST, population DESC, unit) - dwellings AS before FROM f),
g AS (SELECT *, framed OR (coded IS NOT NULL AND coalesce(before < need, false)) AS inside FROM h)
SELECT unit, 'locality' AS kind, area, population, CASE WHEN inside THEN coded WHEN coded IS NULL THEN polygon_zone END AS zone,
  CASE WHEN inside THEN CASE WHEN need IS NOT NULL THEN 'survey' ELSE 'trip ends' END WHEN coded IS NULL AND polygon_zone IS NOT NULL THEN 'polygon' ELSE 'outside' END AS rule FROM g
UNION ALL SELECT area, 'rural area', area, 0, coded, CASE WHEN need IS NOT NULL THEN 'survey' ELSE 'trip ends' END FROM codes WHERE area NOT IN (SELECT area FROM l WHERE area IS NOT NULL)"""
)
def assign_rural_units(spark, folder):
    p, key = read(spark, folder, "part"), F.col("p_partkey")
    places = p.select(
        key.cast("string").alias("unit"), F.when(key % 11 != 0, F.col("p_size").cast("string")).alias("area"), (key % 70).alias("population"),
        (key % 9).alias("dwellings"), F.when(key % 6 < 2, key % 4).alias("polygon_zone"), (key * 37 % 101 / 10.0).alias("x"), (key * 71 % 103 / 10.0).alias("y"),
    )
    k = F.col("k")
    known = p.select(F.col("p_size").cast("long").alias("k")).union(read(spark, folder, "nation").select((100 + F.col("n_nationkey")).cast("long"))).distinct()
    told = known.where(k % 3 < 2).select(
        k.cast("string").alias("code"), F.when(k % 3 == 0, "dwellings").otherwise("origins").alias("source"), (k % 4).alias("zone"), (10 + k).alias("n")
    )
    return units.rural_units(places, told, _squares(spark, folder)).select("unit", "kind", "area", "population", "zone", "rule")


@query(
    """WITH u AS (SELECT o_custkey % 9 AS zone, o_custkey % 3 AS town, CASE WHEN o_custkey % 9 <> 4 THEN 1 + o_orderkey % 3 END AS persons,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderstatus = 'O')::INT END AS workers, o_totalprice::DOUBLE / 1000 AS income FROM orders),
z AS (SELECT zone, sum(persons) AS persons, sum(workers) AS workers, sum(income) AS income FROM u GROUP BY 1),
t AS (SELECT town, sum(persons) AS persons, count(*) FILTER (income > 50) / count(*)::DOUBLE AS share, 1 + town / 10.0 AS growth FROM u GROUP BY 1)
SELECT 'zone' AS geography, CAST(zone AS VARCHAR) AS id, k AS "constraint", round(CASE k WHEN 'persons' THEN persons WHEN 'rest' THEN persons - workers ELSE 2 * workers + income / 10 END, 6)::DOUBLE AS target
FROM z, (VALUES ('persons'), ('rest'), ('mixed')) v(k)
UNION ALL SELECT 'town', CAST(town AS VARCHAR), k, round(CASE k WHEN 'all' THEN persons ELSE (1000 + 500 * town) * share * growth END, 6)::DOUBLE FROM t, (VALUES ('all'), ('fleet')) v(k)"""
)
def constraint_set(spark, folder):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    u = read(spark, folder, "orders").select(
        (customer % 9).alias("zone"), (customer % 3).alias("town"), F.when(customer % 9 != 4, 1 + key % 3).alias("persons"),
        F.when(key % 7 != 0, (F.col("o_orderstatus") == "O").cast("int")).alias("workers"), (F.col("o_totalprice").cast("double") / 1000).alias("income"),
    )
    spec = [
        Constraint("persons", "zone", "persons", ["persons"]), Constraint("rest", "zone", "persons - workers", ["persons", "workers"]),
        Constraint("mixed", "zone", "2 * workers + income / 10", ["workers", "income"]), Constraint("all", "town", "persons", ["persons"]),
        Constraint("fleet", "town", constant={0: 1000, 1: 1500, 2: 2000}, share="rich", growth="up"),
    ]
    shares = u.groupBy("town").agg((F.count_if(F.col("income") > 50) / F.count("*")).alias("rich"))
    up = u.select("town", (1 + F.col("town") / 10.0).alias("up")).distinct()
    return targets.constraint_set(u, spec, {"town": shares}, {"town": up}).withColumn("target", F.round("target", 6))
