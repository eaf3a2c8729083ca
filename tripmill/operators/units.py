"""Census units in zones: what the survey coded for them comes before where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.sources.staging import stage

from .zones import _inside, _segment_distance, dominant_zone, nearest_polygon

COLUMNS = ("unit", "kind", "area", "population", "polygon_zone", "survey_zone", "trip_zone", "zone", "rule")


def _coded(codes: DataFrame, dwellings: str) -> DataFrame:
    """(code, survey_zone, sampled, trip_zone): the zone coded for a code's dwellings and
    their number, and the zone of most of its trip ends."""
    home = codes.where(F.col("source") == dwellings)
    ends = codes.where(F.col("source") != dwellings)
    own = home.groupBy("code").agg(F.max_by("zone", F.struct("n", -F.col("zone"))).alias("survey_zone"), F.sum("n").alias("sampled"))
    trips = dominant_zone(ends).select("code", F.col("zone").alias("trip_zone"))
    return own.join(trips, "code", "full")


def urban_units(units: DataFrame, inside: DataFrame, codes: DataFrame, points: DataFrame, polygons: DataFrame, dwellings: str = "dwellings") -> DataFrame:
    """COLUMNS of the urban units (unit, population).

    inside: (unit, zone, weight), population or area of a unit by polygon, zone null for
    what lies outside. codes: (code, source, zone, n), code being the unit. points: (unit,
    x, y). In order: the zone coded for the unit's dwellings, for its trip ends, the
    polygon that holds most of it, the one that holds the most of what is inside any, the
    nearest. The rule says which, and whether the survey overrides the polygon.
    """
    share = inside.groupBy("unit", "zone").agg(F.sum("weight").alias("w")).where("w > 0")
    first = F.struct("w", F.col("zone").isNull(), -F.coalesce("zone", F.lit(0)))  # outside wins a tie, then the smallest zone
    placed = share.groupBy("unit").agg(
        F.max_by("zone", first).alias("polygon_zone"), F.count("*").alias("_pieces"),
        F.max(F.when(F.col("zone").isNotNull(), F.struct("w", (-F.col("zone")).alias("z")))).alias("_in"),
    )
    out = units.join(placed, "unit", "left").join(_coded(codes, dwellings).withColumnRenamed("code", "unit"), "unit", "left")
    out = out.withColumn("_zone", F.coalesce("survey_zone", "trip_zone", "polygon_zone", -F.col("_in.z")))
    lost = stage(points.join(out.where("_zone IS NULL").select("unit"), "unit", "left_semi"))
    near = nearest_polygon(lost, polygons, "unit").select("unit", F.col("zone").alias("_near"))
    out = out.join(near, "unit", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col("polygon_zone"))
    rule = (
        F.when(F.col("survey_zone").isNotNull(), F.when(differs("survey_zone"), "survey over polygon").otherwise("survey"))
        .when(F.col("trip_zone").isNotNull(), F.when(differs("trip_zone"), "trip ends over polygon").otherwise("trip ends"))
        .when(F.col("polygon_zone").isNotNull(), F.when(F.col("_pieces") > 1, "majority").otherwise("polygon"))
        .when(F.coalesce("_zone", "_near").isNotNull(), "nearest polygon").otherwise("outside")
    )
    out = out.withColumns({"kind": F.lit("urban"), "area": F.lit(None).cast("string"), "zone": F.coalesce("_zone", "_near"), "rule": rule})
    return out.select(*COLUMNS)


def rural_units(localities: DataFrame, codes: DataFrame, polygons: DataFrame, dwellings: str = "dwellings") -> DataFrame:
    """COLUMNS of the rural localities (unit, area, population, dwellings, polygon_zone, x, y)
    and of coded areas without any.

    codes: (code, source, zone, n), code being the area; its zone is a function of the
    code. A recorded area takes its coded zone with its localities inside any polygon; if
    none is, with the one nearest to that zone's polygon; and while these hold fewer
    dwellings than the survey sampled there, with the nearest of the others (ties to the
    larger population, then the smaller unit). Its other localities are outside. A locality
    of no recorded area goes with the polygon that contains it.
    """
    coded = codes.groupBy("code").agg(
        F.min("zone").alias("_coded"), F.sum(F.when(F.col("source") == dwellings, F.col("n"))).alias("_need")
    ).withColumnRenamed("code", "area")
    d = localities.join(coded, "area", "left").join(polygons.select(F.col("zone").alias("_coded"), "ring"), "_coded", "left")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    far: Column = F.when(_inside(x, y, F.col("ring")), 0.0).otherwise(F.round(_segment_distance(x, y, F.col("ring")), 9))
    d = d.withColumns({"_far": F.when(F.col("ring").isNotNull(), far), "_recorded": F.col("_coded").isNotNull()}).drop("ring")
    area = Window.partitionBy("area")
    order = [F.col("_far").asc_nulls_last(), F.desc(F.coalesce("population", F.lit(0))), F.col("unit")]
    lies_in = F.col("polygon_zone").isNotNull() & F.col("_recorded")
    d = d.withColumns({"_any": F.max(lies_in).over(area), "_nth": F.row_number().over(area.orderBy(*order))})
    d = d.withColumn("_in", F.col("_recorded") & (lies_in | (~F.col("_any") & (F.col("_nth") == 1))))
    homes = F.coalesce(F.col("dwellings").cast("double"), F.lit(0.0))
    held = F.sum(F.when(F.col("_in"), homes).otherwise(0.0)).over(area)
    # the running sum over the rest in order, seeded with what is in already
    rest = Window.partitionBy("area", "_in").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = held + F.coalesce(F.sum(homes).over(rest), F.lit(0.0))
    joins = F.col("_recorded") & ~F.col("_in") & F.coalesce(before < F.col("_need"), F.lit(False))
    d = d.withColumn("_joins", joins).withColumn("_in", F.col("_in") | F.col("_joins"))
    named = F.when(F.col("_need").isNotNull(), "survey").otherwise("trip ends")
    zone = F.when(F.col("_in"), F.col("_coded")).when(~F.col("_recorded"), F.col("polygon_zone"))
    rule = F.when(F.col("_in"), named).when(~F.col("_recorded") & F.col("polygon_zone").isNotNull(), "polygon").otherwise("outside")
    nothing = {c: F.lit(None).cast(d.schema["polygon_zone"].dataType) for c in ("survey_zone", "trip_zone")}
    some = d.withColumns({"kind": F.lit("locality"), "zone": zone, "rule": rule, **nothing}).select(*COLUMNS)
    bare = coded.join(localities.where(F.col("area").isNotNull()).select("area").distinct(), "area", "left_anti").select(
        F.col("area").cast(localities.schema["unit"].dataType).alias("unit"), F.lit("rural area").alias("kind"), "area",
        F.lit(0).cast(localities.schema["population"].dataType).alias("population"),
        *[F.lit(None).cast(d.schema["polygon_zone"].dataType).alias(c) for c in ("polygon_zone", "survey_zone", "trip_zone")],
        F.col("_coded").alias("zone"), named.alias("rule"),
    )
    return some.unionByName(bare)
