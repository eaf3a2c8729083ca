"""Zones and their targets: codes of survey ends, polygons, growth, coverage, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survey_codes(ends: dict[str, DataFrame], excluded: Sequence[str] = ()) -> DataFrame:
    """(code, source, zone, n) over ends of (code, zone), one frame per source; codes that
    begin with an excluded prefix are left out."""
    rows = None
    for source, df in ends.items():
        part = df.select(F.col("code").cast("string").alias("code"), F.lit(source).alias("source"), "zone")
        rows = part if rows is None else rows.unionByName(part)
    for prefix in excluded:
        rows = rows.where(~F.col("code").startswith(prefix))
    return rows.groupBy("code", "source", "zone").agg(F.count("*").alias("n"))


def dominant_zone(codes: DataFrame) -> DataFrame:
    """(code, zone, n, n_zones): the zone of most ends of a code, ties to the smallest."""
    total = codes.groupBy("code", "zone").agg(F.sum("n").alias("n"))
    best = F.max_by(F.struct("zone", "n"), F.struct("n", -F.col("zone")))
    return total.groupBy("code").agg(best.alias("b"), F.count("*").alias("n_zones")).select("code", "b.zone", "b.n", "n_zones")


def majority_zone(blocks: DataFrame, unit: str, zone: str, population: str) -> DataFrame:
    """(unit, zone, share, straddles): the zone with most of a unit's population."""
    per = blocks.groupBy(unit, zone).agg(F.sum(population).alias("p"))
    best = F.max_by(F.struct(zone, "p"), F.struct("p", -F.col(zone)))
    out = per.groupBy(unit).agg(best.alias("b"), F.sum("p").alias("t"), F.count("*").alias("k"))
    return out.select(unit, F.col(f"b.{zone}").alias(zone), (F.col("b.p") / F.col("t")).alias("share"), (F.col("k") > 1).alias("straddles"))


def _inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: edges of the ring that a ray from (x, y) to the right crosses."""

    def crosses(i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % F.size(ring)]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
        return F.coalesce(spans & (x < at), F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crosses)) % 2 == 1


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float = 1.0) -> DataFrame:
    """points inner-joined with the polygons (zone, ring of (x, y)) that contain them.

    Polygons are listed under the grid cells of their bounds, so the join is on equal
    cells and Spark chooses to broadcast or shuffle the polygons by their size.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    across = lambda f, axis: at(f(F.transform("ring", lambda p: p[axis])))
    cells = (
        polygons.withColumn("cx", F.explode(F.sequence(across(F.array_min, "x"), across(F.array_max, "x"))))
        .withColumn("cy", F.explode(F.sequence(across(F.array_min, "y"), across(F.array_max, "y"))))
    )
    placed = points.withColumn("cx", at(F.col(x))).withColumn("cy", at(F.col(y)))
    return placed.join(cells, ["cx", "cy"]).where(_inside(F.col(x), F.col(y), F.col("ring"))).drop("cx", "cy", "ring")


def growth_ratio(df: DataFrame, keys: Sequence[str], year: str, value: str, base: int, target: int) -> DataFrame:
    """(keys, base_total, target_total, ratio); the ratio is null without a base."""
    total = lambda y: F.sum(F.when(F.col(year) == y, F.col(value)))
    out = df.where(F.col(year).isin(base, target)).groupBy(*keys).agg(total(base).alias("base_total"), total(target).alias("target_total"))
    return out.withColumn("ratio", F.col("target_total") / F.when(F.col("base_total") > 0, F.col("base_total")))


def zone_targets(df: DataFrame, geography: str, columns: Sequence[str]) -> DataFrame:
    """Sums by geography; null only where every cell is suppressed."""
    return df.groupBy(geography).agg(*[F.sum(c).alias(c) for c in columns])


def coverage(df: DataFrame, group: str, covered: Column, value: str) -> DataFrame:
    """(group, coverage): covered sum over whole sum."""
    return df.groupBy(group).agg((F.sum(F.when(covered, F.col(value)).otherwise(0)) / F.nullif(F.sum(value), F.lit(0))).alias("coverage"))


def target_diagnostic(records: DataFrame, geography: str, weight: str, constraints: dict[str, Sequence[str]], targets: DataFrame) -> DataFrame:
    """(geography, constraint, target, estimate, supporting, ratio): the weighted product
    of each constraint's attributes against targets (geography, constraint, target); a
    target without records gets zeros."""
    products = []
    for name, attributes in constraints.items():
        product = F.lit(1.0)
        for a in attributes:
            product = product * F.col(a)
        products.append(F.struct(F.lit(name).alias("constraint"), product.alias("v")))
    made = records.select(geography, weight, F.inline(F.array(*products)))
    sums = made.groupBy(geography, "constraint").agg(
        F.sum(F.col(weight) * F.col("v")).alias("estimate"), F.count(F.when(F.col("v") > 0, 1)).alias("supporting")
    )
    out = targets.join(sums, [geography, "constraint"], "left").fillna(0, ["estimate", "supporting"])
    return out.withColumn("ratio", F.col("estimate") / F.nullif("target", F.lit(0.0)))


def trip_end_agreement(ends: DataFrame, code_zone: DataFrame, access: DataFrame) -> DataFrame:
    """(status, n): ends (code, zone) in the zone of their code, in another, at an access
    point, or of a code that has no zone."""
    known = code_zone.select("code", F.col("zone").alias("expected"))
    marked = access.select("code", F.lit(True).alias("is_access")).distinct()
    status = (
        F.when(F.col("is_access"), "access").when(F.col("expected").isNull(), "unknown")
        .when(F.col("expected") == F.col("zone"), "in_zone").otherwise("other_zone")
    )
    return ends.join(known, "code", "left").join(marked, "code", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def duplicate_rosters(members: DataFrame, area: str, hh: str, fields: Sequence[str]) -> DataFrame:
    """(area, roster, households, first_hh): rosters that several households of an area
    share; a roster is the digest of the sorted members."""
    member = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    roster = members.groupBy(area, hh).agg(F.md5(F.array_join(F.sort_array(F.collect_list(member)), ";")).alias("roster"))
    return roster.groupBy(area, "roster").agg(F.count("*").alias("households"), F.min(hh).alias("first_hh")).where("households > 1")


def persons_with_leg(persons: DataFrame, legs: DataFrame, keys: Sequence[str], condition: str) -> DataFrame:
    """Persons with a leg for which the condition holds."""
    return persons.join(legs.where(condition).select(*keys), list(keys), "left_semi")


def member_count(reported: DataFrame, members: DataFrame, hh: str, draws: int, value: str, count: str, condition: str) -> DataFrame:
    """(hh, draw, members): the reported count plus unanswered members (hh, draw, value)
    drawn as counted, for each household and draw."""
    every = reported.select(hh, count, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    drawn = members.where(condition).groupBy(hh, "draw").agg(F.sum(value).alias("_n"))
    return every.join(drawn, [hh, "draw"], "left").select(hh, "draw", (F.col(count) + F.coalesce("_n", F.lit(0))).alias("members"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _segment_distance(x: Column, y: Column, ring: Column) -> Column:
    """Least distance of (x, y) to the edges of a ring."""

    def one(i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % F.size(ring)]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        k = ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        k = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(k, F.lit(0.0))))
        return F.hypot(x - a["x"] - k * dx, y - a["y"] - k * dy)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), one))


def nearest_polygon(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", reach: float = 0.5) -> DataFrame:
    """(key, zone, distance): the polygon nearest to each point (0 inside), ties to the
    smallest zone; points without coordinates are left out.

    Polygons are listed under the grid cells within `reach` of their bounds and joined on
    equal cells. What is found within reach is final; the rest goes on with four times the
    reach, until it spans all points and polygons: a few passes, whatever the number.
    """
    edge = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    boxes = polygons.withColumns({"_x0": edge(F.array_min, "x"), "_x1": edge(F.array_max, "x"), "_y0": edge(F.array_min, "y"), "_y1": edge(F.array_max, "y")})
    left = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    a = boxes.agg(F.min("_x0"), F.max("_x1"), F.min("_y0"), F.max("_y1")).first()
    b = left.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    empty = a[0] is None or b[0] is None
    span = 0.0 if empty else max(a[1], b[1]) - min(a[0], b[0]) + max(a[3], b[3]) - min(a[2], b[2])
    out = None
    while True:
        cell = lambda c: F.floor(c / reach).cast("long")  # noqa: B023, E731
        listed = boxes.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x0") - reach), cell(F.col("_x1") + reach))))
        listed = listed.withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0") - reach), cell(F.col("_y1") + reach)))).select("zone", "ring", "_cx", "_cy")
        near = left.withColumns({"_cx": cell(F.col("_x")), "_cy": cell(F.col("_y"))}).join(listed, ["_cx", "_cy"])
        far = F.when(_inside(F.col("_x"), F.col("_y"), F.col("ring")), 0.0).otherwise(F.round(_segment_distance(F.col("_x"), F.col("_y"), F.col("ring")), 9))
        best = near.groupBy(key).agg(F.min(F.struct(far.alias("d"), "zone")).alias("b")).where(F.col("b.d") <= reach)
        best = best.select(key, F.col("b.zone").alias("zone"), F.col("b.d").alias("distance"))
        out = best if out is None else out.unionByName(best)
        if reach >= span:
            return out
        left = left.join(best, key, "left_anti")
        reach *= 4


def nearest_until_enough(units: DataFrame, need: DataFrame, group: str, order: Sequence[str], size: str, wanted: str) -> DataFrame:
    """The units of each group, in the given order, until their sizes reach what the group
    needs (group, wanted); the nearest one at least."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = units.join(need, group).withColumns({"_before": F.coalesce(F.sum(size).over(w), F.lit(0)), "_n": F.count("*").over(w)})
    return out.where((F.col("_before") < F.col(wanted)) | (F.col("_n") == 0)).drop("_before", "_n", wanted)


def assign_units(units: DataFrame, unit: str, known: dict[str, DataFrame]) -> DataFrame:
    """units with zone and rule: that of the first source, in order, with a zone for the
    unit (unit, zone); null where none has. Units must be unique within a source."""
    out, names = units, []
    for name, table in known.items():
        out = out.join(table.select(unit, F.col("zone").alias(f"_{name}")), unit, "left")
        names.append(name)
    rule = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names])
    return out.withColumns({"zone": F.coalesce(*[f"_{n}" for n in names]), "rule": rule}).drop(*[f"_{n}" for n in names])


def fill_from_zone(df: DataFrame, zone: str, value: str, residents: str) -> DataFrame:
    """A missing value becomes the zone's rate, of the rows that state it, times the row's
    residents."""
    stated = df.where(F.col(value).isNotNull()).groupBy(zone).agg((F.sum(value) / F.nullif(F.sum(residents), F.lit(0))).alias("_rate"))
    return df.join(stated, zone, "left").withColumn(value, F.coalesce(F.col(value), F.col("_rate") * F.col(residents))).drop("_rate")


def scale(whole: Column, part: Column, least: float, most: float) -> Column:
    """whole / part within bounds; 1 where it is not known."""
    ratio = whole / F.when(part != 0, part)
    return F.when(ratio.isNull(), 1.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), ratio)))
