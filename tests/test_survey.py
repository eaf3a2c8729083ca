"""The survey cleaning on small chains with results written out, and its invariants."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripmill.jobs import survey as jobs
from tripmill.operators import survey

COLUMNS = ["person", "day", "trip", "event_id", "hh", "origin", "dest", "home", "origin_zone", "dest_zone", "home_zone", "motive", "kind", "answer", "start", "minutes", "mode", "age", "occupation"]
TYPES = "person long, day int, trip long, event_id long, hh long, origin long, dest long, home long, origin_zone long, dest_zone long, home_zone long, motive string, kind string, answer string, start long, minutes long, mode long, age long, occupation long"
RULES = survey.SurveyRules("back", "other", "home", ["work"], ["work"], ["shop"], "escort", "care", {"office": "work", "mall": "shop"}, ["hotel"], same={"mode": 1.0}, read_hours=True)


def chain(spark, *trips):
    """Trips (person, origin, dest, motive, kind, start, minutes, answer); home is zone 0."""
    rows, seen = [], {}
    for k, (p, o, d, m, kind, s, mins, answer) in enumerate(trips):
        seen[p] = seen.get(p, 0) + 1
        rows.append((p, 1, seen[p], k, p // 10, o, d, 0, o + 200, d + 100, 999, m, kind, answer, s, mins, 1, 30, 1))
    df = spark.createDataFrame(rows, TYPES)
    legs = df.select("person", "day", "trip", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("leg"), "minutes")
    half = F.floor(F.col("minutes") / 2)
    return df, legs.withColumn("minutes", F.when(F.col("leg") == 1, half).otherwise(F.col("minutes") - half))


def clean(spark, *trips, rules=RULES, **more):
    df, legs = chain(spark, *trips)
    done, parts = survey.clean_survey(df, legs, ["person", "day"], "event_id", rules, ["hh", "day"], "person", **more)
    return {(r.person, r.trip): r for r in done.collect()}, {(r.person, r.trip, r.leg): r.minutes for r in parts.collect()}


def test_each_rule_moves_zone_type_and_answer(spark):
    got, legs = clean(
        spark,
        (10, 0, 5, "work", "office", 480, 30, "home"), (10, 5, 7, "back", "mall", 1080, 30, "home"),  # a return to a mall
        (11, 3, 0, "work", "home", 480, 20, "home"), (11, 0, 0, "back", "home", 1020, 20, "home"),  # rotated
        (12, 0, 5, "shop", "mall", 600, 20, "home"), (12, 5, 0, "back", "home", 700, 90, "home"), (12, 0, 6, "shop", "mall", 760, 10, "home"), (12, 6, 0, "back", "home", 900, 10, "home"),
        (13, 8, 0, "back", "home", 400, 20, "home"), (13, 0, 8, "shop", "mall", 600, 20, "home"), (13, 8, 0, "back", "home", 700, 20, "home"),
    )
    assert (got[10, 2].motive, got[10, 2].fixes) == ("shop", "motive:kind")
    r, nxt = got[11, 1], got[11, 2]
    assert (r.origin, r.origin_zone, r.dest, r.dest_zone) == (0, 999, 3, 203) and (nxt.origin, nxt.origin_zone) == (3, 203) and r.fixes == "origin:rotated;dest:rotated"
    ride = got[12, 2]
    assert (ride.minutes, ride.fixes) == (60, "minutes:return") and legs[12, 2, 1] + legs[12, 2, 2] == 60
    assert got[13, 1].answer == "mall" and all(got[13, k].fixes == "answer:return" for k in (1, 2, 3))


def test_lost_questionnaires_and_hours(spark):
    plain = [(p, 0, 5, "shop", "mall", 600 + p, 20, "home") for p in range(20, 40)] + [(p, 5, 0, "back", "home", 660 + p, 20, "home") for p in range(20, 40)]
    got, _ = clean(
        spark, *plain,
        (50, 0, 5, None, None, None, 20, "home"), (50, 5, 0, None, None, None, 20, "home"), (50, 0, 0, "back", "home", 900, 20, "home"),
        (51, 0, 5, "work", "office", 480, 30, "home"), (51, 5, 0, "back", "home", 300, 30, "home"),
    )
    first, back = got[50, 1], got[50, 2]
    assert (first.motive, first.kind, first.fixes) == ("shop", "mall", "hour:neighbours;motive:neighbours") and first.start == 900 - 20 - 40
    assert (back.motive, back.start, back.fixes) == ("back", 900, "hour:duplicate;motive:duplicate") and (50, 3) not in got
    assert (got[51, 2].start, got[51, 2].fixes) == (1020, "hour:edit")


def test_corrections_must_fit(spark):
    df, legs = chain(spark, (10, 0, 5, "work", "office", 480, 31, "home"))
    fix = lambda before: spark.createDataFrame([(10, 1, 1, before, 50)], "person long, day int, trip long, before long, after long")
    args = (["person", "day"], "event_id", RULES, ["hh", "day"], "person")
    done, parts = survey.clean_survey(df, legs, *args, corrections=fix(31))
    assert done.first().minutes == 50 and done.first().fixes == "minutes:review" and parts.agg(F.sum("minutes")).first()[0] == 50
    with pytest.raises(ValueError, match="cannot be corrected"):
        survey.clean_survey(df, legs, *args, corrections=fix(30))
    done, parts = survey.clean_survey(df.limit(0), legs.limit(0), *args)
    assert done.count() == 0 and parts.count() == 0


def test_whole_run_keeps_its_invariants(spark):
    trips, legs, corrections = jobs._survey(spark, "/root/testdata/sf0.001")
    trips = trips.withColumn("start", F.when(F.col("event_id") % 19 != 0, F.col("start")))
    run = lambda t: survey.clean_survey(t, legs, ["person", "day"], "event_id", replace(jobs.RULES), ["hh", "day"], "person", corrections)
    done, parts = run(trips)
    done = done.persist()
    assert done.where("start IS NULL OR motive IS NULL").count() == 0
    sums = parts.groupBy("person", "day", "trip").agg(F.sum("minutes").alias("m"))
    assert done.join(sums, ["person", "day", "trip"]).where("m <> minutes").count() == 0
    chained = done.where("NOT issues LIKE 'no_trip%'")
    assert chained.where("issues LIKE '%discontinuous%' OR issues LIKE '%return_elsewhere%'").count() == 0
    again = run(trips.repartition(7))[0]
    assert done.exceptAll(again).count() == 0
