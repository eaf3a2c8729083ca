"""Contracts that raise, and files."""

import gzip

import pytest
from pyspark.sql import functions as F

from tripmill.operators import contract, imputation, joins, reports, targets
from tripmill.operators.contract import Rule, Variable
from tripmill.sources import tables


def test_files(spark, tmp_path):
    path = tmp_path / "decisions.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("household,person,field,after\n1,2,motive,\n3,4,,work\n")
    got = [tuple(r) for r in contract.read_decisions(spark, str(path), ["household", "person"]).orderBy("household").collect()]
    assert got == [(1, 2, "motive", ""), (3, 4, "", "work")]
    (tmp_path / "survey.csv").write_bytes("clave,año\n1,sí\n".encode("latin-1"))
    survey = tables.read_survey_csv(spark, str(tmp_path / "survey.csv"), "clave long, `año` string", {"clave": "hh", "none": "x"})
    assert [tuple(r) for r in survey.collect()] == [(1, "sí")] and survey.columns == ["hh", "año"]
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k long, x double")
    contract.write_tables({"t": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 2
    contract.write_tables({"t": df}, str(tmp_path / "csv"), "csv", 3)
    assert "1,0.500" in "".join(p.read_text() for p in (tmp_path / "csv/t").glob("*.csv"))


def test_contracts_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a", "5"), (1, None, "x")], "k long, c string, n string")
    rules = {"k": Rule("bigint", low=1), "c": Rule("string", False, levels=["a"]), "n": Rule("int")}
    with pytest.raises(ValueError, match="too many: n"):
        contract.conform_schema(df, {"k": rules["k"], "c": rules["c"]}, ["k"])
    found = {(r.column, r.rule): r.rows for r in contract.schema_violations(df, rules, ["k"]).collect()}
    assert found == {("c", "null"): 1, ("n", "type"): 1, ("k", "key"): 1}
    with pytest.raises(ValueError, match="broken rules"):
        contract.conform_schema(df, rules, ["k"])
    assert contract.schema_violations(df.limit(0), rules, ["k"]).count() == 0
    table = spark.createDataFrame([("a", 1), ("b", None)], "code string, id int")
    assert contract.strict_lookup(df.where("c = 'a'"), "c", table, "code", "id").first().id == 1
    for code in ("b", "z"):
        with pytest.raises(ValueError, match=f"no id: {code}"):
            contract.strict_lookup(df.withColumn("c", F.lit(code)), "c", table, "code", "id")
    with pytest.raises(ValueError, match="unlisted"):
        contract.zone_ids(df, "c", "n", ["a"], ["5"])
    with pytest.raises(ValueError, match="neither"):
        contract.imputed_attribute(df, ["k"], "c", df.select("k", F.lit(None).cast("double").alias("p")), "p")
    with pytest.raises(ValueError, match="no area"):
        contract.area_units_crosswalk(df.withColumn("k", F.monotonically_increasing_id()), spark.createDataFrame([("q", 1)], "c string, z int"), spark.createDataFrame([("y", 2)], "n string, z int"), "k", "c", "n")
    with pytest.raises(ValueError, match="not in draw"):
        contract.attach_draw(df, ["k"], spark.createDataFrame([(1, 1, "v")], "k long, draw int, c string"), 2, "c", F.lit(True))
    with pytest.raises(ValueError, match="no usable weight"):
        joins.attach_weight(df.select("k"), spark.createDataFrame([(1, -2.0)], "k long, weight double"), "k")
    with pytest.raises(ValueError, match="unlisted"):
        imputation.build_task_frame(df, [], "c", {"b": "x"})


def test_needed_variables_follow_what_they_read():
    v = lambda name, *reads: Variable(name, lambda: F.lit(1), reads)
    spec = [v("a", "raw"), v("b", "raw"), v("a", "a", "c"), v("c", "b"), v("d", "a")]
    assert [x.name for x in contract.needed_variables(spec, "d")] == ["a", "a", "d"]
    assert [x.name for x in contract.needed_variables(spec, "c")] == ["b", "c"]


def test_snapshots_and_groups_of_zero(spark):
    a = spark.createDataFrame([(1, "x"), (1, None), (2, "y"), (3, "z")], "p long, f string")
    b = spark.createDataFrame([(1, None), (1, "x"), (2, "Y"), (4, "z")], "p long, f string")
    got = {r.p: r.status for r in reports.snapshot_changes(a, b, ["p"], ["f"]).collect()}
    assert got == {2: "changed", 3: "removed", 4: "added"}
    areas = spark.createDataFrame([(1, 0, 10.0), (1, None, 10.0), (2, 4, 10.0)], "g long, n long, total double")
    done = targets.row_targets(areas, [targets.Target("t", "n", grow_within=("g", "total"))])
    assert sorted(r.t for r in done.collect()) == [0.0, 0.0, 10.0]
