import pytest
from pyspark.sql import functions as F

from fieldmark.operators import sync, upsert
from fieldmark.plans import seasons
from fieldmark.plans.warehouse import Warehouse


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_identity_in_two_stages(spark):
    schema = "id long, ext string, date string, home long, away long, id2 int"
    old = spark.createDataFrame([(1, "x1", "2020-01-01", 5, 6, 0), (2, None, "2020-01-02", 5, 6, 0), (3, "x3", "2020-01-03", 7, 8, 0), (4, None, None, 7, 8, 0), (9, "x1", "2020-02-01", 1, 2, 0)], schema)
    new = spark.createDataFrame([(11, "x1", "2020-01-09", 1, 1, 0), (12, "y", "2020-01-02", 5, 6, 0), (13, None, "2020-01-03", 7, 8, 0), (14, None, None, 7, 8, 0), (15, "x3", None, None, None, 0), (15, "x3", None, None, None, 0)], schema)
    got = {(r.id, r.found, r.stage) for r in sync.identify(new, old, "ext", ["date", "home", "away"]).collect()}
    # the row that x3 claims is not found by its date and teams again
    assert got == {(11, 1, "external"), (12, 2, "natural"), (13, None, "new"), (14, None, "new"), (15, 3, "external")}
    assert {r.stage for r in sync.identify(new, old.limit(0), "ext", ["date", "home", "away"]).collect()} == {"new"}


def test_admission(spark):
    lines = spark.createDataFrame([(1, 5, 10, 80, 9), (1, 6, 10, 0, 0), (2, 6, 10, 0, 0), (1, 99, 10, 50, 5), (1, 7, 10, None, None), (None, 5, 10, 1, 1)], "m long, p long, t long, tog int, d int")
    known = {"p": spark.createDataFrame([(5,), (6,), (7,)], "x long"), "m": spark.createDataFrame([(1,), (2,)], "x long")}
    got = sync.admitted(lines, spark.createDataFrame([(2, 6)], "m long, p long"), known, ["m", "p"], F.expr("tog = 0 AND d = 0"))
    assert sorted((r.m, r.p) for r in got.collect()) == [(1, 5), (1, 7), (2, 6)]


def test_snapshots(spark):
    r = [(1, 1, p, 0) for p in range(3)] + [(1, 2, 0, 0), (1, 2, 0, 0), (1, 2, 1, 0), (1, 2, 2, 0), (2, 1, 0, 0), (2, 1, 1, 1), (2, 1, 77, 0)]
    faults = sync.snapshot_faults(spark.createDataFrame(r, "m long, t long, p long, e int"), ["m", "t"], "p", spark.range(10), (3, 3), F.col("e") == 0)
    assert rows(faults) == [(1, 1, 3, 0, 0, True), (1, 2, 3, 1, 0, False), (2, 1, 2, 0, 1, False)]
    old = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "m long, p long")
    assert rows(sync.pruned(old, spark.createDataFrame([(1, 6), (1, 7)], "m long, p long"), ["m"], ["p"])) == [(1, 6), (2, 5)]
    assert rows(sync.pruned(old, old.limit(0), ["m"], ["p"])) == rows(old)


def test_small_rules(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    c = spark.createDataFrame([(1, "a", "A"), (2, "x", "B"), (3, None, "C"), (4, "d", "D")], "k long, expected string, corrected string")
    assert rows(sync.corrected(old, c, ["k"], "v")) == [(1, "A"), (2, "b"), (3, "C")]
    assert rows(sync.assigned(old, spark.createDataFrame([(1, None), (9, "z")], "k long, v string"), ["k"], ["v"])) == [(1, None), (2, "b"), (3, None)]
    t = spark.createDataFrame([(1, 5, 2018), (1, 6, 2020), (None, 1, 2020), (2, 1, None)], "h long, a long, y int")
    assert rows(sync.rekeyed(t, ["h", "a"], 1, 9, F.col("y") > 2019)) == sorted([(1, 5, 2018), (9, 6, 2020), (None, 9, 2020), (2, 1, None)], key=str)
    merged = upsert.merge(old, spark.createDataFrame([(1, "z"), (2, "b"), (7, "n")], "k long, v string"), [upsert.Rule("k", "key"), upsert.Rule("v")])
    assert rows(sync.revised(old.withColumn("revision", F.lit(4)), merged, "k")) == [(1, 5), (2, 4), (3, 4), (7, 1)]
    children = spark.createDataFrame([(1, "w"), (2, "w"), (None, "w")], "m long, kind string")
    assert rows(sync.invalidated(children, old, merged.select("k", "v"), "k", ["v"], "m")) == sorted([(2, "w"), (None, "w")], key=str)
    assert rows(sync.cascaded(old.where("k = 1").withColumnRenamed("k", "id"), {"c": (children, "m")})["c"]) == sorted([(2, "w"), (None, "w")], key=str)
    times = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, None)], "k long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.k for r in sync.retained(times, "t", "2024-03-10 00:00:00", 30).collect()) == [2, 3]


def test_affected_holds_what_a_row_left(spark):
    rules = [upsert.Rule("id", "key"), upsert.Rule("m", "replace")]
    old, new = spark.createDataFrame([(1, 10), (2, 20)], "id long, m long"), spark.createDataFrame([(1, 11), (2, 20), (3, None)], "id long, m long")
    assert {r.m for r in upsert.affected(upsert.merge(old, new, rules, ("m",)), "m").collect()} == {10, 11, None}


def test_reconciliation(spark):
    m = spark.createDataFrame([(1, 5, 6, 80, 70), (2, 5, 6, None, None)], "id long, home_team_id long, away_team_id long, home_points int, away_points int")
    o = [(1, "a", 1, 5, 80, 70, "c"), (2, "a", 1, 6, 70, 80, "d"), (3, "a", 1, 7, 80, 70, "e"), (4, "b", 1, 5, 81, 70, "f"), (5, "a", 9, 5, 80, 70, "g"), (6, "a", 2, 5, 1, 2, "h"), (7, "a", 2, 5, 1, 2, "i"), (8, "a", None, 5, 1, 2, "j"), (9, "c", 2, None, None, None, None), (9, "c", 2, None, None, None, None)]
    got = dict(sync.reconciled(spark.createDataFrame(o, "id long, provider string, match_id long, team_id long, home_points int, away_points int, external_coach_id string"), m).collect())
    assert got == {1: "assigned", 2: "assigned", 3: "invalid-participant", 4: "score-mismatch", 5: "unknown-match", 6: "duplicate", 7: "duplicate", 9: "assigned"}


def test_approval(spark):
    preview = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    wanted = sync.digest([{"k": 2, "v": "b"}, {"v": "a", "k": 1}])
    assert sync.approved(preview, wanted).count() == 2
    with pytest.raises(ValueError, match="not the approved one"):
        sync.approved(preview.limit(1), wanted)


def test_seasons(spark):
    w = Warehouse(spark, "/root/testdata/sf0.001")
    for code, competition, selector in (("AMBIGUOUS_SEASON", "AFLW", 2022), ("INVALID_SEASON", "AFLM", "20"), ("INVALID_SEASON", "X", 2020), ("SEASON_NOT_FOUND", "AFLM", 1901)):
        with pytest.raises(seasons.SeasonError) as e:
            seasons.season_id(w, competition, selector)
        assert e.value.code == code
    assert seasons.season_key("AFLW", "2022-S7") == "2022-S7"
    year = w.matches().where("code = 'AFLM'").first().year
    assert seasons.season_id(w, "AFLM", year) == 10000 + year
    for competition, year_ in (("AFLM", 1997), ("AFLW", 2016), ("VFL", 2020)):
        with pytest.raises(seasons.SeasonError):
            seasons.check_valued(competition, year_)
    seasons.check_valued("AFLM", 1998)
    d = seasons.describe(w, "AFLM", year, observed=True)
    assert d["inventory"].count() == 1 and ("matches", "id", "bigint") in d["tables"]
    assert "coverage" not in seasons.describe(w)
    for bad in ({"competition": "AFLM"}, {"season": 2020}, {"competition": "AFLM", "season": 2020}):
        with pytest.raises(ValueError):
            seasons.describe(w, **bad)
