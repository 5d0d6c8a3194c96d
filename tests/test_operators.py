import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from fieldmark.functions.labels import error_text, is_placeholder, team_name, venue_name
from fieldmark.operators import hourly, upsert, votes
from fieldmark.plans.blocks import in_blocks
from fieldmark.streaming.batches import merge_stream, published, windowed

R = upsert.Rule


def test_merge_rules(spark):
    leaves_live = lambda was, now: ~was("status").eqNullSafe(now("status")) & ~now("status").eqNullSafe(F.lit("Live"))
    rules = [R("k", "key"), R("status"), R("clock", when=leaves_live), R("note", "replace")]
    schema = "k long, status string, clock string, note string, other int"
    old = spark.createDataFrame([(1, "Live", "Q3", "a", 7), (2, "Complete", None, "b", 8), (3, "Live", "Q1", None, 9), (None, "x", None, None, 1)], schema)
    new = spark.createDataFrame([(1, "Complete", None, "a", 0), (2, None, None, "b", 0), (4, "Live", "Q2", "n", 0), (None, "y", None, None, 0)], schema)
    got = {(r.k, r.status): tuple(r)[2:] for r in upsert.merge(old, new, rules).collect()}
    assert got[(1, "Complete")] == (None, "a", 7, "updated")
    assert got[(2, "Complete")] == (None, "b", 8, None)
    assert got[(3, "Live")] == ("Q1", None, 9, None)
    assert got[(4, "Live")] == ("Q2", "n", None, "inserted")
    assert (None, "x") in got and (None, "y") in got
    again = upsert.merge(upsert.merge(old.where("k is not null"), new.where("k is not null"), rules).drop("_change"), new.where("k is not null"), rules)
    assert again.where("_change is not null").count() == 0
    assert upsert.merge(old.limit(0), new, rules).where("_change = 'inserted'").count() == 4


def test_small_upserts(spark):
    old = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "k long, v int")
    new = spark.createDataFrame([(1, 3), (2, 9), (3, None), (4, 1)], "k long, v int")
    assert sorted(map(tuple, upsert.fill_unknown(old, new, ["k"], "v").collect()), key=str) == [(1, 3), (2, 5), (3, None)]
    assert upsert.insert_missing(old, new, ["k"]).count() == 4
    assert upsert.same_rows(old, old) and not upsert.same_rows(old, new)
    keyed = upsert.with_keys(old, spark.createDataFrame([("b",), ("a",)], "name string"), "k", ["name"])
    assert sorted((r.k, r.name) for r in keyed.collect()) == [(4, "a"), (5, "b")]
    m = upsert.merged_identity(spark.createDataFrame([(1, 5, None), (1, 5, 2), (1, 6, None)], "k long, a int, b int"), ["k"], ["a", "b"]).first()
    assert (m.a, m.b, m.conflicts) == (None, 2, ["a"])


def hours(spark, start, n, **values):
    rows = [("s", start + 3600 * i, *[(v[i] if isinstance(v, list) else v) for v in (values.get(m, 1.0) for m, _, _ in hourly.METRICS)]) for i in range(n)]
    return spark.createDataFrame(rows, "series string, hour long, temp double, humidity double, precip double, wind double, gust double")


def one(spark, h, start):
    return hourly.windows(spark.createDataFrame([(1, "s", start)], "id long, series string, start long"), h).first()


def test_hourly_windows(spark):
    day = int(dt.datetime(2026, 7, 17, tzinfo=ZoneInfo("Australia/Melbourne")).timestamp())
    h = hours(spark, day, 48, temp=15.0, humidity=60.0, precip=0.5, wind=20.0, gust=35.0)
    start = day + 86400 + 19 * 3600 + 40 * 60
    assert tuple(one(spark, h, start)) == (1, 15.0, 60.0, 1.5, 20.0, 35.0, 12.0)
    broken = h.withColumn("temp", F.when(F.col("hour") != day + 86400 + 19 * 3600, F.col("temp"))).where(F.col("hour") != day + 86400 + 3600)
    r = one(spark, broken, start)
    assert (r.temp, r.precip, r.prior_precip) == (None, 1.5, None)
    twice = h.unionByName(h.where(F.col("hour") == day + 86400 + 20 * 3600))
    assert one(spark, twice, start).precip is None
    assert one(spark, h.limit(0), start).temp is None
    # across the end of daylight saving the axis of instants has 25 hours and stays whole
    fall = int(dt.datetime(2026, 4, 3, 13, tzinfo=dt.UTC).timestamp())
    kick = int(dt.datetime(2026, 4, 5, 4, tzinfo=dt.UTC).timestamp())
    assert one(spark, hours(spark, fall, 72), kick).prior_precip == 24.0


def test_model_preference(spark):
    rows = [("s", "b", 0, 1.0, None), ("s", "a", 0, 9.0, None), ("s", "b", 3600, 2.0, 7.0), ("s", "c", 0, 5.0, 5.0)]
    h = spark.createDataFrame(rows, "series string, model string, hour long, temp double, precip double").withColumns({c: F.lit(None).cast("double") for c in ("humidity", "wind", "gust")})
    got = hourly.prefer(h, ["a", "b"]).where("temp is not null or precip is not null").select("hour", "temp", "precip").collect()
    assert sorted(map(tuple, got), key=str) == [(0, 9.0, None), (3600, None, 7.0)]


def test_vote_cascade(spark):
    m = spark.createDataFrame([(1, "2024-05-01", 10, 20, 2024), (2, "2024-05-02", 10, 20, 2024), (3, "2024-05-02", 10, 30, 2024)], "match_id long, date string, home_team_id long, away_team_id long, season int")
    players = [(1, 10, 1, "Pat", "O'Neil"), (1, 10, 2, "Alexander", "Lee"), (1, 10, 3, "Alexander", "Smith"), (1, 10, 4, "Alexandra", "Smith"), (1, 20, 5, "Sam", "Hill"), (2, 20, 6, "Una", "Far")]
    p = spark.createDataFrame([(*x, 2024) for x in players], "match_id long, team_id long, player_id long, given string, surname string, season int")
    lines = [(1, 10, "Pat", "Oneil"), (2, 10, "Alex", "Lee"), (3, 10, "Alex", "Smith"), (4, 20, "Sam", "Hill"), (5, 10, "Una", "Far"), (6, 10, "No", "Body"), (7, 10, None, None)]
    v = spark.createDataFrame([(i, "2024-05-01", t, g, s, 2024) for i, t, g, s in lines] + [(8, "2024-05-02", 10, "Pat", "Lee", 2024), (9, "1999-01-01", 10, "Pat", "Lee", 2024)], "vote_id long, date string, team_id long, given string, surname string, season int")
    got = {r.vote_id: (r.player_id, r.tier, r.outcome) for r in votes.resolve(v, m, p).collect()}
    assert got == {1: (1, 2, "resolved"), 2: (2, 3, "resolved"), 3: (None, None, "ambiguous"), 4: (5, 1, "resolved"), 5: (6, 6, "resolved"), 6: (None, None, "unresolved_player"), 7: (None, None, "unresolved_player"), 8: (None, None, "ambiguous_match"), 9: (None, None, "unresolved_match")}


def test_labels(spark):
    df = spark.createDataFrame([(" GWS ", "AFLM", 2020), ("Brisbane", "AFLM", 1995), ("Brisbane", "AFLM", 2000), ("2nd", "x", 1), ("Winner of QF1", "x", 1), (None, None, None)], "n string, c string, y int")
    got = [tuple(r) for r in df.select(team_name(F.col("n"), F.col("c"), F.col("y")), is_placeholder(F.col("n"))).collect()]
    assert got == [("GWS Giants", False), ("Brisbane Bears", False), ("Brisbane Lions", False), ("2nd", True), ("Winner of QF1", True), (None, None)]
    assert spark.range(1).select(venue_name(F.lit("M.C.G."))).first()[0] == "MCG"
    assert spark.range(1).select(error_text(F.lit("failed https://x.y/z?key=1 now\nmore"))).first()[0] == "failed https://x.y/z now"


def test_blocks_cover_a_hot_series(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS s", "id AS t").unionByName(spark.createDataFrame([(None, 5)], "s string, t long"))
    got = in_blocks(df.repartition(7), "s", ["t"], 64, 5).toPandas()
    core = got[got._core]
    assert len(core) == 1001 and core.groupby("s").t.apply(lambda x: x.nunique()).sum() == 1000
    a = got[got.s == "a"]
    assert (a[a._core].sort_values("t")._index.tolist()) == list(range(900))
    block = a[a._block == 2]
    assert block._index.min() == 128 - 5 and block._index.max() == 191 + 5


def test_merge_stream(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    import os

    os.makedirs(folder)
    schema = "k long, v int, at int, season int"
    rules = [R("k", "key"), R("v"), R("at", "replace"), R("season", "replace")]
    seen = []
    for rows in ([(1, 5, 1, 2020), (1, 6, 2, 2020), (2, None, 1, 2021)], [(1, None, 3, 2020), (3, 1, 1, 2022)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = merge_stream(spark.readStream.schema(schema).parquet(source), folder, rules, "at", "season", f"{tmp_path}/cp", lambda a: seen.append({r.season for r in a.collect()}))
        q.awaitTermination()
        assert q.exception() is None
    assert sorted(map(tuple, published(spark, folder).collect())) == [(1, 6, 3, 2020), (2, None, 1, 2021), (3, 1, 1, 2022)]
    assert seen == [{2020, 2021}, {2020, 2022}]


def test_windowed_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 10), "a", 1.0), (dt.datetime(2024, 1, 1, 0, 50), "a", 2.0), (dt.datetime(2024, 1, 1, 1, 10), "b", 3.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = windowed(s).writeStream.format("memory").queryName("w_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("w_out").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_every_hour_is_a_target(spark, tmp_path):
    from fieldmark.plans import operations

    # 30 hours of one type, two events an hour; a mean of -0.25 goes up to -0.2
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m), "a", v) for h in range(30) for m, v in ((5, -0.5), (50, 0.0))]
    s = spark.createDataFrame([*rows, (dt.datetime(2024, 1, 1, 7), "b", 9.0)], "ts timestamp, event_type string, value double")
    s.write.parquet(f"{tmp_path}/events.parquet")
    got = operations.QUERIES["hourly_windows_all"](spark, str(tmp_path)).collect()
    begin = int(s.selectExpr("min(unix_timestamp(ts))").first()[0]) // 3600 * 3600
    by = {r.id: tuple(r)[1:] for r in got}
    assert len(by) == len(got) == 31
    assert by[f"a@{begin + 5 * 3600}"] == (-0.2, -0.5, 6.0, 0.0, 0.0, None)
    assert by[f"a@{begin + 25 * 3600}"] == (-0.2, -0.5, 6.0, 0.0, 0.0, 48.0)
    assert by[f"a@{begin + 28 * 3600}"] == (None, None, None, None, None, 48.0)
    assert sum(v == (None,) * 6 for k, v in by.items() if k[0] == "b") == 1
