from fieldmark.sources.files import read_csv, read_hourly_json


def test_csv_seed(spark, tmp_path):
    (tmp_path / "v.csv").write_text('venue_id,name,latitude,longitude,timezone,roof,canonical_venue_id,confidence,notes\n1,"A, Oval",-37.5,145,Australia/Melbourne,none,,high,"said ""yes"""\nx,B,,,,,,,\n')
    a, b = read_csv(spark, str(tmp_path / "v.csv")).cache().orderBy("venue_id", ascending=False).collect()
    assert (a.venue_id, a.name, a.canonical_venue_id, a.notes, a._broken) == (1, "A, Oval", None, 'said "yes"', None)
    assert b.venue_id is None and b._broken.startswith("x,B")


def test_hourly_json(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"series": "s", "hourly": {"time": [0, 3600], "temp": [1.5, null], "precip": [0.2]}}\n')
    assert sorted(map(tuple, read_hourly_json(spark, str(tmp_path / "h.json"), ("temp", "precip")).collect())) == [("s", 0, 1.5, 0.2), ("s", 3600, None, None)]
