import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from fieldmark.functions.timetext import read
from fieldmark.functions.zones import tz_version, wall_to_epoch, zone_name
from fieldmark.operators.instants import match_starts, p1_found

MATCHES = "id long, venue_id long, date string, local_time string, kickoff_at string, timezone string"
VENUES = "id long, timezone string, canonical_venue_id long, date string"


def utc(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp())


def starts(spark, rows, venues=((1, "Australia/Melbourne", None, "x"), (2, None, 3, "x"), (3, " NZ", None, None), (4, None, None, None))):
    m = spark.createDataFrame([(*r, "clash") for r in rows], MATCHES)
    return {r.match_id: r for r in match_starts(m, spark.createDataFrame(venues, VENUES)).collect()}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2018-03-17T02:40:00Z", "2018-03-17 02:40"),
        ("2018-03-31T18:35:00+10:00", "2018-03-31 08:35"),
        ("1527998700", "2018-06-03 04:05"),
        ("1521175800000", "2018-03-16 04:50"),
        ("Sat, 28 Apr 2018 04:00:00 GMT", "2018-04-28 04:00"),
        ("20180331T094500Z", "2018-03-31 09:45"),
        ("18.03.2018 13.50", "2018-03-18 02:50"),
        ("02/06/2018 2:05 PM", "2018-06-02 04:05"),
        ("2018-06-23T12:05[Australia/Brisbane]", "2018-06-23 02:05"),
        ("17/03/2018 15:15 AEDT", "2018-03-17 04:15"),
        ("2018-03-18 16:20:00+1100", "2018-03-18 05:20"),
        ("5 Aug 2023 12:50 PM AEST", "2023-08-05 02:50"),
        ("27 April 2018 19:30", "2018-04-27 09:30"),
    ],
)
def test_kickoff_forms(spark, text, expected):
    assert starts(spark, [(1, 1, None, None, text)])[1].epoch_us == utc(expected) * 1_000_000


@pytest.mark.parametrize("date, time", [("2018-06-09", "19:30:00"), ("9/6/2018", "7:30 p.m."), ("09-Jun-18", "7.30pm"), ("Sat 9 Jun 2018", "1930"), ("June 9, 2018", "19:30 AEST"), ("20180609", "19:30:00+10:00"), ("2018-06-09T00:00:00", "7:30 PM AEST")])
def test_wall_forms(spark, date, time):
    row = starts(spark, [(1, 1, date, time, "TBC")])[1]
    assert (row.epoch_us, row.basis) == (utc("2018-06-09 09:30") * 1_000_000, "date_time")


def test_nothing_fixed(spark):
    rows = [
        (1, 1, "2021-04-04", "02:30", None),  # twice
        (2, 1, "2021-10-03", "02:30", None),  # never
        (3, 1, "2021-02-30", "12:00", "0000-00-00 00:00:00"),
        (4, 1, "2021-05-01", "--:--", ""),
        (5, 4, None, None, "2021-05-01 12:00"),  # venue without a zone
        (6, None, None, None, "2021-05-01T12:00:00+99:00"),
        (7, 1, None, "13:00 PM", "x" * 100_000),
    ]
    got = starts(spark, rows)
    assert all(r.epoch_us is None and r.basis is None for r in got.values())
    assert [got[k].wall_status for k in (1, 2)] == ["twice", "never"]
    assert got[5].kickoff_status == "no_zone" and got[4].kickoff_status == "missing"


def test_zone_of_canonical_venue_and_repeats(spark):
    rows = [(1, 2, None, None, "2021-07-01 12:00"), (1, 2, None, None, "2021-07-01 12:00")]
    m = spark.createDataFrame([(*r, "c") for r in rows], MATCHES)
    v = spark.createDataFrame([(2, None, 3, "x"), (3, " NZ", None, None)], VENUES)
    assert [tuple(r) for r in p1_found(match_starts(m, v)).collect()] == [(1, utc("2021-07-01 00:00"))]
    assert p1_found(match_starts(m.limit(0), v)).collect() == []


def test_transitions_against_zoneinfo():
    rng = np.random.default_rng(1)
    for zone in ("Australia/Melbourne", "Australia/Lord_Howe", "Asia/Shanghai", "America/New_York", "Africa/Casablanca"):
        wall = rng.integers(0, 4_000_000_000, 400)
        seconds, count = wall_to_epoch(wall, zone, tz_version())
        for w, s, c in zip(wall.tolist(), seconds.tolist(), count.tolist(), strict=True):
            naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=w)
            hits = {int(naive.replace(tzinfo=ZoneInfo(zone), fold=f).timestamp()) for f in (0, 1)}
            hits = {h for h in hits if dt.datetime.fromtimestamp(h, ZoneInfo(zone)).replace(tzinfo=None) == naive}
            assert len(hits) == c and (c != 1 or hits == {s})


def test_fraction_and_names():
    assert read(pd.Series(["2018-05-05T08:20:00.123456Z"])).sod_us[0] == (8 * 60 + 20) * 60_000_000 + 123456
    assert zone_name("AUSTRALIA/sydney ") == "Australia/Sydney" and zone_name("nowhere") is None
    with pytest.raises(RuntimeError):
        wall_to_epoch(np.array([0]), "UTC", "0000x")
