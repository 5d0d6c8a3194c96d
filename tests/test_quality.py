import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldmark.operators import profile, spikes
from fieldmark.sources.footers import footers


@pytest.mark.parametrize("compression", ["snappy", "zstd", "gzip", "none"])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_dictionaries_are_the_distinct_values(spark, tmp_path, compression, version):
    rng = np.random.default_rng(3)
    t = pa.table({"a": pa.array([None if x == 3 else int(x) for x in rng.integers(0, 20, 5000)], pa.int32()), "s": pa.array([None if x == 2 else f"v{x}" for x in rng.integers(0, 9, 5000)]), "d": pa.array(rng.integers(0, 4, 5000) / 2), "u": pa.array(np.arange(5000))})
    pq.write_table(t, f"{tmp_path}/t.parquet", row_group_size=1500, compression=compression, data_page_version=version, data_page_size=700, use_dictionary=["a", "s", "d"])
    rows = footers(spark, f"{tmp_path}/t.parquet").collect()
    assert len(rows) == 16
    for c in ("a", "s", "d"):
        of = [r for r in rows if r.column == c]
        assert not any(r.scanned for r in of)
        assert len({h for r in of for h in r.hashes}) == t[c].drop_null().unique().__len__()
        assert sum(r.nulls for r in of) == t[c].null_count
    # a chunk without a dictionary is read on its own
    u = [r for r in rows if r.column == "u"]
    assert all(r.scanned for r in u) and len({h for r in u for h in r.hashes}) == 5000
    assert not any(r.scanned for r in footers(spark, f"{tmp_path}/t.parquet", values=False).collect() if r.column in ("a", "u"))
    assert (min(r.lo for r in rows if r.column == "u"), max(r.hi for r in rows if r.column == "u")) == (0, 4999)
    assert all(r.lo is None for r in rows if r.column in ("s", "d"))
    assert min(r.lo_text for r in rows if r.column == "s") == "v0" and max(r.hi_real for r in rows if r.column == "d") == 1.5


def test_some_chunks_without_dictionary_and_odd_values(spark, tmp_path):
    os.mkdir(f"{tmp_path}/m.parquet")
    base = {"id": [1, 2, 3], "x": [1.5, float("nan"), None], "s": ["é", "", None], "b": [True, None, True], "t": pd.to_datetime(["2024-01-02", None, "2024-01-01"]).astype("datetime64[us]"), "n": pd.array([None] * 3, dtype="Int64")}
    for k, dictionary in enumerate((True, False)):
        f = pd.DataFrame(base).assign(id=[1 + k, 2 + k, 3 + k], x=[1.5, -2.0, None] if k else base["x"])
        t = pa.Table.from_pandas(f, preserve_index=False)
        t = t.set_column(t.column_names.index("x"), "x", pa.array([*f["x"][:2], None], from_pandas=False))
        pq.write_table(t, f"{tmp_path}/m.parquet/{k}.parquet", use_dictionary=dictionary)
    p = {r.column_name: r for r in profile.column_profile(spark, profile.Source("m", f"{tmp_path}/m.parquet")).collect()}
    assert (p["id"].distinct_values, p["id"].lo, p["id"].hi, p["id"].chunks, p["id"].scanned_chunks) == (4, "1", "4", 2, 1)
    assert (p["x"].distinct_values, p["x"].lo, p["x"].hi, p["x"].nulls) == (3, "-2.0", "NaN", 2)
    assert (p["s"].distinct_values, p["s"].lo, p["s"].hi) == (2, "", "é") and p["b"].distinct_values == 1
    assert (p["t"].lo, p["t"].hi, p["n"].nulls, p["n"].distinct_values) == ("2024-01-01 00:00:00", "2024-01-02 00:00:00", 6, 0)


def write(tmp_path, pdf, name="t", groups=400):
    path = f"{tmp_path}/{name}.parquet"
    pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), path, row_group_size=groups)
    return path


def loads(seed=1, n=2400):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"id": np.arange(n), "load_no": np.repeat(np.arange(8), n // 8), "x": rng.poisson(3, n), "cap": 12, "s": "ok"})
    f["x"] = f["x"].astype("Int64").clip(upper=12)
    f["load_no"] = f["load_no"].astype("Int64")
    return f


def test_rows_and_loads(spark, tmp_path):
    f = loads()
    f.loc[f.load_no == 2, "x"] += 6
    f.loc[(f.load_no == 5) & (f.id % 2 == 0), "x"] = None
    f.loc[[7, 900], "x"] = [-1, 99]
    f.loc[3, "load_no"] = None
    f["cap"] = 30
    source = profile.Source("t", write(tmp_path, f), rules=(profile.Rule("x", 0, "cap"),), patterns=(("s", "^ok$"),))
    got = {tuple(r)[2:] for r in profile.p3_found(spark, [source]).collect()}
    assert got == {("row", 7), ("row", 900), ("load", 2), ("load", 5)}
    p = {r.column_name: r for r in profile.column_profile(spark, source).collect()}
    assert p["x"].nulls == int(f.x.isna().sum()) and (p["x"].lo, p["x"].hi) == ("-1", "99") and p["x"].distinct_values == f.x.nunique()
    assert p["x"].violations == 2 and p["s"].violations == 0 and p["s"].lo == "ok" and p["cap"].scanned_chunks == 0
    assert profile.load_profile(spark, source).where("column_name = 'x' AND load_no = 5").first().nulls >= 140


def test_clean_empty_and_null_columns(spark, tmp_path):
    f = loads()
    rule = (profile.Rule("x", 0, 12),)
    clean = profile.Source("t", write(tmp_path, f), rules=rule)
    assert profile.p3_found(spark, [clean]).collect() == []
    empty = profile.Source("t", write(tmp_path, f.head(0), "e"), rules=rule)
    assert profile.p3_found(spark, [empty]).collect() == []
    assert {r.n_rows for r in profile.column_profile(spark, empty).collect()} == {0}
    f["x"] = pd.array([None] * len(f), dtype="Int64")
    nulls = profile.Source("t", write(tmp_path, f, "n"), rules=rule)
    assert profile.p3_found(spark, [nulls]).collect() == []
    r = next(r for r in profile.column_profile(spark, nulls).collect() if r.column_name == "x")
    assert (r.nulls, r.distinct_values, r.lo) == (len(f), 0, None)


def test_only_suspicious_files_are_opened(spark, tmp_path):
    for k, top in enumerate((5, 50)):
        f = loads(k)
        f.loc[0, "x"] = top
        write(tmp_path, f, f"d{k}")
    os.mkdir(f"{tmp_path}/d.parquet")
    for k in (0, 1):
        os.rename(f"{tmp_path}/d{k}.parquet", f"{tmp_path}/d.parquet/p{k}.parquet")
    files = profile.suspicious_files(footers(spark, f"{tmp_path}/d.parquet"), profile.Rule("x", 0, 12)).collect()
    assert [r.file[-10:] for r in files] == ["p1.parquet"]


def readings(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"match_id": np.arange(n), "kind": "observed", "source": np.where(np.arange(n) % 3, "a", "b"), "fetched_at": pd.date_range("2024-01-01", periods=n, freq="h").strftime("%Y-%m-%dT%H:%M:%SZ"), "place": rng.integers(0, 10, n), "month": rng.integers(3, 10, n), "hour": rng.uniform(10, 22, n)})
    f["band"] = -5
    f["temp_c"] = (20 - f.month + f.place * 0.5 + rng.normal(0, 2, n)).round(1)
    f["wind_gust_kmh"] = np.exp(rng.normal(3.3, 0.25, n)).round(1)
    f["precip_mm"] = np.where(rng.random(n) < 0.3, rng.gamma(1.2, 2, n), 0).round(1)
    f["humidity_pct"] = rng.normal(65, 8, n).round(1)
    return f


def test_planted_faults(spark):
    f = readings(spark)
    planted = {("temp_c", 100): 55.0, ("temp_c", 101): -999.0, ("wind_gust_kmh", 400): 240.0, ("precip_mm", 700): 150.0, ("humidity_pct", 900): 0.6, ("humidity_pct", 901): 130.0, ("temp_c", 1500): -30.0}
    for (c, k), v in planted.items():
        f.loc[k, c] = v
    run = f.index[f.source == "a"][800:806]
    f.loc[run, "humidity_pct"] = 66.6
    f.loc[f.index[f.source == "b"][100:104], "temp_c"] = 14.4  # four are no run
    f.loc[50, ["temp_c", "precip_mm"]] = None
    extra = pd.concat([f, f.iloc[[100, 100]]])
    got = {(r.field, r.match_id): r.fault for r in spikes.flag(spark.createDataFrame(extra).withColumn("noise", spikes.F.lit("x"))).collect()}
    assert {k for k, v in got.items() if v != "stuck"} >= set(planted)
    assert {k[1] for k, v in got.items() if v == "stuck"} == set(map(int, run))
    assert len(got) <= len(planted) + len(run) + 2


def test_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 64)
    f = readings(spark, 600)
    f["source"] = "hot"
    f.loc[62:66, "temp_c"] = 12.3
    got = {r.match_id for r in spikes.flag(spark.createDataFrame(f)).where("fault = 'stuck'").collect()}
    assert got == {62, 63, 64, 65, 66}


def test_no_readings(spark):
    assert spikes.flag(spark.createDataFrame(readings(spark, 30)).limit(0)).collect() == []
    assert spikes.stuck(np.array([1, 1, 1, 1, np.nan, 1.0])).sum() == 0
    assert not spikes.phase_space(np.zeros(10), (0, 0, 0), 0, 4).any()


def test_differences_decide(spark):
    """A reading within the threshold of its own value, whose difference from its place's neighbours is not."""
    f = readings(spark)
    at = f.index[(f.source == "b") & (f.place == 4)][20:23]
    expected = 20 - f.month[at] + f.place[at] * 0.5
    f.loc[at, "temp_c"] = (expected + [-5.0, 8.0, -5.0]).round(1)
    got = {(r.field, r.match_id): r.fault for r in spikes.flag(spark.createDataFrame(f)).collect()}
    assert {k for k in got if k[1] in set(at)} == {("temp_c", int(at[1]))}
    width = spikes.WIDTH * np.sqrt(2 * np.log((f.source == "b").sum()))
    assert 8.0 < width * 2 and len(got) <= 3
    u = np.array([0.1, -2.5, 4.0, -2.5, np.nan, 0.2, 0.0])
    assert spikes.phase_space(u, (1, 0.7, 2.4, 1.4), -2, 4.46).tolist() == [False, False, True, False, False, False, False]
    assert not spikes.phase_space(u, (1, 0, 0, 0), -2, 4.46).any()


def test_loads_of_every_column(spark, tmp_path):
    f = loads()
    f["s"] = [f"ok{k % 3}" for k in f.id]
    f["when"] = [f"2024-01-{k % 28 + 1:02d}" for k in f.id]
    f.loc[f.load_no == 3, "s"] = None
    f.loc[f.load_no == 6, "when"] = [f"{k % 28 + 1}/1/24" for k in f.id[f.load_no == 6]]
    f.loc[[9, 10], "s"] = "??"
    f.loc[5, "x"] = 99
    source = profile.Source("t", write(tmp_path, f), rules=(profile.Rule("x", 0, 12),), patterns=(("s", "^ok"),))
    got = {(r.column_name, r.load_no): r for r in profile.load_comparison(spark, source).collect()}
    assert {c for c, _ in got} == {"id", "x", "cap", "s", "when"} and len(got) == 40
    r = got["s", 0]
    assert (r.n_rows, r.nulls, r.distinct_values, r.lo, r.hi, r.mean, r.violations, r.departs) == (300, 0, 4, "??", "ok2", None, 2, False)
    assert (got["s", 3].nulls, got["s", 3].distinct_values, got["s", 3].lo, got["s", 3].departs) == (300, 0, None, True)
    own = f[f.load_no == 4]
    assert (got["x", 4].distinct_values, got["x", 4].lo, got["x", 4].violations, got["cap", 4].violations) == (own.x.nunique(), str(own.x.min()), 0, None)
    assert got["x", 4].mean == pytest.approx(own.x.mean()) and got["x", 0].violations == 1
    assert {k for k, v in got.items() if v.departs and k[0] != "id"} == {("s", 3), ("when", 6)}
    assert profile.p3_found(spark, [source]).where("scope = 'load'").collect() == []
