"""One small file per landed format: a good row, a sentinel, a bad line and a header."""

import io
import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.sources import binary as sb, json as sj, text as st


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def doc(spark, obj):
    return spark.createDataFrame([(obj if isinstance(obj, str) else json.dumps(obj),)], "value string")


def test_geojson(spark):
    f = lambda code, xyz: {"properties": {"code": code, "time": 1704067200000, "mag": 5.1, "magType": "mw", "place": "p"}, "geometry": {"coordinates": xyz}}
    r = sj.parse_geojson_events(doc(spark, {"features": [f("a", [140.5, 36.1, 10]), f("", [1, 2, 3]), f("b", [1, 2])]})).collect()
    assert len(r) == 1 and (r[0].event_id, r[0].lat, r[0].lon, r[0].depth_km) == ("a", 36.1, 140.5, 10.0)


def test_local_quakes(spark):
    rec = lambda i, la: {"id": i, "time": "2024/01/01 16:10:00", "earthquake": {"maxScale": 70, "hypocenter": {"name": "n", "latitude": la, "longitude": 137.3, "depth": 10, "magnitude": 7.6}}}
    r = sj.parse_local_quakes(doc(spark, [rec("x", 37.5), rec("y", 0)])).select("event_id", F.unix_seconds("ts").alias("t")).collect()
    assert [(x.event_id, x.t) for x in r] == [("x", 1704093000)]


def test_bulletins(spark):
    recs = [{"eid": "1", "at": "2024-01-01T16:10:00+09:00", "cod": "+37.5+137.2-10000/", "maxi": "7", "mag": "7.6"}, {"eid": "2", "cod": "broken", "mag": "x"}, {"eid": "3", "cod": "+35.9+137.6-0/", "mag": "x"}]
    r = {x.event_id: x for x in sj.parse_bulletins(doc(spark, recs)).collect()}
    assert set(r) == {"1", "3"} and r["1"].depth_km == 10.0 and r["1"].max_intensity == 70 and r["3"].mag is None


def test_station_snapshot(spark):
    r = sj.parse_station_snapshot(doc(spark, {"11": {"temp": [3.5, 0], "pressure": [None, None]}, "99": {"temp": [1, 0]}}), doc(spark, {"11": {"kjName": "A", "lat": [45, 30], "lon": [141, 15]}})).collect()
    assert len(r) == 1 and (r[0].lat, r[0].lon, r[0].temp, r[0].pressure) == (45.5, 141.25, 3.5, None)


def test_tables_in_json(spark):
    r = sj.parse_header_rows(doc(spark, [["time_tag", "Kp", "a", "n"], ["t1", "3.33", "", "8"], ["t2", "bad", "1", "x"]])).collect()
    assert [(x.time_tag, x.kp, x.a_running, x.station_count) for x in r] == [("t1", 3.33, None, 8), ("t2", None, 1.0, None)]
    t = {"table": {"columnNames": ["latitude", "time", "longitude", "analysed_sst"], "rows": [[30.0, "d", 130.0, 21.5], [31.0, "d", 130.0, None]]}}
    r = sj.parse_columnar_table(doc(spark, t)).collect()
    assert [(x.observed_at, x.lat, x.lon, x.value) for x in r] == [("d", 30.0, 130.0, 21.5)]
    r = sj.parse_parallel_arrays(doc(spark, {"datetime": ["2024-01-01T00:00:00Z", "x"], "Kp": [1.0, 2.0]})).collect()
    assert [x.kp for x in r] == [1.0]


def test_sensor_records(spark):
    recs = [{"stime": "2024-01-01 00:00:00", "slevel": 1.5, "sensor": "RAD"}, {"stime": "2024-01-01 00:01:00", "slevel": "2.5"}, {"stime": "2024-01-01 00:02:00", "slevel": 3, "sensor": "prt"},
            {"stime": "2024-01-01 00:03:00", "slevel": ""}, {"stime": "2024-01-01 00:04:00", "slevel": "abc"}, {"stime": "", "slevel": 1}]
    assert [(x.observed_at, x.sea_level_m) for x in sj.parse_sensor_records(doc(spark, recs)).collect()] == [("2024-01-01T00:00:00", 1.5), ("2024-01-01T00:01:00", 2.5)]
    deny = sj.parse_sensor_records(doc(spark, recs), allowed=None, deny=("rad",))
    assert {x.sea_level_m for x in deny.collect()} == {2.5, 3.0}


def test_station_list_filters_before_cap(spark):
    st_ = lambda code, lat, sensor: {"Code": code, "Location": "", "Lat": lat, "Lon": "135.0", "sensor": sensor}
    recs = [st_("aaa", "35", "prt"), st_("bbb", "60", "rad"), st_("ccc", "35", "rad"), st_("ddd", "35", "enc")]
    assert [x.code for x in sj.parse_station_list(doc(spark, recs), cap=1).collect()] == ["ccc"]


def test_fluxes_and_temperature(spark):
    recs = [{"time_tag": "2024-01-01T00:00:00Z", "energy": ">=2 MeV", "flux": 5.0}, {"time_tag": "2024-01-01T00:05:00Z", "energy": ">= 2 MeV", "flux": 9.0}, {"time_tag": "2024-01-01T00:05:00Z", "energy": ">=800 keV", "flux": 3.0}, {"time_tag": "2024-01-02T00:00:00Z", "energy": ">=2 MeV", "flux": -1.0}]
    r = sj.parse_electron_flux(doc(spark, recs)).collect()
    assert [(x.date, x.electron_2mev_max, x.electron_800kev_max) for x in r] == [("2024-01-01", 9.0, 3.0)]
    lst = {"subset": [{"band": "LST_Day_1km", "calendar_date": "2024-01-01", "data": [0, 65535, 14000, 1000]}, {"band": "QC", "calendar_date": "2024-01-01", "data": [14000]}]}
    assert [x.lst_k for x in sj.parse_land_temperature(doc(spark, lst)).collect()] == [280.0]
    fl = [{"begin_time": "a", "max_time": "2024-01-01T01:00:00Z", "end_time": "b", "max_class": "M1.2", "max_xrlong": 1.2e-5}, {"max_time": ""}]
    assert [x.max_class for x in sj.parse_flares(doc(spark, fl)).collect()] == ["M1.2"]


def test_space_weather_sentinels(spark):
    row = ["2024", "32", "5"] + ["0"] * 10 + ["9999.99"] + ["0"] * 9 + ["400.1", "999.9", "0", "0", "2.5"] + ["0"] * 12 + ["-30"]
    r = st.parse_hourly_space_weather(lines(spark, " ".join(row) + "\nshort line\n")).select(F.date_format("observed_at", "yyyy-MM-dd HH").alias("t"), "*").collect()
    assert len(r) == 1 and (r[0].t, r[0].bz, r[0].speed, r[0].density, r[0].pressure, r[0].dst) == ("2024-02-01 05", None, 400.1, None, 2.5, -30.0)
    late = st.parse_hourly_space_weather(lines(spark, " ".join(row)), F.lit("2024-01-01").cast("timestamp"))
    assert late.count() == 0
    p = ["2024", "1", "0"] + ["0"] * 24 + ["0.5", "0", "99999.99"]
    assert [(x.p10, x.p60) for x in st.parse_proton_flux(lines(spark, " ".join(p))).collect()] == [(0.5, None)]


def test_earth_rotation(spark):
    r = st.parse_earth_rotation(lines(spark, "# head\n2024 1 2 60311 0.1 0.2 -0.01 0.0005\n1999 1 1 1 1 1 1 1\n2024 1 x 1 1 1 1 1")).collect()
    assert len(r) == 1 and str(r[0].date) == "2024-01-02" and r[0].lod == pytest.approx(0.5)
    fixed = lambda flag: f"24 1 2 60311.00 {flag}  0.123456".ljust(37) + " 0.234567".ljust(21) + "-0.0100000".ljust(21) + " 0.5000".ljust(9)
    r = st.parse_rotation_bulletin(lines(spark, fixed("I") + "\n" + fixed("P"))).collect()
    assert len(r) == 1 and str(r[0].date) == "2024-01-02" and r[0].y == pytest.approx(0.234567) and r[0].lod == pytest.approx(0.5)


def test_series_texts(spark):
    r = st.parse_neutron_counts(lines(spark, "#c\nstart_date_time;X\n2024-01-01 12:00:00;100.1\n2024-01-02 12:00:00;null")).collect()
    assert [(x.date, x.counts) for x in r] == [("2024-01-01", 100.1)]
    r = st.parse_wide_kp(lines(spark, "# h\n2024 1 1 0 0 0 0 1 2 3 4 5 6 7 x 9")).select(F.hour("time_tag").alias("h"), "kp").collect()
    assert sorted((x.h, x.kp) for x in r) == [(0, 1.0), (3, 2.0), (6, 3.0), (9, 4.0), (12, 5.0), (15, 6.0), (18, 7.0)]
    r = st.parse_observatory_minutes(lines(spark, " Format X |\nDATE TIME DOY A B C D |\n2024-01-01 00:01:00.000 001 30000.1 99999.00 88888.00 46000.0\nbad"), "KAK").collect()
    assert len(r) == 1 and (r[0].h, r[0].d, r[0].z, r[0].f_total) == (30000.1, None, None, 46000.0)
    r = st.parse_buoy(lines(spark, "#YY MM\n24 01 02 03 04 0 1 5000.5\n99 01 02 03 04 0 1 9999.0\n1998 01 02 03 04 0 2 12.5\n24 13 02 03 04 0 1 5.0")).select(F.year("observed_at").alias("y"), "water_height_m").collect()
    assert sorted((x.y, x.water_height_m) for x in r) == [(1998, 12.5), (2024, 5000.5)]


def test_csv_texts(spark, tmp_path):
    r = st.parse_sea_level_csv(lines(spark, "time,sea_level,latitude,longitude\nUTC,mm,deg,deg\n2024-06-01T00:00:00Z,1200,35,139\n2024-06-01T01:00:00Z,-99999,35,139\n2024-06-01T02:00:00Z,NaN,35,139")).collect()
    assert [x.sea_level_mm for x in r if x.sea_level_mm == x.sea_level_mm] == [1200.0]
    assert [x.station_id for x in st.parse_station_csv(lines(spark, "name,id,lat,lon\n,,deg,deg\nA,7,1,2")).collect()] == [7]
    r = st.grid_csv_cells(lines(spark, "time,latitude,longitude,sm\nUTC,d,d,m\n2024-01-01T00:00:00Z,30.5,130.5,0.2\n2024-01-01T00:00:00Z,31.5,131.5,0.4\n2024-01-01T00:00:00Z,31.5,131.5,9\n2024-01-01T00:00:00Z,31.5,131.5,NaN"), 0.0, 1.0).collect()
    assert [(x.cell_lat, x.cell_lon, x.value, x.n) for x in r] == [(31.0, 131.0, 0.3, 2)]
    (tmp_path / "ev.csv").write_text("time,latitude,longitude,mag,x\n2024-01-01T00:00:00Z,35,140,5.1,a\nbad,1,2,3,b\n")
    assert st.read_event_csv(spark, str(tmp_path / "ev.csv")).count() == 1
    (tmp_path / "tr.csv").write_text("individual_id,timestamp,location_lat,location_long\na,t1,1.5,2.5\nb,t2,0,2\nc,,1,2\n")
    assert [x.individual_id for x in st.read_tracking_csv(spark, str(tmp_path / "tr.csv")).collect()] == ["a"]
    (tmp_path / "st.csv").write_text("id,name\n12,owl\nx,y\n")
    assert [x.id for x in st.read_study_csv(spark, str(tmp_path / "st.csv")).collect()] == [12]
    (tmp_path / "fx.csv").write_text("time,E2_flux\n2024-01-01T00:00,3\n2024-01-01T01:00,8\n2024-01-02T00:00,-1\n")
    assert [(x.date, x.electron_2mev_max) for x in st.read_flux_csv(spark, str(tmp_path / "fx.csv")).collect()] == [("2024-01-01", 8.0)]


def test_position_document(spark):
    d = "+SITE\n ID          940001\n J_NAME      Wakkanai\n-SITE\n+DATA\n*yyyy mm dd\n 2024 01 02 12:00:00 1.0 2.0 3.0 45.1 141.7 70.2\n bad line\n-DATA\n 2024 01 03 12:00:00 1 2 3 4 5 6\n"
    r = st.parse_position_document(doc(spark, d)).collect()
    assert len(r) == 1 and (r[0].station_id, r[0].station_name, r[0].height) == ("940001", "Wakkanai", 70.2)


def test_moment_tensors(spark):
    rec = lambda lat, dip: "\n".join(["PDE 2024/01/01 07:10:09.5  37.49 137.27  10.0 0.0 7.5 NOTO", "C202401010710A B:1", f"CENTROID:  10.0 0.1 {lat} 0.01 137.20 0.01 12.0 0.5 FREE S-2024", "27 1 2 3 4 5 6 7 8 9 10 11 12", f"V10 1 2 3 4 5 6 7 8 9 2.000 47 {dip} 99 213 54 81"])
    r = st.parse_moment_tensors(doc(spark, rec("37.60", "37") + "\n" + rec("10.0", "37") + "\n" + rec("37.60", "97") + "\n")).collect()
    assert len(r) == 1 and r[0].event_id == "C202401010710A" and (r[0].strike1, r[0].dip1, r[0].rake2, r[0].depth_km) == (47.0, 37.0, 81.0, 12.0)
    assert r[0].magnitude == pytest.approx(round(2 / 3 * np.log10(2e20) - 6.07, 1))


def test_ionosphere_maps(spark):
    head = "    -2                                                      EXPONENT\n                                                            END OF HEADER\n"
    band = lambda lat, vals: f"{lat:8.1f}{-180.0:6.1f}{180.0:6.1f}{5.0:6.1f}{450.0:6.1f}".ljust(60) + "LAT/LON1/LON2/DLON/H\n" + "\n".join(" ".join(f"{x:4d}" for x in vals[i:i + 16]) for i in range(0, 73, 16)) + "\n"
    vals = [9999 if i == 64 else 100 + i for i in range(73)]
    d = head + "     1      START OF TEC MAP\n  2024     1     1     2     0     0                        EPOCH OF CURRENT MAP\n" + band(87.5, [1] * 73) + band(35.0, vals) + band(32.5, [7] * 73) + "     1      END OF TEC MAP\n"
    r = st.parse_ionosphere_maps(doc(spark, d)).collect()
    got = {(x.lat, x.lon): x.tec for x in r}
    assert (35.0, 140.0) not in got and got[(35.0, 135.0)] == pytest.approx(1.63) and got[(32.5, 140.0)] == pytest.approx(0.07)
    assert {x.lat for x in r} == {35.0, 32.5} and len(got) == 2 * 8 - 1 and str(r[0].epoch)[:13] in ("2024-01-01 02",)


def test_ionosphere_map_with_a_long_line(spark):
    band = f"{35.0:8.1f}{-180.0:6.1f}{180.0:6.1f}{5.0:6.1f}{450.0:6.1f}".ljust(60) + "LAT/LON1/LON2/DLON/H\n" + " ".join(["7"] * 73) + "\n"
    d = "START OF TEC MAP\n  2024     1     1     2     0     0   EPOCH\n" + band + "x" * 200_000 + "\n     1      END OF TEC MAP\n"
    start = time.time()
    r = st.parse_ionosphere_maps(doc(spark, d)).collect()
    assert len(r) == 8 and time.time() - start < 15  # the pattern for the end mark took the square of the line
    assert len(st.parse_ionosphere_maps(doc(spark, d.split("x")[0])).collect()) == 8  # without an end mark the rest counts


def test_array_text(spark):
    d = "Dataset: a\nColumnX.ColumnX[1][2][3]\nColumnX[0][5], 0.5, -1.2676506e+30, 1.25\nColumnX[0][6], , 2, 3\n"
    r = {(x.lat, x.lon): x.value for x in st.parse_array_text(doc(spark, d), "ColumnX", 30.0, 130.0).collect()}
    assert r == {(31.25, 130.0): 0.5, (31.25, 130.5): 1.25, (31.5, 130.25): 2.0, (31.5, 130.5): 3.0}


def test_tensor_and_predictions(spark):
    r = sj.parse_feature_tensor(doc(spark, {"tensor": [[[[1, 2], [3, 4]]], [[[5, 6], [7, 8]]]]})).collect()
    assert {(x.t, x.i, x.j): x.features for x in r}[(1, 0, 1)] == [7.0, 8.0] and len(r) == 4
    r = sj.parse_predictions(doc(spark, {"predictions": [{"cell_lat": 36.0, "cell_lon": 140.0, "t_days": 9.0, "prob": 0.2, "label": 1}]})).collect()
    assert r[0].prob == 0.2 and r[0].label == 1


def test_binary_grids(spark, tmp_path):
    for day, add in (("20240101", 0.0), ("20240102", 10.0)):
        g = np.arange(20.0).reshape(4, 5) + add
        g[1, 1], g[3, 3] = -999, np.nan
        buf = io.BytesIO()
        np.save(buf, g)
        (tmp_path / f"grid_{day}.npy").write_bytes(buf.getvalue())
    df = sb.decode_grid(spark, str(tmp_path / "*.npy"), lat0=30, lon0=130, fill=-999, scale=2.0, bbox=(30, 32, 131, 140))
    r = {(x.path[-12:-4], x.lat, x.lon): x.value for x in df.collect()}
    assert ("20240101", 31.0, 131.0) not in r and r[("20240101", 30.0, 131.0)] == 2.0 and r[("20240102", 32.0, 134.0)] == 48.0 and len(r) == 2 * (3 * 4 - 1)
    assert {(x.date, x.value_max) for x in sb.daily_max(df).collect()} == {("2024-01-01", 28.0), ("2024-01-02", 48.0)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_seismic_samples(spark, tmp_path, order):
    head = bytearray(632)
    struct.pack_into(f"{order}f", head, 0, 0.01)
    struct.pack_into(f"{order}f", head, 31 * 4, 36.5)
    struct.pack_into(f"{order}f", head, 32 * 4, 140.25)
    struct.pack_into(f"{order}i", head, 304, 6)
    struct.pack_into(f"{order}i", head, 316, 4)
    (tmp_path / "a.sac").write_bytes(bytes(head) + np.array([1, 2, 3, 4], dtype=f"{order}f4").tobytes())
    (tmp_path / "b.sac").write_bytes(b"short")
    r = sb.read_waveforms(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].samples == [1.0, 2.0, 3.0, 4.0] and r[0].fs == pytest.approx(100.0, rel=1e-6) and (r[0].lat, r[0].lon) == (36.5, 140.25)


@pytest.mark.parametrize("parse,splits", [(st.parse_earth_rotation, 1), (st.parse_wide_kp, 1), (st.parse_position_document, 2)])
def test_fields_and_dates_are_evaluated_once(spark, parse, splits):
    """Filters on fields used to repeat the split, the line below it and the date for every field they look at."""
    lines = spark.range(3).selectExpr("concat_ws(' ', 2020, 1, id, 'x') AS value")
    plan = parse(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == splits and plan.count("gettimestamp(") == 1


def test_odd_lines_are_dropped_and_null_lines_too(spark):
    lines = ["2020 1 2 5 0.1 0.2 0.3 0.004", "  2020   1  3   5 0.1 0.2 0.3 0.004 x ", "# 2020 1 2 5 1 1 1 1", "", "   ", "2020 1 2 5 0.1 0.2 0.3", "2020 13 2 5 1 1 1 1", "2020 1 2 5 - 1 1 1", "x 1 2 5 1 1 1 1", "2010 1 2 5 1 1 1 1", None]
    got = st.parse_earth_rotation(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((str(r["date"]), r["x"], r["lod"]) for r in got) == [("2020-01-02", 0.1, 4.0), ("2020-01-03", 0.1, 4.0)]
