"""Sinks, guards, spectral helpers and streaming behaviour."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.functions import spectral as sx
from tremolite.operators import quality as ql, sinks as sk, windows as wn
from tremolite.streaming import ingest as si


def test_append_is_idempotent(spark):
    path = sk.scratch(spark, "t")
    spark.createDataFrame([(1, "old")], "id int, v string").write.parquet(path)
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id int, v string")
    for _ in range(2):
        sk.append_new(new, path, ["id"], ["v"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "old"), (2, "a")]


def test_upsert_and_counters(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, level string, name string")
    new = spark.createDataFrame([(2, "c", "z", 1), (2, "d", "z", 2), (3, "e", "w", 1)], "k int, level string, name string, t int")
    assert sorted(tuple(r) for r in sk.upsert(old, new, ["k"], ["level"], ["t"]).collect()) == [(1, "a", "x"), (2, "d", "y"), (3, "e", "w")]
    led = spark.createDataFrame([("k", 2, 10)], "key string, retry_count long, last_failed long")
    assert [tuple(r) for r in sk.bump_counters(led, spark.createDataFrame([("k", 1, 99)], led.schema), ["key"]).collect()] == [("k", 3, 99)]


@pytest.mark.parametrize("new,old,force,want", [(7776000, 24179040, False, "skip_regression"), (1046, 7311, False, "skip_regression"), (973228, 886626, False, "publish"),
                                                (1000, 2000, False, "publish"), (999, 2000, False, "skip_regression"), (100, 0, False, "publish"), (999, 2000, True, "publish")])
def test_publish_guard(spark, new, old, force, want):
    df = spark.createDataFrame([(new, old, 1)], "rows long, published long, min_rows long")
    assert ql.publish_guard(df, force=force).first()["decision"] == want


def test_regressions(spark):
    s = "table string, rows long, status string"
    before = spark.createDataFrame([("a", 100, "OK"), ("b", 100, "OK"), ("c", 100, "OK"), ("d", 5, "LOW")], s)
    now = spark.createDataFrame([("a", 79, "OK"), ("b", 81, "OK"), ("c", 90, "LOW"), ("d", 500, "OK")], s)
    assert {(r.table, r.kind) for r in ql.regressions(now, before).collect()} == {("a", "rows"), ("c", "status")}


@pytest.mark.parametrize("base,over,want", [([1, 2], [1, 2, 3], 3), ([1, 2], [1], 2), ([1, 2], [], 2), ([1, 2], [3, 4], 2)])
def test_overlay(spark, base, over, want):
    df = lambda x: spark.createDataFrame([(i,) for i in x], "id int")
    got = sorted(r.id for r in sk.overlay(df(base), df(over)).collect())
    assert len(got) == want and got == (sorted(over) if len(over) >= len(base) else base)


def test_json_ready(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert [r.x for r in sk.json_ready(df).collect()] == [None, None, 1.5]


def test_constant_series_has_no_anomaly(spark):
    df = spark.createDataFrame([("s", i, i, 5.0 if i < 30 else 5.0 + (i == 30)) for i in range(40)], "name string, t long, id long, value double")
    assert wn.rolling_anomaly(df, ["name"], "t", ["id"], "value").where("id <= 30").count() == 0


def test_waveform_features(spark):
    t = np.arange(4000) / 100
    wave = np.sin(2 * math.pi * 2 * t)
    rows = [(1, wave.tolist(), wave.tolist(), (0.5 * wave).tolist()), (2, [0.0] * 4000, wave.tolist(), wave.tolist()), (3, [1.0], [1.0], [1.0])]
    df = spark.createDataFrame(rows, "id int, z array<double>, x array<double>, y array<double>")
    r = {x.id: x for x in df.select("id", sx.waveform_features(100.0)("z", "x", "y").alias("f")).select("id", "f.*").collect()}
    assert r[1].rms_z == pytest.approx(1 / math.sqrt(2), rel=1e-3) and r[1].hf_power == pytest.approx(math.log10(0.5 * 2.25), abs=0.01) and r[1].lf_power < -5
    assert r[2].rms_z is None and r[3].rms_z is None


def test_fractal_dimension_and_power():
    rng = np.random.default_rng(0)
    assert sx.higuchi(rng.normal(size=2000))[0] == pytest.approx(2.0, abs=0.1) and sx.higuchi(np.arange(100.0))[0] == pytest.approx(1.0, abs=0.05)
    assert np.isnan(sx.higuchi(np.arange(20.0))).all() and np.isnan(sx.dft_power(np.arange(5.0), 1 / 60, 0.001, 0.1)).all()


def test_stream_state_survives_batches(spark, tmp_path):
    """Rolling alarms over two files, one per batch, equal the batch answer over both."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"name": rng.choice(["a", "b"], 400), "t_us": np.arange(400), "id": np.arange(400), "value": np.round(rng.normal(size=400), 3)})
    schema = "name string, t_us long, id long, value double"
    spark.createDataFrame(pdf[:230], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "f1"))
    spark.createDataFrame(pdf[230:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "f2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q, out = si.run_available(si.rolling_alarms(stream, "name", "t_us", "id", "value", back=20))
    got = {(r.id, round(r.sigma, 6)) for r in spark.read.parquet(out).collect()}
    want = {(r.id, round(r.sigma, 6)) for r in wn.rolling_anomaly(spark.createDataFrame(pdf, schema), ["name"], "t_us", ["id"], "value", back=20).collect()}
    assert len(si.health(q)) >= 2 and got == want and len(got) > 5


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    row = lambda i, ts: spark.createDataFrame([(i, ts)], "k int, ts string").selectExpr("k", "cast(ts as timestamp) AS ts").coalesce(1)
    for i, ts in enumerate(["2024-01-01", "2024-03-01", "2024-03-02", "2024-01-02"]):
        row(i, ts).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q, out = si.run_available(si.dedup(stream, ["k"], "ts", "10 days"))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    assert sum(h["late_rows"] for h in si.health(q)) == 1


def test_stream_of_a_folder(spark, tmp_path):
    """A landed table may be a folder of parts: every part is read, over several batches."""
    from tremolite.streaming import ingest as si
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    q, out = si.run_available(si.landed(spark, str(tmp_path), "events", files_per_batch=1).select("event_id"), name="folder")
    assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == sorted(r[0] for r in events.select("event_id").collect())
    assert len({r[0] for r in spark.read.parquet(out).select("_batch").distinct().collect()}) == 3
    assert sum(h["rows"] for h in si.health(q)) == events.count()


def test_grid_follows_the_catalogue(spark):
    """Cells and steps of the feature grid come from the events, wherever and however long they are."""
    from tremolite.plans import q_joins as qj

    class Views:
        pass
    v = Views()
    v.spark, v.quakes = spark, spark.createDataFrame([(100, 3, -7), (700, 5, 40)], "dn long, ci int, cj int")
    got = qj.base_grid(v).agg({"ci": "min", "cj": "max", "step": "max"}).first()
    assert (got["min(ci)"], got["max(cj)"], got["max(step)"]) == (3, 40, 700)
