"""Rows that come batches late take their place; the result equals the batch job."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.streaming import in_order as so, ingest as si

START = pd.Timestamp("2024-01-01")


def series(n=900, seed=5):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"name": rng.choice(["a", "a", "a", "b"], n), "id": np.arange(n), "sec": rng.integers(0, 20 * 86400, n) // 600 * 600,
                         "value": np.round(rng.normal(50, 10, n), 3)})


def plain_alarms(pdf):
    out = {}
    for _, g in pdf.sort_values(["sec", "id"]).groupby("name"):
        v = g.value.to_numpy()
        for i in range(len(v)):
            base = v[max(0, i - 72):i]
            if len(base) >= 6 and base.std() >= 1e-10 and abs(v[i] - base.mean()) >= 2 * base.std():
                out[int(g.id.iloc[i])] = (v[i] - base.mean()) / base.std()
    return out


def batches(spark, pdf, n):
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("sec") + int(START.timestamp()))).drop("sec")
    return [df.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


@pytest.mark.parametrize("slot", [3600, 86400])
def test_shuffled_batches_equal_the_batch_job(spark, slot):
    pdf = series()
    root = so.land_batches(spark, batches(spark, pdf, 3), "ts", 30, "late")
    out = so.drained(spark, root, lambda s: so.rolling_alarms(s, "name", "ts", "id", "value", "30 days", slot_seconds=slot), "late")
    got = {r["id"]: r["sigma"] for r in out.collect()}
    want = plain_alarms(pdf)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_rows_wait_for_the_watermark(spark):
    """A small horizon: alarms come out batch by batch while the files still arrive in the order of time."""
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("sec") + int(START.timestamp()))).drop("sec")
    day = F.floor((F.unix_seconds("ts") - int(START.timestamp())) / 86400)
    parts = [df.where((day >= 5 * i) & (day < 5 * i + 5)) for i in range(4)]
    root = so.land_batches(spark, parts, "ts", 2, "small")
    with so.state_on_disk(spark):
        _, folder = si.run_available(so.rolling_alarms(si.landed(spark, root, "rows", files_per_batch=1), "name", "ts", "id", "value", "1 day", slot_seconds=3600), name="small")
    rows = spark.read.parquet(folder).collect()
    assert {r["id"] for r in rows} == set(plain_alarms(pdf))
    assert len({r["_batch"] for r in rows}) > 2


def test_counts_with_ties_nulls_and_empty_parts(spark):
    rng = np.random.default_rng(9)
    n = 600
    pdf = pd.DataFrame({"cell": rng.integers(0, 4, n), "id": np.arange(n), "sec": rng.integers(0, 300, n) * 86400, "mag": np.where(rng.random(n) < 0.1, 5.5, 3.5)})
    parts = batches(spark, pdf, 2)
    lost = parts[0].limit(1).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("id", F.lit(10_000).cast("long"))
    root = so.land_batches(spark, [parts[0].unionByName(lost), parts[0].where("false"), parts[1]], "ts", 400, "cells")
    out = so.drained(spark, root, lambda s: so.counts_since_large(s, ["cell"], "ts", "id", "mag", "400 days"), "cells")
    want = {}
    for _, g in pdf.sort_values(["sec", "id"]).groupby("cell"):
        k = 0
        for row in g.itertuples():
            if row.mag >= 5:
                want[row.id], k = k, 0
            else:
                k += 1
    assert {r["id"]: r["since_last"] for r in out.collect()} == want
