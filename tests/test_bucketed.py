"""Merges write the buckets of the batch only, count once complete, and can be repeated."""

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from tremolite.operators import bucketed as bk, sinks as sk

SCHEMA = "key long, at long, level double, note string"


def table(spark, buckets=16):
    return bk.BucketedTable(spark, sk.scratch(spark, "bucketed"), spark.createDataFrame([], SCHEMA).schema, ["key"], ["at"], buckets)


def rows(spark, data):
    return spark.createDataFrame([(k, at, float(x), None) for k, at, x in data], SCHEMA)


def held(t):
    return {r["key"]: (r["at"], r["level"]) for r in t.read().collect()}


def written(t, version):
    return {os.path.basename(p) for p in glob.glob(f"{t.root.removeprefix('file:')}/data/{version}/bucket=*")}


def test_merge_equals_newest_of_all(spark):
    t = table(spark)
    base = [(k, 10 + k % 3, k) for k in range(500)]
    t.merge(rows(spark, base), 0)
    late = [(k, 5 if k % 2 else 20, -k) for k in range(0, 500, 7)] + [(None, 1, 4.0)]
    t.merge(rows(spark, late), 1)
    want = pd.DataFrame(base + late, columns=["key", "at", "level"]).sort_values("at").groupby("key", dropna=False).last()
    assert {k: v for k, v in held(t).items() if k is not None} == {int(k): (int(v["at"]), float(v["level"])) for k, v in want.iterrows() if k == k}
    assert held(t)[None] == (1, 4.0)


def test_small_batch_writes_few_buckets(spark):
    t = table(spark)
    t.merge(rows(spark, [(k, 1, k) for k in range(2000)]), 0)
    assert len(written(t, 0)) == 16
    touched = t.merge(rows(spark, [(3, 2, 0), (3, 3, 1)]), 1)
    assert len(touched) == 1 and written(t, 1) == {f"bucket={touched[0]}"}
    assert held(t)[3] == (3, 1.0) and len(held(t)) == 2000
    assert len(t.read(0).collect()) == 2000 and t.read(0).where("key = 3").first()["level"] == 3.0  # older readers keep their version


def test_repeat_and_broken_merge(spark):
    t = table(spark)
    t.merge(rows(spark, [(1, 1, 1), (2, 1, 2)]), 0)
    # files of a merge that was lost before its manifest are not seen, and its repetition replaces them
    rows(spark, [(1, 9, 99)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{t.root}/data/1")
    assert held(t) == {1: (1, 1.0), 2: (1, 2.0)}
    t.merge(rows(spark, [(1, 2, 5)]), 1)
    assert held(t) == {1: (2, 5.0), 2: (1, 2.0)}
    assert t.merge(rows(spark, [(1, 7, 7)]), 1) == [] and held(t)[1] == (2, 5.0)
    t.merge(rows(spark, []), 2)
    assert held(t) == {1: (2, 5.0), 2: (1, 2.0)} and t.versions() == [0, 1, 2]


def test_empty_table_reads_empty(spark):
    assert table(spark).read().count() == 0
