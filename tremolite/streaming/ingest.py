"""Stream building blocks. Every function takes and returns DataFrames; `run_available` drains what is there and stops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import physics as ph
from ..operators.sinks import scratch

c, lit = F.col, F.lit


def landed(spark: SparkSession, folder: str, table: str, files_per_batch: int = 64) -> DataFrame:
    """File stream over one landed Parquet table, a file or a folder of parts; the schema is read once from the files."""
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def dedup(stream: DataFrame, keys: Sequence[str], ts: str, horizon: str) -> DataFrame:
    """First row per natural key; keys are remembered for `horizon` and older rows are dropped as late."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, keys: Sequence[str], ts: str, width: str, value: str, late: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return g.select(F.unix_seconds("window.start").alias("bucket"), *keys, "n", "mean_value")


def sliding_b(stream: DataFrame, ts: str, mag: str, width: str, hop: str, late: str, min_n: int = 10) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width, hop)).agg(F.count(mag).alias("n"), F.avg(mag).alias("m"), F.min(mag).alias("lo"))
    return g.select(F.unix_seconds("window.start").alias("start"), "n", ph.b_min(c("n"), c("m"), c("lo"), min_n).alias("b_value"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str, value: str, late: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(ts).alias("last"))
    return g.select(key, F.unix_micros("session_window.start").alias("t_start"), F.unix_micros("last").alias("t_end"), "n", "mean_value")


def enrich(stream: DataFrame, static: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream-static join; the static side is planned by its size."""
    return stream.join(static, list(on), "left")


def follow_up(alarms: DataFrame, targets: DataFrame, key: str, hours: int, late: str) -> DataFrame:
    """Alarm rows with a target of the same key in [t, t + hours]; both sides are bounded by watermark and time range."""
    a = alarms.withWatermark("a_ts", late)
    b = targets.withWatermark("b_ts", late).withColumnRenamed(key, f"b_{key}")
    cond = (c(key) == c(f"b_{key}")) & (c("b_ts") >= c("a_ts")) & (c("b_ts") <= c("a_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return a.join(b, cond, "inner").drop(f"b_{key}")


def rolling_alarms(stream: DataFrame, key: str, order: str, tie: str, value: str, back: int = 72, min_points: int = 6, sigma: float = 2.0) -> DataFrame:
    """Rolling-baseline alarms for batches that come in the order of time (else `in_order.rolling_alarms`): emitted at once; the state of a series is its last `back` values."""
    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values([order, tie])
        past = list(state.get[0]) if state.exists else []
        hist = pd.Series(past + rows[value].tolist(), dtype="float64")
        roll = hist.shift(1).rolling(back, min_periods=min_points)
        mean, std = roll.mean()[len(past):].to_numpy(), roll.std(ddof=0)[len(past):].to_numpy()
        state.update((hist.iloc[-back:].tolist(),))
        z = (rows[value].to_numpy() - mean) / std
        hit = (std >= 1e-10) & (abs(z) >= sigma)
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy()[hit], "sigma": z[hit]})
    name_type = stream.schema[key].dataType.simpleString()
    tie_type = stream.schema[tie].dataType.simpleString()
    return stream.select(key, order, tie, value).groupBy(key).applyInPandasWithState(step, f"{key} {name_type}, {tie} {tie_type}, sigma double", "past array<double>", "append", "NoTimeout")


def counts_since_large(stream: DataFrame, keys: Sequence[str], order: str, tie: str, mag: str, large: float = 5.0) -> DataFrame:
    """Small events since the last large one of each cell, emitted at every large event, for batches in the order of time (else `in_order.counts_since_large`); the state is one counter."""
    keys = list(keys)

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values([order, tie])
        start = state.get[0] if state.exists else 0
        big = (rows[mag] >= large).to_numpy()
        group = big.cumsum() - big
        small = pd.Series(~big).groupby(group).cumsum().to_numpy() + (group == 0) * start
        tail = int((~big)[group == group.max()].sum()) if not big[-1] else 0
        state.update((tail + (start if not big.any() else 0),))
        out = pd.DataFrame({n: v for n, v in zip(keys, k)}, index=range(int(big.sum())))
        out[tie], out["since_last"] = rows[tie].to_numpy()[big], small[big]
        yield out
    kt = ", ".join(f"{x} {stream.schema[x].dataType.simpleString()}" for x in keys)
    return stream.select(*keys, order, tie, mag).groupBy(*keys).applyInPandasWithState(
        step, f"{kt}, {tie} {stream.schema[tie].dataType.simpleString()}, since_last long", "n long", "append", "NoTimeout")


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream"):
    """Drain the stream into Parquet; returns (query, folder). Each row carries the batch it came from."""
    spark = stream.sparkSession
    out, ckpt = scratch(spark, name), scratch(spark, f"{name}-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", lit(batch_id)).write.mode("append").parquet(out)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return q, out


def latest_rows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key from an update-mode run."""
    d = spark.read.parquet(folder)
    rest = [x for x in d.columns if x not in keys and x != "_batch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_m")).select(*keys, *[c(f"_m.{x}").alias(x) for x in rest])


def health(query) -> list[dict]:
    """Per-batch status of a query: rows in, rows dropped as late, duration. A few numbers per batch, from its progress."""
    out = []
    for p in query.recentProgress:
        late = sum(op.get("numRowsDroppedByWatermark", 0) for op in p["stateOperators"])
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "late_rows": late, "ms": p["batchDuration"]})
    return out
