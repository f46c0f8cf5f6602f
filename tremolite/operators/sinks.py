"""Table writes with natural keys. Tables are Parquet folders; a rewrite goes to a new folder and readers switch to it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_root

c, lit = F.col, F.lit


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: for tables that several fits or scores read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*keys, *[c(f"_m.{x}").alias(x) for x in rest])


def new_keys(new: DataFrame, old: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows an append may add: the first per key, and only keys the table does not hold."""
    return first_per_key(new, keys, order).join(old.select(*keys), list(keys), "left_anti").select(*new.columns)


def append_new(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append with first-row-wins on the key; running it twice adds nothing the second time."""
    spark = new.sparkSession
    add = new_keys(new, spark.read.parquet(path), keys, order)
    w = add.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New keys are added, `update` columns of known keys take the newest new value, the rest stay."""
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*[x for x in new.columns if x not in keys]), F.struct(*order)).alias("_n"))
    j = old.join(latest, list(keys), "full_outer")
    cols = []
    for x in old.columns:
        if x in keys:
            cols.append(c(x))
        elif x in update:
            cols.append(F.coalesce(c(f"_n.{x}"), c(x)).alias(x))
        else:
            cols.append(F.coalesce(c(x), c(f"_n.{x}")).alias(x))
    return j.select(*cols)


def bump_counters(ledger: DataFrame, attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failure ledger plus new failures: counts add up, the latest time wins."""
    both = ledger.unionByName(attempts)
    return both.groupBy(*keys).agg(F.sum("retry_count").alias("retry_count"), F.max("last_failed").alias("last_failed"))


def retain(df: DataFrame, t: str, horizon) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of deleted rows) for a retention horizon."""
    return df.where(c(t) >= horizon), df.agg(F.count_if(c(t) < horizon).alias("deleted"))


def delete_matching(df: DataFrame, condition: Column, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(preview counts per group, table without the matching rows)."""
    hit = F.coalesce(condition, lit(False))
    return df.where(hit).groupBy(*by).agg(F.count(lit(1)).alias("n")), df.where(~hit)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become NULL."""
    out = []
    for f in df.schema.fields:
        x = c(f.name)
        if f.dataType.typeName() in ("double", "float"):
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(f.name)
        out.append(x)
    return df.select(*out)


def export_json(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("overwrite").option("compression", "gzip").json(path)


def export_xml_lines(df: DataFrame, path: str, row_tag: str = "Cell") -> None:
    """One XML element per row, written as text in parallel."""
    df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row_tag}).alias("value")).write.mode("overwrite").text(path)


def export_xml(df: DataFrame, path: str, row_tag: str = "Cell", root_tag: str = "Forecast") -> None:
    """Well-formed XML parts: one element per row, its columns as attributes."""
    df.select(*[c(x).alias(f"_{x}") for x in df.columns]).write.mode("overwrite").format("xml").options(rowTag=row_tag, rootTag=root_tag, attributePrefix="_").save(path)


def read_xml(spark: SparkSession, path: str, schema: str, row_tag: str = "Cell") -> DataFrame:
    """Elements written by `export_xml` as rows of `schema` (column definitions of plain types, comma-separated); elements that do not parse are an error."""
    fields = [x.split() for x in schema.split(",")]
    rows = spark.read.format("xml").schema(", ".join(f"_{n} {t}" for n, t in fields)).options(rowTag=row_tag, attributePrefix="_", mode="FAILFAST").load(path)
    return rows.select(*[c(f"_{n}").alias(n) for n, _ in fields])


def export_tables(tables: dict[str, DataFrame | None], root: str) -> list[str]:
    """Write the named tables; a missing one is skipped and reported by absence."""
    done = []
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            done.append(name)
    return done


def report_rows(metrics: DataFrame, group: Sequence[str]) -> DataFrame:
    """Wide metrics to (metric, group, value) rows."""
    vals = [x for x in metrics.columns if x not in group]
    long = metrics.select(F.concat_ws("|", *[c(g).cast("string") for g in group]).alias("grp"), *[c(x).cast("double").alias(x) for x in vals])
    return long.unpivot(["grp"], vals, "metric", "value")


def dense_vectors(df: DataFrame, grid: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Zero-filled feature vectors for every key of the grid."""
    j = grid.join(df.select(*keys, *values), list(keys), "left")
    return j.select(*keys, F.array(*[F.coalesce(c(x).cast("double"), lit(0.0)) for x in values]).alias("features"))


def overlay(base: DataFrame, newer: DataFrame) -> DataFrame:
    """The newer copy when it did not shrink, else the base; the choice is made in the plan."""
    n0, n1 = base.select(F.count(lit(1))).scalar(), newer.select(F.count(lit(1))).scalar()
    return newer.where(n1 >= n0).unionByName(base.where(n1 < n0))
