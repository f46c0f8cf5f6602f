"""A table of newest rows per key that batches are merged into, rewriting only the buckets they touch.

Rows lie in folders by (version, bucket of the key's hash). A manifest per version names the folder of every bucket; a version counts once its
manifest is complete, and readers take the newest complete one, so they never see half a merge. What a batch writes follows the
buckets it touches: choose `buckets` so that one of them is a small part of the table. Folders of old versions stay for readers that still use them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

c, lit = F.col, F.lit


class BucketedTable:
    """Per key the row of the largest `order` values (null lowest); of equal ones that with the largest remaining columns."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.order, self.buckets = spark, root, schema, list(keys), list(order), buckets
        self.columns = schema.fieldNames()

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [x for x in self.columns if x not in self.keys and x not in self.order]
        held = rows.groupBy("_bucket", *self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("_m"))
        return held.select("_bucket", *[c(x) if x in self.keys else c(f"_m.{x}").alias(x) for x in self.columns])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), lit(self.buckets)).cast("int"))

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it; at most one entry per bucket."""
        known = self.versions()
        at = version if version is not None else (known[-1] if known else None)
        if at is None:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.root}/manifest/{at}").collect()}

    def _rows(self, folders: dict[int, int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{v}/bucket={b}" for b, v in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def merge(self, rows: DataFrame, version: int) -> list[int]:
        """Merge a batch as `version`; returns the buckets written. Nothing happens if the version is complete already."""
        known = self.versions()
        if version in known:
            return []
        before = self.manifest(max((v for v in known if v < version), default=None)) if any(v < version for v in known) else {}
        new = self._newest(self._bucketed(rows)).persist()
        try:
            touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most `buckets`
            old = self._bucketed(self._rows({b: v for b, v in before.items() if b in set(touched)}))
            both = self._newest(old.unionByName(new).repartition("_bucket"))
            both.withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{version}")
        finally:
            new.unpersist()
        after = {**before, **{b: version for b in touched}}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")
        return touched
