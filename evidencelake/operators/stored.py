"""Tables stored by key, of which a change reads and writes only the buckets that it touches (B-13, B-15, J-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.scratch import drop_table, materialize, remove

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class StoredTable:
    """A Parquet table below ``path`` with one row for each ``key``, in folders by a hash of the key.

    Changes are counted as ``change, n`` (``inserted``, ``updated``, ``deleted``; only those that occur). A change that is made again leaves the table as it
    is. New rows are written beside the old ones and swapped bucket by bucket, so a change that fails halfway can simply be repeated. A null key is a key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def read(self) -> DataFrame:
        """All rows."""
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).drop("bucket")

    def create(self, rows: DataFrame) -> None:
        """Writes the table anew."""
        self._placed(rows).write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets)).repartition("bucket")

    def _some(self, touched: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")

    def _swap(self, new: DataFrame, touched: list[int]) -> DataFrame:
        """The touched buckets hold ``new`` from now on."""
        kept = materialize(self._placed(new), "stored")
        old = self._some(touched)
        columns = [c for c in new.columns if c != self.key]
        before = old.select(F.col(self.key).alias("__old"), F.struct(*columns).alias("__a"), F.lit(1).alias("__in_old"))
        after = kept.select(F.col(self.key).alias("__new"), F.struct(*columns).alias("__b"), F.lit(1).alias("__in_new"))
        both = before.join(after, F.col("__old").eqNullSafe(F.col("__new")), "full")
        kind = F.when(F.col("__in_old").isNull(), "inserted").when(F.col("__in_new").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "updated")
        counted = both.groupBy(kind.alias("change")).agg(F.count("*").alias("n")).where("change is not null").collect()  # three rows at most
        if counted:
            left = {r.bucket for r in kept.select("bucket").distinct().collect()}  # one row a bucket
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            for k in touched:
                if k not in left:  # an overwrite of partitions leaves those alone that have no rows any more
                    remove(self.spark, f"{self.path}/bucket={k}")
        drop_table(kept)
        return self.spark.createDataFrame([tuple(r) for r in counted], "change string, n long")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.k for r in rows.select(bucket_of(F.col(self.key), self.buckets).alias("k")).distinct().collect())  # one row a bucket

    def upsert(self, updates: DataFrame, order: str) -> DataFrame:
        """B-15: for each key of ``updates`` (the table's columns, a null leaves a field as it is) its latest row by ``order`` is merged into the table's own, or added."""
        touched = self._touched(updates)
        fields = [c for c in updates.columns if c != self.key]
        latest = updates.groupBy(self.key).agg(F.max_by(F.struct(*fields), F.struct(order, *[c for c in fields if c != order])).alias("__u"))
        old = self._some(touched).select(F.col(self.key).alias("__key"), F.struct(*fields).alias("__o"))
        both = latest.join(old, F.col(self.key).eqNullSafe(F.col("__key")), "full")
        newer = F.col("__u").isNotNull() & (F.col(f"__o.{order}").isNull() | (F.col(f"__u.{order}") >= F.col(f"__o.{order}")))
        value = lambda c: F.when(newer, F.coalesce(F.col(f"__u.{c}"), F.col(f"__o.{c}"))).otherwise(F.col(f"__o.{c}")).alias(c)
        return self._swap(both.select(F.when(F.col("__u").isNotNull(), F.col(self.key)).otherwise(F.col("__key")).alias(self.key), *[value(c) for c in fields]), touched)

    def delete(self, keys: DataFrame) -> DataFrame:
        """J-13, B-15: the rows of ``keys`` go; unknown keys change nothing."""
        touched = self._touched(keys)
        gone = keys.select(F.col(self.key).alias("__gone")).distinct()
        return self._swap(self._some(touched).join(gone, F.col(self.key).eqNullSafe(F.col("__gone")), "left_anti"), touched)

    def retain(self, time: str, cutoff: str) -> DataFrame:
        """B-13: rows older than ``cutoff`` go; only buckets that have such rows are written. Rows without a time stay."""
        old = F.col(time) < F.lit(cutoff).cast("timestamp")
        touched = self._touched(self.read().where(old))
        return self._swap(self._some(touched).where(~F.coalesce(old, F.lit(False))), touched)
