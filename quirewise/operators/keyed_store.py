"""A table at rest that knows where a key would be: bucketed folders, with a Bloom filter of the key in every file.

``KeyedStore`` writes rows partitioned by a hash of their key, sorted by it. An insert looks only into the
buckets that its batch has keys for, and there only at the key columns; what the batch does not ask for is left out by the files'
statistics and Bloom filters, or by the join with the batch's keys where the rows lie. Batches add files; a repeated batch
replaces its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .keys import insert_if_absent
from .tables import keep_latest

BUCKET, BATCH = "key_bucket", "batch"
#: Distinct keys of a batch up to which they are also pushed into the scan, past statistics and Bloom filters.
MAX_PUSHED_KEYS = 10_000


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 256):
        """``buckets`` is fixed for the life of a store."""
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _files(self) -> DataFrame:
        table = T.StructType([*self.schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], table)
        return self.spark.read.schema(table).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().select(*self.schema.names)

    def near(self, batch: DataFrame, except_batch: str = "") -> DataFrame:
        """The key columns of the stored rows whose keys the written ``batch`` may hold: only its buckets are opened."""
        asked = batch.select(*self.keys, self._bucket())
        opened = [r[0] for r in asked.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        rows = self._files().filter(F.col(BUCKET).isin(opened) & (F.col(BATCH) != except_batch))
        first = self.keys[0]
        some = [r[0] for r in asked.select(first).distinct().limit(MAX_PUSHED_KEYS + 1).collect()]
        if len(some) <= MAX_PUSHED_KEYS:
            rows = rows.filter(F.col(first).isin([x for x in some if x is not None]))
        return rows.select(*self.keys)

    def insert(self, batch: DataFrame, name: str, order_by: Sequence[str]) -> DataFrame:
        """Add the rows of new keys as the batch ``name``; returns the refused rows with ``error``.

        Of a key that comes more than once the first row under ``order_by`` is taken; equal ones are told apart by their place.
        """
        rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()), "arrived")
        checked = insert_if_absent(self.near(rows, name), rows, self.keys, [*order_by, "_row"]).drop("_row")
        checked = materialize(checked, "checked")
        self._write(checked.filter("error is null").drop("error"), name)
        return checked.filter("error is not null")

    def upsert(self, batch: DataFrame, name: str, order_by: Sequence[str]) -> None:
        """Add the last row of each key as the batch ``name``, whether the key is stored or not; ``latest`` reads the newest."""
        self._write(keep_latest(batch, self.keys, order_by), name)

    def latest(self, order_by: Sequence[str]) -> DataFrame:
        """The last written row of every key."""
        return keep_latest(self.read(), self.keys, order_by)

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.select(*self.schema.names, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        writer = placed.write.partitionBy(BUCKET).mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true")
        writer.parquet(f"{self.path}/{BATCH}={name}")
