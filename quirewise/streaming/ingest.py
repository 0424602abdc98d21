"""New files or rows arriving over time, appended to a document table exactly once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name
from ..library import Library
from ..operators.ingest import decode_uploads
from ..operators.keys import insert_if_absent
from ..session import materialize

BATCH = "batch_id"


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table so far; empty before the first batch."""
    table = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], table)
    return spark.read.schema(table).parquet(path)


def append_new_keys(target: str, rejects: str, keys: Sequence[str], order_by: Sequence[str]):
    """A ``foreachBatch`` writer: keep-first inside the batch, refuse keys already in the table.

    Rows equal under ``order_by`` are told apart by their number in the written-out batch.

    Each batch overwrites its own ``batch_id`` partition and compares with earlier batches
    only, so a batch replayed after a failure writes the same rows again instead of more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _stored(spark, target, batch.schema).filter(F.col(BATCH) < batch_id)
        rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()), "arrived")
        checked = materialize(insert_if_absent(earlier, rows, keys, [*order_by, "_row"]).drop("_row"), "checked")
        for path, rows in (
            (target, checked.filter("error is null").drop("error")),
            (rejects, checked.filter("error is not null")),
        ):
            rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def ingest_stream(
    arriving: DataFrame, target: str, rejects: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """Process everything that has arrived, in batches, then stop; call again for later files."""
    (
        arriving.writeStream.foreachBatch(append_new_keys(target, rejects, keys, order_by))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def ingest_keyed(
    arriving: DataFrame, target: str, rejects: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """As ``ingest_stream``, with the ids kept as streaming state: a micro-batch reads nothing of the table it adds to.

    The state is that of ``dropDuplicates`` over the keys, text keys as SHA-256 digests: it tells which keys of a micro-batch are
    new (set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB one where keys outgrow memory). It commits with its
    batch, so a replay decides as before and writes its own ``batch_id`` partition again. Of a new key's rows the first under
    ``order_by`` is taken. The table must begin with this query. A row without a key is refused.
    """
    texts = {f.name for f in arriving.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))}
    short = {f"_key{i}": F.unhex(F.sha2(F.col(f"`{k}`").cast("binary"), 256)) if k in texts else F.col(f"`{k}`") for i, k in enumerate(keys)}
    rows = arriving.withColumns(short)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in short])
    fresh = rows.filter(keyed).select(*short).dropDuplicates(list(short)).withColumn("_fresh", F.lit(True))
    both = rows.withColumn("_fresh", F.lit(False)).unionByName(fresh, allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(batch.withColumn("_row", F.monotonically_increasing_id()), "arrived")
        given = arrived.filter("not _fresh").drop("_fresh")
        known = given.select(*short).distinct().join(arrived.filter("_fresh").select(*short), list(short), "left_anti")
        checked = insert_if_absent(known, given, list(short), [*order_by, "_row"])
        checked = materialize(checked.select(*arriving.columns, "error"), "decided")
        checked.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        checked.filter("error is not null").write.mode("overwrite").parquet(f"{rejects}/{BATCH}={batch_id}")

    (
        both.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files under ``path`` (a folder or a glob) as a stream, new ones picked up as they appear."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def upload_stream(
    library: Library, path: str, user_id: str, checkpoint: str, pattern: str = "*", files_per_batch: int | None = None
) -> None:
    """Upload every new file under ``path`` into the library, then stop; call again for later files.

    Each micro-batch is one named library batch, so a replay replaces what it wrote before.
    """
    spark = library.spark
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        files = batch.select("path", base_name("path").alias("file"), "content")
        library.add(decode_uploads(files, user_id), f"stream-{stream_name}-{batch_id}")

    (
        reader.load(path)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
