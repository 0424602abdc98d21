"""Which files a folder holds, the empty ones included."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name


def same_path(path: Column) -> Column:
    """One spelling per path: decoded, a single slash after the scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^([A-Za-z0-9+.\-]+):/+", "$1:/")


def empty_files(scan: DataFrame, encoded_path: Column) -> DataFrame:
    """``(path)`` of the zero-length files under a file scan, which the scan itself leaves out.

    The planner's own list of file names is compared with the names the scan yields.
    """
    names = [(re.sub(r"^([A-Za-z0-9+.\-]+):/+", r"\1:/", unquote(p)),) for p in scan.inputFiles()]
    listed = scan.sparkSession.createDataFrame(names, "path string")
    return listed.join(scan.select(same_path(encoded_path).alias("path")), "path", "left_anti")


def _binary(spark: SparkSession, path, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def read_binary(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """``(path, file, content)`` of whole files, empty ones too."""
    scan = _binary(spark, path, pattern)
    empty = empty_files(scan, F.col("_metadata.file_path")).select("path", F.lit(b"").alias("content"))
    return scan.select("path", "content").unionByName(empty).select("path", base_name("path").alias("file"), "content")


def list_files(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """``(path, filename, directory, length)``; file contents are pruned and never read."""
    scan = _binary(spark, path, pattern)
    empty = empty_files(scan, F.col("_metadata.file_path")).select("path", F.lit(0).cast("bigint").alias("length"))
    return (
        scan.select("path", "length")
        .unionByName(empty)
        .select("path", base_name("path").alias("filename"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("directory"), "length")
    )


def read_whole_text(spark: SparkSession, path, pattern: str) -> DataFrame:
    """``(path, content)`` of whole UTF-8 files, empty ones too."""
    scan = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    )
    place = F.col("_metadata.file_path")
    empty = empty_files(scan, place).select("path", F.lit("").alias("content"))
    return scan.select(same_path(place).alias("path"), F.col("value").alias("content")).unionByName(empty)
