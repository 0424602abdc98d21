"""Merging the batches of tables that only grow, and applying the deletions that reads would leave out.

A table is a folder of ``batch=<name>`` folders. Batches are merged in tiers of like size: a batch of tier t is made
of about ``tier ** t`` first ones, and its name says which tier it is of. The merged batch is written under a name that ends in
``.open`` and takes its own name by a rename; only then its parts are removed, whose names it keeps in a ``parts`` file beside
the table. Reads leave out ``.open`` batches, so at every moment each row is read once, but for the moment between
the rename and the removal, which the next compaction finishes first: until then ``parts`` tells reads what to leave out.
"""

from __future__ import annotations

import json
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_checked

if TYPE_CHECKING:
    from ..library import Library

OPEN = ".open"
#: Key column of the tables that deletions apply to.
DELETED_FROM = {"documents": "id", "vectors": "doc_id", "entities": "doc_id"}


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def batches(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))


def unfinished(names: list[str]) -> list[str]:
    """Batches that reads leave out: those still being written."""
    return [n for n in names if n.endswith(OPEN)]


def tier_of(name: str) -> int:
    return int(name.split("-")[0][1:]) if name.startswith("m") and name.split("-")[0][1:].isdigit() else 0


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, place = _folder(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, place = _folder(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


def finish(spark: SparkSession, path: str) -> None:
    """Undo or complete a compaction that broke off: parts of a batch that is in place go, a batch that is not goes."""
    note = f"{path}/_parts"
    for name in unfinished(batches(spark, path)):
        _remove(spark, f"{path}/batch={name}")
    text = _read_text(spark, note)
    if text is not None:
        made = json.loads(text)
        if made["name"] in batches(spark, path):
            for part in made["parts"]:
                _remove(spark, f"{path}/batch={part}")
        _remove(spark, note)


def merge(library: Library, name: str, parts: list[str], tier: int, dead) -> None:
    """One batch of the next tier in place of ``parts``."""
    spark, path = library.spark, f"{library.folder}/{name}"
    rows = library._read(name).filter(F.col("batch").isin(parts)).drop("batch")
    if dead is not None and name in DELETED_FROM:
        gone = (F.col(DELETED_FROM[name]) == F.col("_id")) & (F.col("created_at") <= F.col("_at"))
        rows = rows.join(broadcast_checked(dead), gone, "left_anti")
    made = f"m{tier + 1}-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(f"{path}/batch={made}{OPEN}")
    _write_text(spark, f"{path}/_parts", json.dumps({"name": made, "parts": parts}))
    files, place = _folder(spark, f"{path}/batch={made}{OPEN}")
    files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={made}"))
    finish(spark, path)


def compact(library: Library, tier: int) -> dict[str, int]:
    from ..library import TABLES

    spark, left = library.spark, {}
    for name in TABLES:
        finish(spark, f"{library.folder}/{name}")
    deleted = library._batches("deletions")
    dead = None
    if deleted:
        dead = library._read("deletions").groupBy(F.col("id").alias("_id")).agg(F.max("deleted_at").alias("_at"))
    for name in TABLES:
        if name == "deletions":
            continue
        if dead is not None and name in DELETED_FROM:
            # deletions touch any batch: all of them are rewritten, and then the deletions are done with
            parts = library._batches(name)
            if parts:
                merge(library, name, parts, max(map(tier_of, parts)), dead)
        while True:
            tiers: dict[int, list[str]] = {}
            for batch in library._batches(name):
                tiers.setdefault(tier_of(batch), []).append(batch)
            full = [t for t, found in sorted(tiers.items()) if len(found) >= tier]
            if not full:
                break
            merge(library, name, tiers[full[0]], full[0], None)
        left[name] = len(library._batches(name))
    for batch in deleted:
        _remove(spark, f"{library.folder}/deletions/batch={batch}")
    left["deletions"] = len(library._batches("deletions"))
    return left
