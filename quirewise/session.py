"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that pass between a task and its Python worker at a time, about; both sides hold them.
BATCH_BYTES = 4 << 20
_test_folders: dict[str, str] = {}
_shipped: set[str] = set()


def get_session(app: str = "quirewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    Adaptive execution picks broadcast joins from measured sizes, splits skewed join
    partitions and coalesces small shuffles, so no operator hard-codes those choices.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Workers then import it wherever the driver was started and whatever is installed there.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="quirewise-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for module in sorted(package.rglob("*.py")):
                z.write(module, str(module.relative_to(package.parent)))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Let texts pass in Arrow batches of BATCH_BYTES, unless the session has a bound of its own.

    Operators on texts work on slices of about 1 MB. With Spark's 64 MB or 10,000 rows the memory of every task, and
    of its worker after that, would follow the length of the texts.
    """
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without the
    setting (a test) gets a folder of its own; a cluster without it is an error, because
    a driver-local folder would be invisible to the executors.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return _test_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quirewise-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the work folder and read it back.

    Used where several branches need the same costly rows: the scan runs once, lineage is
    cut, and a lost executor only costs a re-read of the written files.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
