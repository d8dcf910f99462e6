"""Session settings and scratch tables shared by all operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sitetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch handed to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let the workers import this package where PYTHONPATH does not already do so, and bound their batches by bytes."""
    home, context = Path(__file__).resolve().parent, spark.sparkContext
    if not getattr(context, "_sitetide_batches", False):
        given = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
        if given.isdigit() and int(given) > BATCH_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        context._sitetide_batches = True
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_sitetide", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="sitetide-")) / "sitetide.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(packed))
    context._sitetide = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read lazily."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer parts than there are cores is dealt to all of them; any other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the machine, as idle workers are kept."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken, name = {c.lower() for f in frames for c in f.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); without one a local folder, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitetide-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables below the shared folder; ``drop_scratch`` deletes it as a whole."""
    return f"{scratch_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables of this application, once no frame that reads them is needed: the files and the catalog's entries."""
    context = spark.sparkContext
    for name in getattr(context, "_sitetide_tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    context._sitetide_tables = []
    path = context._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, label: str, by: str, n: int) -> DataFrame:
    """Like ``written``, in ``n`` buckets of the values of a column, so that grouping by it shuffles nothing again.

    Spark knows buckets of catalog tables only; ``drop_scratch`` takes the entry out again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, by).option("path", f"{own_folder(spark)}/{name}").saveAsTable(name)
    spark.sparkContext._sitetide_tables = [*getattr(spark.sparkContext, "_sitetide_tables", []), name]
    return spark.table(name)


def written(df: DataFrame, label: str, rows_of_file: int = 0) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
