"""Tables that runs write to: a log that takes each run once, and a keyed table that rewrites only the buckets it touches.

Both keep rows apart from commits. A run first writes its rows into a folder of its own, replacing what a broken-off try
of the same run left there, and then one commit row; readers only see rows of committed runs. So a run may be repeated at
any point, and a half-written one is invisible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.functions.text import content_hash
from sitetide.sources.store import latest

BUCKETS = 64
COMMIT = "run string, n_rows long, version long, buckets array<int>, committed_at timestamp"
CHANGE = ["run", "page_id", "change_type", "old_snapshot_id", "new_snapshot_id", "diff_text"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each committed run."""
    folder = f"{path}/commits"
    return spark.read.schema(COMMIT).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    return not commits(spark, path).filter(F.col("run") == run).isEmpty()


def _commit(spark: SparkSession, path: str, run: str, n: int, version: int = 0, buckets: list[int] | None = None) -> None:
    row = spark.createDataFrame([(run, n, version, buckets or [])], "run string, n_rows long, version long, buckets array<int>")
    row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _written(rows: DataFrame, folder: str, by: str | None = None) -> int:
    """Write and count in one pass."""
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(folder)
    return seen.get["n"]


def append_run(rows: DataFrame, path: str, run: str) -> bool:
    """Add the rows of a run, once; False where it was committed before, and nothing is written then.

    A table that broke off before its commit is replaced when the run is tried again. An empty run is committed too.
    """
    spark = rows.sparkSession
    if is_committed(spark, path, run):
        return False
    _commit(spark, path, run, _written(rows.drop("run"), f"{path}/rows/run={run}"))
    return True


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed runs with their ``run``; only the folders of these are listed by the join."""
    folder = f"{path}/rows"
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("run", T.StringType())])
    if not _exists(spark, folder):
        return spark.createDataFrame([], kind)
    done = commits(spark, path).select("run").distinct()
    return spark.read.schema(kind).parquet(folder).join(F.broadcast(done), "run", "left_semi").select(*kind.names)  # a row a run


# --- what a crawl notes ---------------------------------------------------------------------------------------------


def _snapshot_id(side: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64("run", "page_id", F.lit(side)))


def change_rows(diffs: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots ``(snapshot_id, page_id, content_hash, text)`` and changes of ``diffs (page_id, change_type, old_text,
    new_text, diff_text)``: one snapshot for each text that there is, and a change that points to both.

    The numbers follow from run, page and side, so a run that is repeated makes the same rows.
    """
    rows = diffs.withColumn("run", F.lit(run))
    changes = rows.select("*", *[_snapshot_id(s, F.col(f"{s}_text")).alias(f"{s}_snapshot_id") for s in ("old", "new")])
    sides = F.array(*[F.struct(F.col(f"{s}_snapshot_id").alias("snapshot_id"), F.col(f"{s}_text").alias("text")) for s in ("old", "new")])
    each = changes.select("page_id", F.inline(F.filter(sides, lambda s: s["text"].isNotNull())))
    return each.select("snapshot_id", "page_id", content_hash(F.col("text")).alias("content_hash"), "text"), changes.select(*CHANGE)


def baseline_rows(diffs: DataFrame, run: str) -> DataFrame:
    """Snapshots of pages seen for the first time that are no finding; a missing text counts as empty."""
    text = F.coalesce("new_text", F.lit(""))
    return diffs.select(F.xxhash64(F.lit(run), "page_id", F.lit("new")).alias("snapshot_id"), "page_id", content_hash(text).alias("content_hash"), text.alias("text"))


def notification_rows(messages: DataFrame, failures: DataFrame) -> DataFrame:
    """The log of ``messages (message_id, site_id, change_id, channel, message)``: ``failed`` with its error where
    ``failures (message_id, error)`` has one (the last by name where it has several), else ``sent``."""
    errors = failures.groupBy("message_id").agg(F.max("error").alias("error"))
    rows = messages.join(errors.withColumn("lost", F.lit(True)), "message_id", "left")
    return rows.select("message_id", "site_id", "change_id", "channel", F.when(F.col("lost"), "failed").otherwise("sent").alias("status"), "message", "error")


# --- keyed tables ---------------------------------------------------------------------------------------------------


def _current(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, version``: the last committed version of each bucket; at most one row for each."""
    each = commits(spark, path).select("version", F.explode("buckets").alias("bucket"))
    return each.groupBy("bucket").agg(F.max("version").alias("version"))


def _at(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    kind = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
    folder = f"{path}/data"
    if not _exists(spark, folder):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).option("basePath", folder).parquet(folder)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.join(F.broadcast(_current(spark, path)), ["bucket", "version"], "left_semi")


def read_state(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The last row of each key, as the last committed run left it."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return _at(spark, path, kind).select(*kind.names)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _replace(rows: DataFrame, path: str, run: str, touched: list[int]) -> None:
    """Commit ``rows (.., bucket)`` as the next version of the touched buckets; a bucket without rows is empty from now on."""
    spark = rows.sparkSession
    version = (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    n = _written(rows, f"{path}/data/version={version}", "bucket")
    _commit(spark, path, run, n, version, touched)


def upsert_run(new: DataFrame, path: str, run: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> bool:
    """Put the rows of a run into a keyed table, once: of each key the last row by ``order`` stays, old or new.

    Only the buckets of the new rows' keys are read and written again; the others keep their files. Old versions stay
    until ``vacuum``. False where the run was committed before.
    """
    spark, kind = new.sparkSession, new.schema
    if is_committed(spark, path, run):
        return False
    keyed = new.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())  # at most ``buckets``
    old = _at(spark, path, kind, touched).select(*kind.names, "bucket")
    _replace(latest(old.unionByName(keyed), [*keys, "bucket"], order), path, run, touched)
    return True


def update_where(spark: SparkSession, path: str, run: str, schema: str, which: Column, changes: dict[str, Column]) -> bool:
    """Change columns of the rows for which ``which`` holds; buckets without such a row keep their files."""
    kind = T._parse_datatype_string(schema)
    if is_committed(spark, path, run):
        return False
    rows = _at(spark, path, kind)
    touched = sorted(r["bucket"] for r in rows.filter(which).select("bucket").distinct().collect())  # at most as many as buckets
    hit = F.coalesce(which, F.lit(False))
    values = {c: F.when(hit, value).otherwise(F.col(c)).alias(c) for c, value in changes.items()}
    old = _at(spark, path, kind, touched)
    _replace(old.select(*[values.get(c, F.col(c)) for c in kind.names], "bucket"), path, run, touched)
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files of bucket versions that no reader of the present state needs, and say how many folders went."""
    kept = {(r["bucket"], r["version"]) for r in _current(spark, path).collect()}  # one for each bucket
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files, gone = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for v in files.listStatus(folder) if files.exists(folder) else []:
        version = int(v.getPath().getName().rpartition("=")[2])
        for b in files.listStatus(v.getPath()):
            name = b.getPath().getName()
            if name.startswith("bucket=") and (int(name.rpartition("=")[2]), version) not in kept:
                gone += bool(files.delete(b.getPath(), True))
    return gone


def value_of(state: DataFrame, name: str, default: str | None = None) -> Column:
    """A named value of a key-value table ``(name, value)`` as a column, or the default."""
    found = state.filter(F.col("name") == name).select("value")
    return F.coalesce(F.lit(None if (row := found.first()) is None else row[0]), F.lit(default))
