"""Stored tables: append-only logs read as the latest row of a key, weekly partitions, crawled items, cookie exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitetide.functions.markup import item_structure

ITEM = "url string, text string, markdown string, title string, metadata struct<title:string,description:string>"
COOKIE = "array<struct<name:string,value:string,domain:string,path:string,expirationDate:double>>"


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregation with partial results, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    made = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return made.select(*keys, "_last.*").select(*rows.columns)


def upsert(log: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of a table after further rows were appended to its log."""
    return latest(log.unionByName(new, allowMissingColumns=True), keys, order)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def overwrite_week(rows: DataFrame, path: str, by: str = "week") -> None:
    """Replace the weeks that ``rows`` has and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """One file of the lines ``(.., line)`` of a report in order."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a cloud crawl from JSON lines: ``url, text, title, structure``; items without address or text are left out.
    A crawl of which nothing is left is an error, as the site's data must stay as they are."""
    found = crawled_items(spark.read.schema(ITEM).json(path))
    if found.isEmpty():
        raise ValueError(f"a crawl without a page: {path}")
    return found


def crawled_items(items: DataFrame) -> DataFrame:
    blank = F.lit("")
    text = F.coalesce(F.nullif("text", blank), F.nullif("markdown", blank))
    title = F.coalesce(F.nullif("metadata.title", blank), F.nullif("title", blank), blank)
    rows = items.filter((F.coalesce("url", blank) != "") & text.isNotNull())
    made = item_structure(F.coalesce(F.nullif("metadata.title", blank), F.col("title")), F.col("metadata.description"), F.col("markdown"), F.col("text"))
    return rows.select("url", text.alias("text"), title.alias("title"), made.alias("structure"))


def cookies(exports: DataFrame) -> DataFrame:
    """``valid`` and the cookies of exports ``(raw)``: a non-empty list whose items have name, value and domain."""
    made = F.from_json("raw", COOKIE)
    whole = F.forall(made, lambda c: c["name"].isNotNull() & c["value"].isNotNull() & c["domain"].isNotNull())
    return exports.withColumn("cookies", made).withColumn("valid", F.coalesce((F.size("cookies") > 0) & whole, F.lit(False)))


def resume_hits(cache: DataFrame, now, hours: int = 12) -> DataFrame:
    """Drafts of a broken-off crawl young enough to be used; the newest of each address."""
    young = cache.filter(F.col("fetched_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    return latest(young, ["site_id", "url"], ["fetched_at"])


def batches(rows: DataFrame, size: int, order: list[str], group: str = "site_id") -> DataFrame:
    """Number the rows of each group in portions of ``size``."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((nth - 1) / size).cast("int"))
