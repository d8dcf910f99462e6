"""Work in portions: queues of several sites cut by quotas of items and of external calls, and where the next run goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.operators.ordered import numbered, running

PORTION = 12
MAX_CALLS = 150
CARD_LIMIT = 30
CARD_BATCH = 4
ASK_BATCH = 3


def _after(order: list[str], point: tuple | None) -> Column:
    """Whether a row comes behind a point of the order."""
    if point is None:
        return F.lit(True)
    later = F.lit(False)
    for c, v in reversed(list(zip(order, point, strict=True))):
        later = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & later)
    return later


def portions(
    queue: DataFrame,
    order: list[str],
    group: str = "site_id",
    size: int = PORTION,
    max_calls: int | None = MAX_CALLS,
    max_items: int | None = None,
    after: tuple | None = None,
    card_batch: int = CARD_BATCH,
    ask_batch: int = ASK_BATCH,
) -> DataFrame:
    """``queue`` with ``portion, calls_before, taken``: what a run takes of each site's pages, site by site.

    ``order`` begins with ``group`` and tells all rows apart; ``needs_card`` and ``asks`` (boolean) say which external
    calls a page needs, in batches of their own within a portion. A portion begins only while the calls of all portions
    before it are fewer than ``max_calls``, and is then done as a whole. ``max_items`` cuts the queue itself. With
    ``after``, the stored point of a former run, only later pages are looked at. Every rank and sum is taken by all tasks:
    no site's queue has to fit into one.
    """
    rows = numbered(queue.filter(_after(order, after)), order, "_nth")
    if max_items is not None:
        rows = rows.filter(F.col("_nth") < max_items)
    first = rows.groupBy(group).agg(F.min("_nth").alias("_first"))  # one row a site
    rows = rows.join(F.broadcast(first), group).withColumn("portion", F.floor((F.col("_nth") - F.col("_first")) / size).cast("int"))
    calls = F.ceil(F.count_if("needs_card") / card_batch) + F.ceil(F.count_if("asks") / ask_batch)
    each = running(rows.groupBy(group, "portion").agg(calls.alias("calls")), [group, "portion"], "calls", "calls_before")
    taken = F.lit(True) if max_calls is None else F.col("calls_before") < max_calls
    return rows.join(each.select(group, "portion", "calls_before"), [group, "portion"]).withColumn("taken", taken).drop("_nth", "_first").select(*queue.columns, "portion", "calls_before", "taken")


def resume_point(made: DataFrame, order: list[str]) -> tuple | None:
    """The last row that was taken, by which the next run goes on; None where none was."""
    last = made.filter("taken").agg(F.max(F.struct(*order)).alias("p")).first()["p"]
    return None if last is None else tuple(last)


def stopped_by_calls(made: DataFrame) -> DataFrame:
    """``processed, stopped``: pages taken, and whether the cap on calls left some over."""
    return made.agg(F.count_if("taken").alias("processed"), F.coalesce(F.bool_or(~F.col("taken")), F.lit(False)).alias("stopped"))


def card_batches(pages: DataFrame, order: list[str], limit: int = CARD_LIMIT, size: int = CARD_BATCH) -> DataFrame:
    """The first ``limit`` pages of a card refresh and the batch that each is in; the rest waits for the next run.

    Each task sends its first ones only, so what is numbered has at most ``limit`` rows.
    """
    first = pages.orderBy(*order).limit(limit)
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))
