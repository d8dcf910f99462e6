"""Structured Streaming forms: page versions in, changes, counters and a resume cache out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSION = "site_id long, url string, fetched_at timestamp, content_hash string, is_removed boolean"
CHANGE = "site_id long, url string, fetched_at timestamp, change_type string"


def page_changes(versions: DataFrame) -> DataFrame:
    """``new``, ``changed`` and ``removed`` events of a stream of versions, from the last state of each page.

    Versions of a page inside one batch are taken in order of time; one older than the page's state is ignored.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)  # hash (empty: removed), time in microseconds
        out = []
        for row in pd.concat(list(frames)).sort_values("fetched_at", kind="stable").itertuples(index=False):
            at, now = int(row.fetched_at.value // 1000), "" if row.is_removed else row.content_hash
            if last[1] is not None and at < last[1]:
                continue
            if now != (last[0] or "") or last[0] is None:
                kind = "removed" if now == "" else "changed" if last[0] else "new"
                if not (kind == "removed" and not last[0]):
                    out.append((key[0], key[1], row.fetched_at, kind))
            last = (now, at)
        state.update(last)
        yield pd.DataFrame(out, columns=["site_id", "url", "fetched_at", "change_type"])

    keyed = versions.select("site_id", "url", "fetched_at", "content_hash", F.coalesce("is_removed", F.lit(False)).alias("is_removed"))
    return keyed.groupBy("site_id", "url").applyInPandasWithState(fold, CHANGE, "hash string, at long", "append", GroupStateTimeout.NoTimeout)


def weekly_counts(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes by site, type and week from Monday (UTC); rows later than ``late`` behind the stream are left out."""
    week = F.window("detected_at", "7 days", startTime="4 days")
    return changes.withWatermark("detected_at", late).groupBy(week, "site_id", "change_type").agg(F.count("*").alias("n"))


def trailing_counts(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of the seven days up to each day."""
    return changes.withWatermark("detected_at", late).groupBy(F.window("detected_at", "7 days", "1 day"), "site_id").agg(F.count("*").alias("n"))


def first_fetches(pages: DataFrame, hours: int = 12) -> DataFrame:
    """The resume cache as a stream: an address counts once within ``hours``."""
    return pages.withWatermark("fetched_at", f"{hours} hours").dropDuplicatesWithinWatermark(["site_id", "url"])
