"""Streams with several state variables and timers for each page: a high-water mark that failed loads leave alone, and a
resume cache whose drafts expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOAD = "site_id long, url string, loaded_at timestamp, lastmod timestamp, content_hash string, ok boolean"
MARK = "site_id long, url string, loaded_at timestamp, lastmod timestamp, verdict string"
DRAFT = "site_id long, url string, fetched_at timestamp, content_hash string"
HIT = "site_id long, url string, fetched_at timestamp, verdict string, content_hash string"
#: Where the sessions of such streams keep their state.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _micros(x: pd.Timestamp) -> int | None:
    return None if pd.isna(x) else int(pd.Timestamp(x).value // 1000)


class HighWaterMark(StatefulProcessor):
    """The saved date of a page: it rises with each successful load and is not moved by a failed one.

    Three values are kept: the mark, the time of the last load that counted, and how often loads failed since.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "at long")
        self.seen = handle.getValueState("seen", "at long, hash string")
        self.failed = handle.getValueState("failed", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        at, had = self.seen.get() if self.seen.exists() else (None, None)
        failed = self.failed.get()[0] if self.failed.exists() else 0
        out = []
        for row in pd.concat(list(rows)).sort_values("loaded_at", kind="stable").itertuples(index=False):
            now, date = _micros(row.loaded_at), _micros(row.lastmod)
            if at is not None and now < at:
                verdict = "late"
            elif not row.ok:
                failed, verdict = failed + 1, "failed"
            else:
                verdict = "new" if had is None else "same" if had == row.content_hash else "changed"
                at, had, failed = now, row.content_hash, 0
                if date is not None and (mark is None or date > mark):
                    mark = date
            out.append((key[0], key[1], row.loaded_at, None if mark is None else pd.Timestamp(mark, unit="us"), verdict))
        if mark is not None:
            self.mark.update((mark,))
        if at is not None:
            self.seen.update((at, had))
        self.failed.update((failed,))
        yield pd.DataFrame(out, columns=["site_id", "url", "loaded_at", "lastmod", "verdict"])

    def close(self) -> None:
        pass


def high_water_marks(loads: DataFrame) -> DataFrame:
    """``site_id, url, loaded_at, lastmod, verdict`` for each row of a stream of loads: the mark that holds after it.

    Verdicts: ``new``, ``changed``, ``same``; ``failed`` and ``late`` (older than the last load that counted) change
    nothing. Loads of a page inside one batch are taken in order of time.
    """
    rows = loads.select("site_id", "url", "loaded_at", "lastmod", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("site_id", "url").transformWithStateInPandas(HighWaterMark(), MARK, "Append", "None")


class ResumeCache(StatefulProcessor):
    """Drafts of pages: one young enough is a hit; with the first draft a timer starts that takes it out again."""

    def __init__(self, hours: int):
        self.age = hours * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", "at long, hash string")
        self.timer = handle.getValueState("timer", "due long")

    def _start(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        due = at // 1000 + self.age
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, had = self.draft.get() if self.draft.exists() else (None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("fetched_at", kind="stable").itertuples(index=False):
            now = _micros(row.fetched_at)
            if at is not None and now - at < self.age * 1000:
                out.append((key[0], key[1], row.fetched_at, "hit", had))
                continue
            at, had = now, row.content_hash
            out.append((key[0], key[1], row.fetched_at, "miss", had))
            self.draft.update((at, had))
            self._start(at)
        yield pd.DataFrame(out, columns=["site_id", "url", "fetched_at", "verdict", "content_hash"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, had = self.draft.get()
        self.draft.clear()
        self.timer.clear()
        yield pd.DataFrame([(key[0], key[1], pd.Timestamp(at, unit="us"), "expired", had)], columns=["site_id", "url", "fetched_at", "verdict", "content_hash"])

    def close(self) -> None:
        pass


def resume_cache(pages: DataFrame, hours: int = 12, late: str = "10 minutes") -> DataFrame:
    """``site_id, url, fetched_at, verdict, content_hash``: ``miss`` for a page that is fetched and kept, ``hit`` for one
    asked again within ``hours`` (with the draft's hash), ``expired`` when the stream's time passes the draft's age.

    The time of the stream is that of its rows; rows more than ``late`` behind it are left out.
    """
    rows = pages.select("site_id", "url", "fetched_at", F.coalesce("content_hash", F.lit("")).alias("content_hash")).withWatermark("fetched_at", late)
    return rows.groupBy("site_id", "url").transformWithStateInPandas(ResumeCache(hours), HIT, "Append", "EventTime")
