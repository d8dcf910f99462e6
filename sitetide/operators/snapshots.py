"""Differences of two crawls, verdicts on vanished pages, and the state of each page after a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.diffs import opcodes, unified, with_hunks
from sitetide.functions.markup import extract_text
from sitetide.functions.noise import normalize_for_compare
from sitetide.functions.urls import same_page
from sitetide.session import free_name, written

GONE_STATUS = (404, 410)
TARGET_TEXT = 4000
KEYS = ["site_id", "url"]


def snapshot_diff(previous: DataFrame, current: DataFrame, with_noise: bool = True) -> DataFrame:
    """``site_id, url, change_type, old_text, new_text`` of pages ``(site_id, url, text)`` that are new, removed or changed.

    One full outer join on the key, of digests: texts are only fetched for pages whose digests differ, so equal pages,
    which are most of a crawl, shuffle no text. Equal texts need no normalisation, so only pages whose texts differ reach
    the Arrow function; a page whose texts differ in noise alone is left out. ``with_noise=False`` compares texts as they
    are. A page that a crawl has twice is compared in each of its pairs.
    """
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    old, new = (rows.select(*KEYS, digest.alias(f"{side}_digest"), F.col("text").alias(f"{side}_text")) for rows, side in ((previous, "old"), (current, "new")))
    met = old.drop("old_text").join(new.drop("new_text"), KEYS, "full_outer").filter("not (old_digest <=> new_digest)")
    kind = F.when(F.col("old_digest").isNull(), "new").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
    found = written(met.select(*KEYS, kind.alias("change_type"), "old_digest", "new_digest").distinct(), "differing")
    none = F.lit(None).cast("string")
    left, right = [*KEYS, "old_digest"], [*KEYS, "new_digest"]
    one_side = found.filter("change_type = 'new'").join(new, right).withColumn("old_text", none)
    one_side = one_side.unionByName(found.filter("change_type = 'removed'").join(old, left).withColumn("new_text", none))
    both = found.filter("change_type = 'changed'").join(old, left).join(new, right)
    if with_noise:
        both = both.filter(~normalize_for_compare("old_text").eqNullSafe(normalize_for_compare("new_text")))
    rows = one_side.unionByName(both)
    return rows.select(*KEYS, "change_type", "old_text", "new_text")


def with_diff_text(diffs: DataFrame) -> DataFrame:
    """Add ``diff_text``, null but for changed pages: their islands of changed lines with two lines of context."""
    changed = F.col("change_type") == "changed"
    both, found = free_name("opcodes", diffs), free_name("hunks", diffs)
    rows = with_hunks(diffs.filter(changed).withColumn(both, opcodes("stripped")("old_text", "new_text")), both, found)
    rows = rows.withColumn("diff_text", unified(F.col(found))).drop(both, found)
    return rows.unionByName(diffs.filter(~changed).withColumn("diff_text", F.lit(None).cast("string")))


def classify(url: Column, status: Column, final_url: Column) -> Column:
    """What a second look at a vanished page says: deleted, moved, still_alive, or unknown."""
    return (
        F.when(status.isNull(), "unknown")
        .when(status.isin(*GONE_STATUS), "deleted")
        .when(status >= 400, "unknown")
        .when(~same_page(url, final_url), "moved")
        .otherwise("still_alive")
    )


def verdicts(responses: DataFrame) -> DataFrame:
    """``site_id, url, verdict, redirect_to, target_text`` of ``responses (site_id, url, status, final_url, body)``."""
    rows = responses.withColumn("verdict", classify(F.col("url"), F.col("status"), F.col("final_url")))
    moved = F.col("verdict") == "moved"
    body = F.when(moved, F.col("body"))
    return rows.select(*KEYS, "verdict", F.when(moved, F.col("final_url")).alias("redirect_to"), F.when(moved, F.substring(extract_text(body), 1, TARGET_TEXT)).alias("target_text"))


def real_changes(diffs: DataFrame, found: DataFrame) -> DataFrame:
    """New and changed pages, and of the removed ones those found deleted or moved."""
    rows = diffs.join(found.select(*KEYS, "verdict"), KEYS, "left")
    return rows.filter("change_type <> 'removed' or coalesce(verdict in ('deleted', 'moved'), false)")


def fold_pages(pages: DataFrame, seen: DataFrame, found: DataFrame, now) -> DataFrame:
    """State of every page after a crawl.

    A page that was seen is alive, checked, and without a verdict, redirect or summary, also when it had been removed
    before. Of the others, deleted and moved ones are removed now; alive and unknown ones keep their state with reason
    ``missing_from_crawl``; pages that were not checked keep all.
    """
    at = F.lit(now).cast("timestamp")
    rows = pages.join(seen.select(*KEYS, F.col("lastmod").alias("new_lastmod"), F.lit(True).alias("seen")), KEYS, "full_outer")
    rows = rows.join(found.select(*KEYS, "verdict", "redirect_to"), KEYS, "left")
    gone = F.coalesce(F.col("verdict").isin("deleted", "moved"), F.lit(False))
    is_seen = F.col("seen").isNotNull()
    checked = F.col("verdict").isNotNull()
    reason = F.when(gone, F.col("verdict")).when(checked, "missing_from_crawl").otherwise(F.col("disappearance_reason"))
    return rows.select(
        *KEYS,
        F.coalesce("first_seen_at", at).alias("first_seen_at"),
        F.when(is_seen, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(is_seen, False).when(gone, True).otherwise(F.col("is_removed")).alias("is_removed"),
        F.when(~is_seen, F.when(gone, at).otherwise(F.col("removed_at"))).alias("removed_at"),
        F.when(~is_seen, reason).alias("disappearance_reason"),
        F.when(~is_seen, F.when(F.col("verdict") == "moved", F.col("redirect_to")).otherwise(F.col("redirect_to_url"))).alias("redirect_to_url"),
        F.when(~is_seen, F.col("redirect_target_summary")).alias("redirect_target_summary"),
        F.when(is_seen, F.coalesce("new_lastmod", "sitemap_lastmod")).otherwise(F.col("sitemap_lastmod")).alias("sitemap_lastmod"),
        F.when(is_seen | checked, at).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
    )


def split_reopened(diffs: DataFrame, old_rules: DataFrame) -> DataFrame:
    """Mark new pages that the site's former rules ``(site_id, rules)`` did not track: they are a baseline, no finding."""
    from sitetide.functions.urls import path_included

    rows = diffs.join(old_rules, "site_id", "left")
    fresh = (F.col("change_type") == "new") & F.col("rules").isNotNull() & ~path_included(F.col("url"), F.col("rules"))
    return rows.withColumn("is_baseline", F.coalesce(fresh, F.lit(False))).drop("rules")


def findings(diffs: DataFrame, previous: DataFrame) -> DataFrame:
    """Differences of sites that had pages before; a site's first crawl is a baseline without findings."""
    return diffs.join(previous.select("site_id").distinct(), "site_id", "left_semi")


def unavailable(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sites with known pages whose crawl brought none: their data must stay as they are."""
    return previous.select("site_id").distinct().join(current.select("site_id").distinct(), "site_id", "left_anti")
