"""What the next crawl has to fetch, and what a broken sitemap lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.urls import section
from sitetide.operators.ordered import numbered

GAP_SECTION_MIN = 10
GAP_MASS_MIN = 50
GAP_MASS_SHARE = 0.5
GAP_SAMPLE = 5
WHOLE_MAP = "*"


def crawl_plan(
    entries: DataFrame,
    previous: DataFrame,
    max_fetch: int,
    max_undated: int | None = None,
    force_full: bool = False,
    refetch: DataFrame | None = None,
) -> DataFrame:
    """``site_id, url, action, priority`` of every entry ``(site_id, url, lastmod)`` against ``previous`` pages.

    Priority 0: unseen (or all, when forced); 1: newer than saved; 2: a date is missing, or the address is listed in
    ``refetch (site_id, url)``; others are carried over. Of the candidates, in order of priority and address, the first
    ``max_fetch`` of a site are fetched; with ``max_undated`` those of priority 2 have a quota of their own. Beyond it
    known pages are carried over and unknown ones wait.
    """
    keys = ["site_id", "url"]
    old = previous.select(*keys, F.col("lastmod").alias("saved"), F.lit(True).alias("known"))
    again = (refetch.select(*keys).distinct().withColumn("again", F.lit(True))) if refetch is not None else None
    rows = entries.select(*keys, "lastmod").join(old, keys, "left")
    rows = rows.join(again, keys, "left") if again is not None else rows.withColumn("again", F.lit(None).cast("boolean"))
    priority = (
        F.when(F.lit(force_full) | F.col("known").isNull(), 0)
        .when(F.col("lastmod") > F.col("saved"), 1)
        .when(F.col("lastmod").isNull() | F.col("saved").isNull() | F.coalesce("again", F.lit(False)), 2)
    )
    rows = rows.withColumn("priority", priority)
    apart = F.lit(max_undated is not None) & (F.col("priority") == 2)
    order = Window.partitionBy("site_id", "queue").orderBy("priority", "url")
    wanted = rows.filter("priority is not null").select(*keys, "priority", apart.cast("int").alias("queue"))
    quota = F.when(F.col("queue") == 0, max_fetch).otherwise(max_undated or 0)
    most = max(max_fetch, max_undated or 0)  # a bound on the rank alone lets tasks cut before the shuffle
    first = wanted.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).filter(F.col("nth") <= quota)
    rows = rows.join(first.select(*keys, F.lit(True).alias("fetch")), keys, "left")
    action = F.when(F.col("fetch"), "fetch").when(F.col("known"), "carry").otherwise("wait")
    return rows.select(*keys, action.alias("action"), "priority")


def assemble(plan: DataFrame, fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """Texts of a crawl: what was fetched, else what was known; a page with neither is absent, and ``failed`` tells of
    a fetch that gave nothing. The date of a failed page does not advance."""
    keys = ["site_id", "url"]
    new = fetched.select(*keys, F.col("text").alias("new_text"))
    old = previous.select(*keys, F.col("text").alias("old_text"), F.col("lastmod").alias("old_lastmod"))
    rows = plan.filter("action <> 'wait'").join(new, keys, "left").join(old, keys, "left")
    failed = (F.col("action") == "fetch") & F.col("new_text").isNull()
    text = F.when(F.col("action") == "fetch", F.coalesce("new_text", "old_text")).otherwise(F.col("old_text"))
    return rows.select(*keys, text.alias("text"), failed.alias("failed")).filter("text is not null")


def sitemap_gaps(entries: DataFrame, previous: DataFrame) -> DataFrame:
    """``site_id, section, url`` of known pages that a sitemap lost in bulk.

    At least 50 and half of all known pages: one gap ``*`` of all of them. Otherwise a section without any live page
    that had at least ten. Only counts meet by section, never the pages of a site.
    """
    live = entries.select("site_id", "url").distinct()
    known = previous.select("site_id", "url").distinct()
    marked = known.join(live.withColumn("live", F.lit(True)), ["site_id", "url"], "left").withColumn("section", section(F.col("url")))
    missing = marked.filter("live is null").select("site_id", "url", "section")
    sizes = marked.groupBy("site_id").agg(F.count("*").alias("known"), F.count_if(F.col("live").isNull()).alias("lost"))
    mass = sizes.withColumn("mass", (F.col("lost") >= GAP_MASS_MIN) & (F.col("lost") >= F.col("known") * GAP_MASS_SHARE)).select("site_id", "mass")
    here = live.select("site_id", section(F.col("url")).alias("section")).distinct()
    empty = missing.groupBy("site_id", "section").agg(F.count("*").alias("n")).filter(F.col("n") >= GAP_SECTION_MIN)
    empty = empty.join(here, ["site_id", "section"], "left_anti").select("site_id", "section", F.lit(True).alias("gone"))
    rows = missing.join(mass, "site_id").join(empty, ["site_id", "section"], "left")
    named = F.when(F.col("mass"), WHOLE_MAP).when(F.col("gone"), F.col("section"))
    return rows.select("site_id", named.alias("section"), "url").filter("section is not null")


def spread_sample(gaps: DataFrame, size: int = GAP_SAMPLE) -> DataFrame:
    """Of each gap every n/size-th address in order; all where there are no more than ``size``.

    All lost pages are numbered by all tasks together, so the pages of one site need not fit into one."""
    by = ["site_id", "section"]
    rows = numbered(gaps, [*by, "url"], "_place")
    sizes = rows.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias("total"))  # one row a gap
    rows = rows.join(F.broadcast(sizes), by).withColumn("nth", F.col("_place") - F.col("_first"))
    picked = F.exists(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.floor(k * F.col("total") / size) == F.col("nth"))
    return rows.filter((F.col("total") <= size) | picked).select(*by, "url")


def restore_gaps(entries: DataFrame, previous: DataFrame, checks: DataFrame) -> DataFrame:
    """``entries`` and the pages of gaps whose sample is mostly alive in ``checks (site_id, url, alive)``, with old dates."""
    gaps = sitemap_gaps(entries, previous)
    sample = spread_sample(gaps).join(checks, ["site_id", "url"], "left")
    alive = sample.groupBy("site_id", "section").agg((F.count_if("alive") * 2 > F.count("*")).alias("ok")).filter("ok")
    back = gaps.join(alive, ["site_id", "section"], "left_semi").join(previous.select("site_id", "url", "lastmod"), ["site_id", "url"])
    return entries.select("site_id", "url", "lastmod").unionByName(back.select("site_id", "url", "lastmod"))


def restored_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("site_id", section(F.col("url")).alias("section")).agg(F.count("*").alias("n_pages"))


def what_if(pages: DataFrame, old_rules, new_rules, top: int = 8) -> DataFrame:
    """Pages that a change of path rules adds or removes, by section."""
    from sitetide.functions.urls import path_included

    was, now = path_included(F.col("url"), old_rules), path_included(F.col("url"), new_rules)
    rows = pages.select(section(F.col("url")).alias("section"), was.alias("was"), now.alias("now")).filter("was <> now")
    counts = rows.groupBy("section").agg(F.count_if("now").alias("added"), F.count_if("was").alias("removed"))
    return counts.orderBy(F.desc(F.col("added") + F.col("removed")), "section").limit(top)
