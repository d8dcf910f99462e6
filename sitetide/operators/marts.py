"""Feeds, counters, digests, audit queues and weekly sheets over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions import text, urls
from sitetide.functions.noise import normalize_for_compare

TYPES = ("new", "changed", "removed")


def ranked(rows: DataFrame, order: list, size: int, page: int = 1) -> DataFrame:
    """One page of a total order, with ``total_rows``, ``page`` (clamped) and ``pages``; the number asked for may be any.

    Only the rows up to the end of the page are sorted; they leave the engine in order of ``nth``.
    """
    total = rows.count()
    pages = max(-(-total // size), 1)
    page = min(max(page, 1), pages)
    cut = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return cut.withColumn("total_rows", F.lit(total).cast("long")).withColumn("page", F.lit(page)).withColumn("pages", F.lit(pages))


def feed(changes: DataFrame, sites: DataFrame, analysis: DataFrame, site: int | None = None, kind: str | None = None, high: bool = False, since=None, q: str | None = None, audience: str | None = None) -> DataFrame:
    """Changes with their site and, where there is one, their analysis; without a site given, rivals only."""
    rows = changes.join(sites.select("site_id", "name", "is_own"), "site_id").join(analysis, "change_id", "left")
    rows = rows.filter(F.col("site_id") == site) if site is not None else rows.filter(~F.col("is_own"))
    if kind in TYPES:
        rows = rows.filter(F.col("change_type") == kind)
    if high:
        rows = rows.filter("importance = 'high'")
    if since is not None:
        rows = rows.filter(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    if q:
        rows = rows.filter(F.col("url").ilike(f"%{q}%"))
    if audience:
        rows = rows.filter(urls.content_kind(F.col("url"), F.col("category")) == audience)
    return rows


def counts_by_type(changes: DataFrame, sites: DataFrame, since) -> DataFrame:
    rivals = sites.filter("not is_own").select("site_id")
    rows = changes.filter(F.col("detected_at") >= F.lit(since).cast("timestamp")).join(rivals, "site_id", "left_semi")
    return rows.groupBy("change_type").agg(F.count("*").alias("n"))


def digest_by_site(changes: DataFrame, sites: DataFrame, since) -> DataFrame:
    """Counts for every rival, also those without changes: the changes are summed first, then joined to the sites."""
    rows = changes.filter(F.col("detected_at") >= F.lit(since).cast("timestamp")).groupBy("site_id")
    one = rows.agg(*[F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in TYPES], F.count_if(F.col("importance") == "high").alias("n_high"))
    made = sites.filter("not is_own").select("site_id", "name").join(one, "site_id", "left")
    return made.na.fill(0, ["n_new", "n_changed", "n_removed", "n_high"])


def top_findings(changes: DataFrame, by: list[str], k: int = 7) -> DataFrame:
    """The ``k`` most important changes of each group, newest first inside a rank; low ones never show."""
    rank = text.importance_rank(F.col("importance"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("rank", F.desc("detected_at"), F.desc("change_id")))
    return changes.withColumn("rank", rank).filter("rank < 2").withColumn("nth", nth).filter(F.col("nth") <= k)


def digest_lists(changes: DataFrame, sites: DataFrame, since, top: int = 7, lacking: int = 5) -> DataFrame:
    """``list, nth, change_id, total``: the rivals' most important changes of a period, and those that the own site lacks.

    ``changes (change_id, site_id, detected_at, importance, verdict)``. The first list goes by importance, then newest
    first, without low ones; the second, of all with the verdict ``none``, newest first. Both tell how many there are in
    all. Each task sends its own first ones.
    """
    rows = changes.filter(F.col("detected_at") >= F.lit(since).cast("timestamp")).join(sites.filter("not is_own").select("site_id"), "site_id", "left_semi")
    rows = rows.withColumn("rank", text.importance_rank(F.col("importance")))
    out = None
    for name, part, k in (("top", rows.filter("rank < 2"), top), ("missing", rows.filter("verdict = 'none'").withColumn("rank", F.lit(0)), lacking)):
        order = [F.col("rank"), F.desc("detected_at"), F.desc("change_id")]
        first = part.orderBy(*order).limit(k)  # numbered below: at most ``k`` rows
        made = first.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("nth"), "change_id").crossJoin(F.broadcast(part.agg(F.count("*").alias("total"))))
        out = made if out is None else out.unionByName(made)
    return out


def dashboard(sites: DataFrame, changes: DataFrame, now, days: int = 7) -> DataFrame:
    recent = changes.filter(F.col("detected_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    rivals = sites.filter("not is_own")
    recent = recent.join(rivals.select("site_id"), "site_id", "left_semi").agg(F.count("*").alias("recent_changes"))
    state = rivals.agg(
        F.count("*").alias("sites"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "needs_session").alias("needs_session"),
    )
    return state.crossJoin(recent)  # one row each


def start_all(sites: DataFrame) -> DataFrame:
    """What a start of all crawls does with each site, counted."""
    way = F.when(F.col("is_paused"), "paused").when(F.col("cookies_only"), "cookies_only").when(F.col("is_crawling"), "running").otherwise("started")
    return sites.filter("not is_own").groupBy(way.alias("result")).agg(F.count("*").alias("n"))


def health(sites: DataFrame, now, cookie_days: int = 7, own_days: int = 2) -> DataFrame:
    """What stands in the way now: rivals that need fresh cookies and the own site, not crawled for so long or never.

    Running crawls are no problem, nor is a paused rival.
    """
    at = F.lit(now).cast("timestamp")

    def older(days: int) -> Column:
        return F.coalesce(F.col("last_crawl_finished_at") < at - F.make_dt_interval(days=F.lit(days)), F.lit(True))

    problem = F.when(F.col("is_own") & older(own_days), "own_stale").when(~F.col("is_own") & F.col("cookies_only") & ~F.col("is_paused") & older(cookie_days), "cookies_stale")
    return sites.filter(~F.col("is_crawling")).select("site_id", "name", problem.alias("problem")).filter("problem is not null")


def digest_problems(sites: DataFrame, since) -> DataFrame:
    """Rivals that a digest since then has to mention: blocked ones that were crawled before, new and stale ones."""
    last = F.col("last_crawl_finished_at")
    problem = (
        F.when((F.col("status") == "needs_session") & last.isNotNull(), "needs_session")
        .when(last.isNull(), "never_crawled")
        .when(last < F.lit(since).cast("timestamp"), "stale")
    )
    return sites.filter("not is_own and not is_paused").select("site_id", "name", problem.alias("problem")).filter("problem is not null")


def summary(sites: DataFrame) -> DataFrame:
    return sites.filter("not is_own").agg(
        F.count("*").alias("sites"),
        F.count_if("is_paused").alias("paused"),
        F.count_if(F.col("status") == "needs_session").alias("needs_session"),
        F.count_if("is_crawling").alias("crawling"),
        F.min(F.when(~F.col("is_paused"), F.col("next_crawl_at"))).alias("next_crawl_at"),
        F.max_by("name", F.struct("last_crawl_finished_at", "site_id")).alias("last_crawled"),
    )


def tracked_articles(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Info pages of rivals that are not removed and that the rules of their site keep.

    The rules are parsed once for each site; ``sites`` is a list of monitored sites and much smaller than their pages.
    """
    rules = sites.filter("not is_own").select("site_id", "name", urls.site_rules(F.col("include_paths"), F.lit(False)).alias("rules"))
    rows = pages.filter("not is_removed").filter(urls.is_info(F.col("url"))).join(rules, "site_id")
    return rows.filter(urls.path_included(F.col("url"), F.col("rules"))).drop("rules")


def audit_queue(pages: DataFrame, findings: DataFrame, sites: DataFrame, least: int = 300) -> DataFrame:
    """Tracked articles of rivals with enough text that have no finding yet."""
    ready = tracked_articles(pages.filter(F.col("text_length") >= least), sites)
    return ready.join(findings.select("page_id").distinct(), "page_id", "left_anti")


def _with_done(pages: DataFrame, findings: DataFrame, sites: DataFrame) -> DataFrame:
    done = findings.select("page_id").distinct().withColumn("done", F.lit(True))
    return tracked_articles(pages, sites).join(done, "page_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def audit_progress(pages: DataFrame, findings: DataFrame, sites: DataFrame, least: int = 300) -> DataFrame:
    """For each rival with articles: articles, done, ready, waiting for a structure; short ones count as articles only."""
    return _with_done(pages, findings, sites).groupBy("site_id", "name").agg(
        F.count("*").alias("articles"),
        F.count_if("done").alias("done"),
        F.count_if(~F.col("done") & (F.coalesce("text_length", F.lit(0)) >= least)).alias("ready"),
        F.count_if(~F.col("done") & F.col("text_length").isNull()).alias("waiting"),
    )


def audit_estimate(pages: DataFrame, findings: DataFrame, sites: DataFrame, card_batch: int = 4, compare_batch: int = 3, merged: float = 0.2) -> DataFrame:
    """For each rival, also one without articles: articles, those ready (of any length), and the calls that they take."""
    ready = ~F.col("done") & F.col("text_length").isNotNull()
    made = _with_done(pages, findings, sites).groupBy("site_id").agg(
        F.count("*").alias("articles"),
        F.count_if(ready).alias("ready"),
        F.count_if(~F.col("done") & F.col("text_length").isNull()).alias("without_structure"),
        F.count_if("done").alias("done"),
        F.count_if(ready & ~F.col("has_card")).alias("cards"),
    )
    names = ["articles", "ready", "without_structure", "done", "cards"]
    rows = sites.filter("not is_own").select("site_id", "name").join(made, "site_id", "left").na.fill(0, names)
    calls = F.ceil(F.col("cards") / card_batch) + F.ceil(F.col("ready") * (1 - merged) / compare_batch)
    return rows.select("site_id", "name", *names[:-1], calls.cast("long").alias("calls"))


#: Names of kinds in a sheet, and how many subintents are shown.
KIND_LABELS = {"new": "создание", "changed": "изменение", "audit": "аудит (статья уже есть)"}
SUBINTENTS_SHOWN = 4
EMPTY_WEEK = "За эту неделю новых и изменённых инфостатей конкурентов не найдено."


def availability(decision: Column, our_url: Column, cannibal: Column) -> Column:
    """Whether the own site has the topic, with its page, and the pages that would compete."""
    has = F.coalesce(our_url, F.lit("")) != ""
    said = F.when((decision == "new") | ~has, "Нет").when(decision == "update", F.concat(F.lit("Частично\n"), our_url)).otherwise(F.concat(F.lit("Есть\n"), our_url))
    risk = F.concat(F.lit("\n⚠️ Риск каннибализации:\n"), F.array_join(cannibal, "\n"))
    return F.concat(said, F.when(F.size(cannibal) > 1, risk).otherwise(F.lit("")))


def what_to_add(decision: Column, subintents: Column, argument: Column) -> Column:
    """What the editors have to do about a topic."""
    why = F.when(F.coalesce(argument, F.lit("")) != "", F.concat(F.lit(" "), argument)).otherwise(F.lit(""))
    add = F.coalesce(F.nullif(F.array_join(subintents, "; "), F.lit("")), F.lit("раскрыть тему подробнее"))
    said = F.when(decision == "new", "Написать новую статью.").when(decision == "update", F.concat(F.lit("Обновить нашу статью: добавить "), add, F.lit("."))).otherwise(F.lit("Ничего — у нас раскрыто."))
    return F.concat(said, why)


def usp_cell(added: Column, subintents: Column, shown: int = SUBINTENTS_SHOWN) -> Column:
    """Added subintents of a topic, else its first ones and the number of the others."""
    more = F.concat(F.lit(" (и ещё "), F.size(subintents) - shown, F.lit(")"))
    own = F.concat(F.lit("Подинтенты: "), F.array_join(F.slice(subintents, 1, shown), "; "), F.when(F.size(subintents) > shown, more).otherwise(F.lit("")))
    return F.when(F.size(added) > 0, F.concat(F.lit("Добавлен подинтент: "), F.array_join(added, "; "))).when(F.size(subintents) > 0, own).otherwise(F.lit(""))


_HEAD = ("material_type", "topic", "main_intent", "subintents", "decision", "our_url", "cannibal_urls", "add_subintents", "argument")


def week_sheet(findings: DataFrame, zone: str = text.ZONE) -> DataFrame:
    """One row for each topic of a week: first day, kinds, sites, pages and added subintents in order, the rest from the
    earliest finding; ``nth`` numbers the rows of a week newest first, where equal dates keep the order of appearance.

    The findings of a topic are reduced to their earliest one and to distinct values with their first places before
    anything is listed, so a topic with many findings costs no more than it shows.
    """
    local = F.from_utc_timestamp("detected_at", zone)
    place = F.struct("detected_at", "url")
    rows = findings.withColumn("week", text.week_start(F.col("detected_at"), zone)).withColumn("place", place)
    by = ["week", "decision_id"]
    head = rows.groupBy(*by).agg(
        F.min("place").alias("first"),
        F.min(local.cast("date")).alias("first_day"),
        F.min_by(F.struct(*_HEAD), "place").alias("h"),
    )

    def listed(name: str, values: DataFrame) -> DataFrame:
        once = values.groupBy(*by, "v").agg(F.min("at").alias("at"))
        return once.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))

    def plain(c: str) -> DataFrame:
        return rows.select(*by, F.struct("place", F.lit(0).alias("k")).alias("at"), F.col(c).alias("v"))

    made = head
    for name, c in (("kinds", "kind"), ("sites", "site"), ("pages", "url")):
        made = made.join(listed(name, plain(c)), by)
    added = rows.select(*by, "place", F.posexplode("added_subintents").alias("k", "v")).select(*by, F.struct("place", "k").alias("at"), "v")
    made = made.join(listed("added", added), by, "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    h = F.col("h")
    cells = made.select(
        *by,
        "first",
        F.date_format("first_day", "dd.MM.yyyy").alias("first_day"),
        F.array_join(F.transform("kinds", lambda k: F.coalesce(labels[k], k)), "\n").alias("kinds"),
        F.array_join("sites", "\n").alias("sites"),
        F.array_join("pages", "\n").alias("pages"),
        F.coalesce(h["material_type"], F.lit("")).alias("material_type"),
        F.concat(h["topic"], F.lit(". Интент: "), h["main_intent"]).alias("topic"),
        usp_cell(F.col("added"), h["subintents"]).alias("usp"),
        availability(h["decision"], h["our_url"], h["cannibal_urls"]).alias("available"),
        what_to_add(h["decision"], h["add_subintents"], h["argument"]).alias("to_add"),
    )
    order = Window.partitionBy("week").orderBy(F.desc("first.detected_at"), F.col("first"), "decision_id")
    nth = F.row_number().over(order)
    return cells.withColumn("nth", nth).drop("first").withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def empty_week(rows: DataFrame, week: str, said: str = EMPTY_WEEK) -> DataFrame:
    """The rows of a sheet's week, or one that says that there are none."""
    own = rows.filter(F.col("week") == week)
    none = own.agg(F.count("*").alias("n")).filter("n = 0").select(*[F.lit(week if c == "week" else said if c == "topic" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return own.unionByName(none)


def section_counts(pages: DataFrame, top: int = 5) -> DataFrame:
    """The largest sections of a site, and one row for the rest."""
    counts = pages.groupBy("site_id", urls.section(F.col("url")).alias("section")).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("n"), "section"))
    rows = counts.withColumn("nth", nth)
    rest = rows.filter(F.col("nth") > top).groupBy("site_id").agg(F.sum("n").alias("n")).withColumn("section", F.lit("other"))
    return rows.filter(F.col("nth") <= top).select("site_id", "section", "n").unionByName(rest.select("site_id", "section", "n"))


def baseline_pages(diffs: DataFrame, k: int = 50) -> DataFrame:
    """New pages worth comparing on a first crawl: commercial addresses first, then the shallow and short ones."""
    bare = F.regexp_replace(urls.path(F.col("url")), "/+$", "")
    rows = diffs.filter("change_type = 'new' and new_text <> ''").withColumn("p", bare)
    full = urls.path(F.col("url"))
    rows = rows.filter(~full.rlike("(?iU)" + urls.BASELINE_SKIP_PATH) & ~full.rlike("(?iU)" + urls.BASELINE_SKIP_SLUG))
    order = [(~F.col("p").rlike("(?iU)" + urls.BASELINE_KEY_PATH)).cast("int"), F.length("p") - F.length(F.replace("p", F.lit("/"), F.lit(""))), F.length("p"), F.col("url")]
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k).drop("p", "new_text", "old_text")


def worth_analysing(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Changes of pages that the rules still keep, without those whose two texts differ in noise alone.

    ``changes`` has ``old_text`` and ``new_text``; only changed pages with both reach the Arrow function.
    """
    rules = sites.select("site_id", urls.site_rules(F.col("include_paths"), F.col("is_own")).alias("rules"))
    rows = changes.join(rules, "site_id").filter(urls.path_included(F.col("url"), F.col("rules"))).drop("rules")
    compared = (F.col("change_type") == "changed") & F.col("old_text").isNotNull() & F.col("new_text").isNotNull()
    differs = ~normalize_for_compare("old_text").eqNullSafe(normalize_for_compare("new_text"))
    return rows.filter(~compared).unionByName(rows.filter(compared).filter(differs))


def backfill(changes: DataFrame, analysis: DataFrame, k: int = 50) -> DataFrame:
    """The oldest changes without an analysis."""
    return changes.join(analysis.select("change_id"), "change_id", "left_anti").orderBy("change_id").limit(k)


def backfill_queue(changes: DataFrame, analysis: DataFrame, sites: DataFrame, k: int = 50) -> DataFrame:
    """The oldest changes without an analysis that are still worth one: kept by the rules, and more than noise."""
    return backfill(worth_analysing(changes.join(analysis.select("change_id"), "change_id", "left_anti"), sites), analysis, k)


def run_notes(plan: DataFrame, pages: DataFrame, found: DataFrame, restored: DataFrame, top: int = 5) -> DataFrame:
    """Counts that explain a crawl: pages not looked at, failed loads, pages restored with the largest sections, moved
    ones, and those that left the crawl but are not gone (unknown ones included).

    ``restored`` has ``site_id, section, n_pages``.
    """
    a = plan.groupBy("site_id").agg(F.count("*").alias("urls_total"), F.count_if(F.col("action") == "wait").alias("waiting"))
    b = pages.groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if("failed").alias("failed"))
    gone = F.col("verdict").isin("deleted", "moved")
    c = found.groupBy("site_id").agg(F.count_if(F.col("verdict") == "moved").alias("moved"), F.count_if(~gone).alias("survived"))
    order = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("n_pages"), "section"))
    shown = F.when(F.col("nth") <= top, F.struct("nth", F.concat("section", F.lit(" ("), "n_pages", F.lit(")")).alias("s")))
    d = restored.withColumn("nth", order).groupBy("site_id").agg(
        F.sum("n_pages").alias("restored"),
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]), ", ").alias("restored_sections"),
    )
    rows = a.join(b, "site_id", "left").join(c, "site_id", "left").join(d, "site_id", "left").na.fill(0).na.fill("", ["restored_sections"])
    return rows.withColumn("is_truncated", F.col("urls_total") > F.col("pages"))
