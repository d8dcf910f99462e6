"""Queries of the report, queue and article operators, and of the parsers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitetide.functions import parsers
from sitetide.operators import marts, planning, reports, snapshots, topics
from sitetide.plans.catalog import _AT, _DIFF, _GAPS, _SHEET, NOW, _stamp, _ts, query, sheet_rows
from sitetide.plans.stand_ins import view
from sitetide.sources import sitemap, store

_CONTENT = "CASE WHEN regexp_matches(url, '/blog/') OR coalesce(category LIKE 'Новост%', false) THEN 'info' ELSE 'commerce' END"
_LABEL = """CASE WHEN sitewide_pages IS NOT NULL THEN 'Сквозное изменение' WHEN moved_to IS NOT NULL THEN 'Страница переехала'
    WHEN change_type = 'new' THEN 'Новая страница' WHEN change_type = 'changed' THEN 'Изменение' ELSE 'Страница удалена' END"""
_TO = "CASE WHEN sitewide_pages IS NOT NULL AND related_url LIKE 'http%' THEN related_url ELSE url END"
_RANK = "CASE importance WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END"


# --- queues ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY last_checked_at NULLS FIRST, url) <= 100 AS asked FROM page_states WHERE NOT is_removed""",
    "page_states",
)
def recheck_queue(spark, sf):
    missing = view(spark, sf, "page_states").filter("not is_removed").select("site_id", "url", "last_checked_at")
    return reports.recheck_queue(missing).select("site_id", "url", "asked")


@query(f"SELECT site_id, last_full_crawl_at IS NULL OR {_AT} - last_full_crawl_at >= INTERVAL 20 DAY AS full_crawl FROM sites", "sites")
def full_crawl_due(spark, sf):
    return view(spark, sf, "sites").select("site_id", reports.needs_full_crawl(F.col("last_full_crawl_at"), NOW, 20).alias("full_crawl"))


@query("SELECT site_id FROM sites WHERE NOT is_own AND NOT is_paused AND NOT is_crawling", "sites")
def nightly_sites(spark, sf):
    return reports.nightly_sites(view(spark, sf, "sites")).select("site_id")


@query(
    f"""SELECT p.site_id, p.url, p.is_removed OR r AS is_removed, {_ts(f"CASE WHEN r THEN {_AT} ELSE removed_at END")} AS removed_at
        FROM (SELECT p.*, NOT p.is_removed AND p.site_id = 1 AND e.url IS NULL AND regexp_matches(p.url, '/(blog|kurs)/') AND NOT regexp_matches(p.url, '/blog/') AS r
              FROM page_states p LEFT JOIN entries e ON e.site_id = p.site_id AND e.url = p.url) p""",
    "page_states", "entries",
)
def retired_pages(spark, sf):
    """Site 1 opened /kurs anew: its pages there that the crawl did not see are taken off the list."""
    rules = spark.createDataFrame([(1, ["/blog", "/kurs"], ["/blog"])], "site_id long, new_rules array<string>, old_rules array<string>")
    made = reports.retire_pages(view(spark, sf, "page_states"), view(spark, sf, "entries"), rules, NOW)
    return made.select("site_id", "url", "is_removed", _stamp("removed_at"))


@query("SELECT page_id, url FROM monitored ANTI JOIN structures USING (page_id) WHERE regexp_matches(url, '/(blog|news)/')", "monitored", "structures")
def pages_without_structure(spark, sf):
    return reports.without_structure(view(spark, sf, "monitored"), view(spark, sf, "structures")).select("page_id", "url")


@query(
    f"""SELECT d.site_id, d.url, page_id FROM ({_DIFF.replace("crawl_prev", "previous_pages")}) d JOIN (SELECT site_id, url, page_id FROM monitored JOIN structures USING (page_id)) s
        ON s.site_id = d.site_id AND s.url = d.url WHERE change_type <> 'removed' AND regexp_matches(d.url, '/(blog|news)/')""",
    "previous_pages", "crawl_cur", "monitored", "structures",
)
def fresh_articles(spark, sf):
    found = snapshots.snapshot_diff(view(spark, sf, "previous_pages"), view(spark, sf, "crawl_cur"), with_noise=False)
    made = view(spark, sf, "monitored").join(view(spark, sf, "structures"), "page_id").select("site_id", "url", "page_id")
    return reports.fresh_articles(found, made).select("site_id", "url", "page_id")


@query(
    f"""SELECT d.site_id, d.url, change_type FROM ({_DIFF}) d JOIN sites s ON s.site_id = d.site_id
        LEFT JOIN crawl_prev p ON p.site_id = d.site_id AND p.url = d.url LEFT JOIN crawl_cur c ON c.site_id = d.site_id AND c.url = d.url
        WHERE (change_type <> 'changed' OR regexp_replace(p.text, '\\n[0-9]+$', '') <> regexp_replace(c.text, '\\n[0-9]+$', ''))
          AND (include_paths = '' OR (include_paths = '/blog' AND regexp_matches(d.url, '/blog/')) OR (include_paths = '!/news' AND NOT regexp_matches(d.url, '/news/')))
          AND (is_own OR NOT regexp_matches(d.url, '/spo/'))""",
    "crawl_prev", "crawl_cur", "sites",
)
def worth_analysing(spark, sf):
    """Stored changes that are still kept by the rules and no noise: pages whose counter alone differs go."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    return marts.worth_analysing(found, view(spark, sf, "sites")).select("site_id", "url", "change_type")


_ALIVE = "site_id = 1 OR (site_id = 0 AND url NOT LIKE '%36') OR url LIKE '%26'"


@query(
    f"""SELECT site_id, url, {_ts("lastmod")} AS lastmod FROM entries UNION ALL
        SELECT g.site_id, g.url, {_ts("p.lastmod")} FROM ({_GAPS}) g JOIN previous_pages p ON p.site_id = g.site_id AND p.url = g.url
        JOIN (SELECT site_id, section FROM (SELECT site_id, section, url, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY site_id, section) AS total
                FROM ({_GAPS}) WINDOW w AS (PARTITION BY site_id, section ORDER BY url))
              WHERE total <= 5 OR nth IN (0, total // 5, 2 * total // 5, 3 * total // 5, 4 * total // 5)
              GROUP BY site_id, section HAVING count(*) FILTER ({_ALIVE}) * 2 > count(*)) a ON a.site_id = g.site_id AND a.section = g.section""",
    "entries", "previous_pages",
)
def restored_entries(spark, sf):
    """Entries and the pages of those gaps of whose samples most are alive."""
    entries, previous = view(spark, sf, "entries"), view(spark, sf, "previous_pages")
    checks = planning.spread_sample(planning.sitemap_gaps(entries, previous)).select("site_id", "url", F.expr(_ALIVE).alias("alive"))
    return planning.restore_gaps(entries, previous, checks).select("site_id", "url", _stamp("lastmod"))


# --- article inputs -------------------------------------------------------------------------------------------------


def _structures(spark, sf):
    heads = F.transform(F.split("heading_texts", ";"), lambda t: F.struct(F.lit(2).alias("level"), t.alias("text")))
    return view(spark, sf, "structures").withColumn("headings", heads)


@query(
    """SELECT page_id, sha256(coalesce(h1, '') || chr(10) || '2 ' || replace(heading_texts, ';', chr(10) || '2 ') || chr(10) || coalesce(main_text, '')) AS content_hash
       FROM structures""",
    "structures",
)
def intent_hash(spark, sf):
    return reports.intent_hash(_structures(spark, sf))


_LATEST = "(SELECT page_id, arg_max(text, (taken_at, snapshot_id)) AS last_text FROM texts GROUP BY page_id)"


def _pages(spark, sf):
    return view(spark, sf, "monitored").withColumn("title", F.concat(F.lit("Title "), F.col("page_id").cast("string")))


@query(
    f"""SELECT page_id, url, 'Title ' || page_id AS title, last_text AS text FROM monitored JOIN {_LATEST} USING (page_id)
        WHERE NOT is_removed AND site_id IN (SELECT site_id FROM sites WHERE is_own)""",
    "monitored", "texts", "sites",
)
def own_documents(spark, sf):
    return reports.own_documents(_pages(spark, sf), view(spark, sf, "texts"), view(spark, sf, "sites"))


@query(
    f"""SELECT page_id, url, CASE WHEN s.heading_texts IS NOT NULL THEN coalesce(nullif(h1, ''), nullif(meta_title, ''), 'Title ' || page_id) ELSE 'Title ' || page_id END AS title,
        coalesce(concat_ws(' ', topic, main_intent, subintents, entities), '') || ' ' || coalesce(replace(heading_texts, ';', ' '), '') || ' '
          || CASE WHEN s.heading_texts IS NOT NULL THEN coalesce(main_text, '') ELSE last_text END AS text
        FROM monitored LEFT JOIN structures s USING (page_id) LEFT JOIN {_LATEST} USING (page_id) LEFT JOIN cards USING (page_id)
        WHERE NOT is_removed AND regexp_matches(url, '/(blog|news)/') AND site_id IN (SELECT site_id FROM sites WHERE is_own)
          AND (s.heading_texts IS NOT NULL OR last_text IS NOT NULL)""",
    "monitored", "structures", "texts", "cards", "sites",
)
def own_articles(spark, sf):
    return reports.own_articles(_pages(spark, sf), _structures(spark, sf), view(spark, sf, "texts"), view(spark, sf, "cards"), view(spark, sf, "sites"))


@query(
    """SELECT page_id, concat_ws(' ', nullif(h1, ''), topic) AS title, concat_ws(' ', topic, main_intent, subintents, entities) || ' '
       || replace(heading_texts, ';', ' ') || ' ' || coalesce(main_text, '') AS text FROM structures JOIN cards USING (page_id)""",
    "structures", "cards",
)
def rival_articles(spark, sf):
    return reports.rival_articles(_structures(spark, sf), view(spark, sf, "cards"))


@query("SELECT page_id FROM structures LEFT JOIN cards USING (page_id) WHERE topic IS NULL OR page_id % 4 <> 0", "structures", "cards")
def cards_to_refresh(spark, sf):
    """Articles without a card, or whose content is not that of their card."""
    hashed = reports.intent_hash(_structures(spark, sf))
    had = view(spark, sf, "cards").join(hashed, "page_id").select("page_id", F.when(F.col("page_id") % 4 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return topics.cards_to_refresh(hashed, had).select("page_id")


@query(
    """SELECT m.page_id, decision_id FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'changed' ELSE 'new' END AS kind, page_id % 5 = 0 AS more FROM monitored) m
       LEFT JOIN (SELECT page_id, arg_max(decision_id, (detected_at, finding_id)) AS decision_id FROM findings GROUP BY page_id) f USING (page_id)
       WHERE kind = 'new' OR more OR decision_id IS NULL""",
    "monitored", "findings",
)
def article_cases(spark, sf):
    added = F.when(F.col("page_id") % 5 == 0, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>"))
    rows = view(spark, sf, "monitored").select("page_id", F.when(F.col("page_id") % 3 == 0, "changed").otherwise("new").alias("kind"), added.alias("added_subintents"))
    return topics.cases(rows, view(spark, sf, "findings")).select("page_id", "decision_id")


# --- comparisons and reports ----------------------------------------------------------------------------------------


@query(
    f"""SELECT site_id, url, change_type, nth, nullif(new_text, '') AS compare_text FROM (SELECT d.site_id, d.url, change_type, c.text AS new_text,
        CAST(row_number() OVER (PARTITION BY d.site_id ORDER BY change_type = 'changed', d.url) AS INT) AS nth
        FROM ({_DIFF}) d JOIN crawl_cur c ON c.site_id = d.site_id AND c.url = d.url) WHERE nth <= 10""",
    "crawl_prev", "crawl_cur",
)
def comparison_picks(spark, sf):
    return reports.comparison_picks(snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False))


@query(
    """SELECT change_id, site_id, rank, nth, more FROM (SELECT change_id, site_id, CAST(CASE verdict WHEN 'none' THEN 0 WHEN 'similar' THEN 1 ELSE 2 END AS INT) AS rank,
       CAST(row_number() OVER (PARTITION BY site_id ORDER BY our_url IS NOT NULL, change_id) AS INT) AS nth, greatest(count(*) OVER (PARTITION BY site_id) - 5, 0) AS more
       FROM compared JOIN changes USING (change_id)) WHERE nth <= 5""",
    "compared", "changes",
)
def comparison_summary(spark, sf):
    rows = view(spark, sf, "compared").join(view(spark, sf, "changes"), "change_id").withColumn("ord", F.col("change_id"))
    return reports.comparison_summary(rows).select("change_id", "site_id", reports.verdict_rank(F.col("verdict")).alias("rank"), "nth", "more")


@query(
    f"""SELECT site_id, count(*) FILTER (NOT minor) AS findings, count(*) FILTER (NOT minor AND label = 'Новая страница') AS n_new,
        count(*) FILTER (NOT minor AND label = 'Изменение') AS n_changed, count(*) FILTER (NOT minor AND label = 'Страница удалена') AS n_removed,
        count(*) FILTER (NOT minor AND label = 'Страница переехала') AS n_moved, count(*) FILTER (NOT minor AND label = 'Сквозное изменение') AS n_sitewide,
        count(*) FILTER (importance = 'high') AS n_high, count(*) FILTER (NOT minor AND kind = 'info') AS n_info,
        count(*) FILTER (NOT minor AND kind = 'commerce') AS n_commerce, count(*) FILTER (minor) AS minor
        FROM (SELECT *, {_LABEL} AS label, coalesce(importance = 'low', false) AS minor, {_CONTENT} AS kind FROM run_findings) GROUP BY site_id""",
    "run_findings",
)
def finding_counts(spark, sf):
    return reports.finding_counts(view(spark, sf, "run_findings"))


_SHORT = "trim(regexp_replace(%s, '\\s+', ' ', 'g'))"
_ROWS = "(SELECT r.*, c.verdict, c.our_url, differences, missing FROM run_findings r LEFT JOIN compared c ON c.change_id = r.ord)"


def _rows(spark, sf):
    return view(spark, sf, "run_findings").join(view(spark, sf, "compared").withColumnRenamed("change_id", "ord"), "ord", "left")


_LISTS = f"""SELECT site_id, list, nth, line, url, total FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id, list ORDER BY rank, ord) AS INT) AS nth,
        count(*) OVER (PARTITION BY site_id, list) AS total FROM (
        SELECT site_id, 'important' AS list, 0 AS rank, ord, {_SHORT % "coalesce(nullif(importance_reason, ''), summary)"} AS line, {_TO} AS url FROM {_ROWS} WHERE importance = 'high'
        UNION ALL SELECT site_id, 'missing', {_RANK}, ord, {_SHORT % "summary"}, {_TO} FROM {_ROWS} WHERE verdict = 'none' AND importance IS DISTINCT FROM 'low'
        UNION ALL SELECT site_id, 'missing', 3, change_id, {_SHORT % "coalesce(missing, '')"}, url FROM compared JOIN changes USING (change_id) WHERE verdict = 'none')) WHERE nth <= 5"""


@query(
    _LISTS,
    "run_findings", "compared", "changes",
)
def report_lists(spark, sf):
    """Important findings, and what the own site lacks: findings by importance, then first comparisons."""
    first = view(spark, sf, "compared").join(view(spark, sf, "changes"), "change_id").select("site_id", "url", "verdict", "missing", F.col("change_id").alias("ord"))
    return reports.report_lists(_rows(spark, sf), first)


@query(
    f"""SELECT site_id, nth, label, url FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY part, rank, ord) AS INT) AS nth FROM (
        SELECT site_id, 0 AS part, {_RANK} AS rank, ord, CASE WHEN sitewide_pages IS NOT NULL THEN 'Сквозное изменение на ' || sitewide_pages || ' стр.' ELSE {_LABEL} END AS label, {_TO} AS url
        FROM run_findings WHERE importance IS DISTINCT FROM 'low'
        UNION ALL SELECT site_id, 1, CASE WHEN verdict = 'none' THEN 0 ELSE 1 END, change_id, 'Первый обход', url FROM compared JOIN changes USING (change_id))) WHERE nth <= 40""",
    "run_findings", "compared", "changes",
)
def overview_items(spark, sf):
    first = view(spark, sf, "compared").join(view(spark, sf, "changes"), "change_id").select("site_id", "url", "verdict", F.col("change_id").alias("ord"))
    return reports.overview_items(view(spark, sf, "run_findings"), first)


@query(
    f"""SELECT strftime(detected_at, '%Y-%m-%d' || chr(10) || '%H:%M') AS detected,
        CASE WHEN moved_to IS NOT NULL THEN 'Страница переехала' WHEN change_type = 'new' THEN 'Новая страница' WHEN change_type = 'changed' THEN 'Изменение' ELSE 'Страница удалена' END
          || CASE importance WHEN 'high' THEN chr(10) || '🔥 Важно' WHEN 'low' THEN chr(10) || 'Мелочь' ELSE '' END AS type,
        url, coalesce(category, '') AS category, CASE {_CONTENT} WHEN 'info' THEN 'Инфо (SEO)' ELSE 'Коммерция (продукт)' END AS kind, coalesce(usp, '') AS usp, coalesce(cta, '') AS cta,
        concat_ws(chr(10), summary, 'Новый адрес: ' || moved_to, 'Теперь там: ' || moved_summary,
          CASE WHEN importance = 'high' AND importance_reason <> '' THEN 'Почему важно: ' || importance_reason END) AS description,
        concat_ws(chr(10), CASE verdict WHEN 'exact' THEN 'У нас такое есть' WHEN 'similar' THEN 'У нас похожее есть' WHEN 'none' THEN 'У нас такого нет' END, our_url) AS verdict,
        concat_ws(chr(10), 'Отличия: ' || differences, 'Чего нам не хватает: ' || missing) AS details FROM {_ROWS}""",
    "run_findings", "compared",
)
def report_rows(spark, sf):
    return reports.report_rows(_rows(spark, sf))


@query(
    f"""SELECT strftime(detected_at, '%Y-%m-%d' || chr(10) || '%H:%M') AS detected, 'Сквозное изменение' || chr(10) || 'на ' || sitewide_pages || ' стр.'
          || CASE importance WHEN 'high' THEN chr(10) || '🔥 Важно' WHEN 'low' THEN chr(10) || 'Мелочь' ELSE '' END AS type,
        concat_ws(chr(10), CASE WHEN related_url LIKE 'http%' THEN 'Ведёт на: ' || related_url END, 'Примеры:', url || '/1', url || '/2', url || '/3',
          CASE WHEN sitewide_pages > 3 THEN 'и ещё ' || (sitewide_pages - 3) END) AS url,
        coalesce(category, '') AS category, CASE {_CONTENT} WHEN 'info' THEN 'Инфо (SEO)' ELSE 'Коммерция (продукт)' END AS kind, coalesce(usp, '') AS usp, coalesce(cta, '') AS cta,
        CASE WHEN ord % 39 = 0 THEN 'Блок изменился на многих страницах сразу.' ELSE summary END
          || CASE WHEN importance = 'high' AND importance_reason <> '' THEN chr(10) || 'Почему важно: ' || importance_reason ELSE '' END AS description, '' AS verdict, '' AS details
        FROM run_findings WHERE sitewide_pages IS NOT NULL""",
    "run_findings",
)
def shared_report_rows(spark, sf):
    """One row for each block that many pages share; some have no summary."""
    rows = view(spark, sf, "run_findings").filter("sitewide_pages is not null")
    pages = F.transform(F.sequence(F.lit(1).cast("long"), F.col("sitewide_pages").cast("long")), lambda k: F.concat("url", F.lit("/"), k.cast("string")))
    return reports.shared_rows(rows.withColumns({"urls": pages, "n_pages": F.col("sitewide_pages"), "summary": F.when(F.col("ord") % 39 == 0, "").otherwise(F.col("summary"))}))


@query(
    "SELECT 'За эту неделю новых и изменённых инфостатей конкурентов не найдено.' AS topic, '2030-01-07' AS week, CAST(NULL AS BIGINT) AS decision_id"
    f" WHERE NOT EXISTS (SELECT 1 FROM ({_SHEET.replace('FROM sheet_rows', 'FROM (SELECT * FROM findings JOIN decisions USING (decision_id))')}) WHERE week = '2030-01-07')",
    "findings", "decisions",
)
def empty_week(spark, sf):
    return marts.empty_week(marts.week_sheet(sheet_rows(spark, sf)), "2030-01-07").select("topic", "week", "decision_id")


# --- counters -------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT decision_id, decision, {_ts("updated_at")} AS updated_at, coalesce(n, 0) AS findings, CAST(coalesce(s, 0) AS INT) AS sites FROM decisions LEFT JOIN
        (SELECT decision_id, count(*) AS n, count(DISTINCT site_id) AS s FROM findings GROUP BY decision_id) USING (decision_id)""",
    "findings", "decisions",
)
def decision_tallies(spark, sf):
    made = reports.decision_tallies(view(spark, sf, "findings"), view(spark, sf, "decisions"))
    return made.select("decision_id", "decision", _stamp("updated_at"), "findings", "sites")


@query(
    """SELECT site_id AS run_id, count(*) FILTER (decision = 'new') AS n_new, count(*) FILTER (decision = 'update') AS n_update, count(*) FILTER (decision = 'covered') AS n_covered,
       count(*) FILTER (merged) AS merged, count(*) FILTER (decision IS NULL AND NOT merged) AS not_compared
       FROM (SELECT site_id, page_id % 4 = 1 AS merged, CASE WHEN page_id % 5 <> 0 THEN decision END AS decision FROM findings JOIN decisions USING (decision_id)) GROUP BY site_id""",
    "findings", "decisions",
)
def run_tallies(spark, sf):
    rows = view(spark, sf, "findings").join(view(spark, sf, "decisions"), "decision_id")
    return reports.run_tallies(rows.select(F.col("site_id").alias("run_id"), (F.col("page_id") % 4 == 1).alias("merged"), F.when(F.col("page_id") % 5 != 0, F.col("decision")).alias("decision")))


@query(
    """SELECT finding_id, decision, m.url, name FROM findings f JOIN decisions d USING (decision_id) JOIN monitored m ON m.page_id = f.page_id JOIN sites s ON s.site_id = m.site_id""",
    "findings", "decisions", "monitored", "sites",
)
def topic_list(spark, sf):
    made = reports.topic_list(view(spark, sf, "findings"), view(spark, sf, "decisions"), view(spark, sf, "monitored"), view(spark, sf, "sites"))
    return made.select("finding_id", "decision", "url", "name")


@query(
    f"""SELECT s.site_id, name, is_own, coalesce(pages, 0) AS pages, coalesce(fetched, 0) AS fetched, coalesce(n_new, 0) AS n_new, coalesce(n_changed, 0) AS n_changed,
        coalesce(n_removed, 0) AS n_removed FROM sites s LEFT JOIN (SELECT site_id, count(*) AS pages FROM monitored WHERE NOT is_removed GROUP BY site_id) USING (site_id)
        LEFT JOIN (SELECT site_id, count(*) AS fetched FROM entries GROUP BY site_id) USING (site_id)
        LEFT JOIN (SELECT site_id, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'changed') AS n_changed,
          count(*) FILTER (change_type = 'removed') AS n_removed FROM changes WHERE detected_at >= {_AT} - INTERVAL 30 DAY GROUP BY site_id) USING (site_id)""",
    "sites", "monitored", "entries", "changes",
)
def site_cards(spark, sf):
    return reports.site_cards(view(spark, sf, "sites"), view(spark, sf, "monitored"), view(spark, sf, "changes"), view(spark, sf, "entries"), NOW)


@query("SELECT change_type, count(*) AS n FROM changes WHERE site_id IN (SELECT site_id FROM sites WHERE is_own) GROUP BY change_type", "changes", "sites")
def own_counts(spark, sf):
    return reports.own_counts(view(spark, sf, "changes"), view(spark, sf, "sites"))


@query(
    f"""SELECT site_id, {_ts(f"CASE WHEN is_paused THEN next_crawl_at WHEN cookies_only THEN NULL ELSE {_AT} END")} AS next_crawl_at,
        CAST(row_number() OVER (ORDER BY created_at DESC, site_id DESC) AS INT) AS nth FROM sites""",
    "sites",
)
def planned_crawls(spark, sf):
    """Next crawls after a new plan; sites are listed by their date of entry, newest first."""
    rows = reports.planned_crawls(view(spark, sf, "sites"), NOW)
    nth = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("site_id")))  # sites are few
    return rows.withColumn("nth", nth).select("site_id", _stamp("next_crawl_at"), "nth")


@query("SELECT coalesce(string_agg(name, ', ' ORDER BY site_id), '') AS names FROM sites WHERE cookies_only AND NOT is_paused AND NOT is_own", "sites")
def cookie_reminder(spark, sf):
    return reports.cookie_reminder(view(spark, sf, "sites"))


@query("SELECT site_id FROM sites WHERE NOT is_own AND (name = 'Supplier_3' OR site_id = 5 OR site_id % 10 = 8)", "sites")
def picked_sites(spark, sf):
    return reports.pick_sites(view(spark, sf, "sites"), ["Supplier_3", "5", "8.example"]).select("site_id")


@query("SELECT site_id, least(count(*), 20) AS n FROM monitored WHERE NOT is_removed AND regexp_matches(url, '/(blog|news)/') GROUP BY site_id", "monitored")
def pilot_sample(spark, sf):
    """How many articles of each site a pilot of twenty takes; which ones depends on a hash."""
    return reports.pilot_sample(view(spark, sf, "monitored"), 20).groupBy("site_id").agg(F.count("*").alias("n"))


@query("SELECT name, domain FROM cookies WHERE name LIKE 'qrator_jsid%' AND NOT session AND expires <= 40.0", "cookies")
def expired_cookies(spark, sf):
    return reports.expired_guards(view(spark, sf, "cookies"), 40.0).select("name", "domain")


@query(
    r"""SELECT DISTINCT site_id, d AS domain FROM (SELECT site_id, regexp_replace(regexp_extract(base_url, '^https?://([^/]*)', 1), '^www\.', '') AS host FROM sites),
        (SELECT DISTINCT lower(ltrim(domain, '.')) AS d FROM cookies) WHERE host = d OR host LIKE '%.' || d OR d LIKE '%.' || host""",
    "sites", "cookies",
)
def cookie_sites(spark, sf):
    """Every third address is written with capitals, a user and a port."""
    odd = F.concat(F.lit("https://me@"), F.upper(F.regexp_extract("base_url", "^https://([^/]*)", 1)), F.lit(":443/"))
    sites = view(spark, sf, "sites").withColumn("base_url", F.when(F.col("site_id") % 3 == 0, odd).otherwise(F.col("base_url")))
    return reports.sites_of_cookies(sites, view(spark, sf, "cookies"))


# --- sources and answers --------------------------------------------------------------------------------------------


@query(
    """SELECT site_id, 'https://site' || site_id || '.example/sitemap.xml' AS source, url, '2024-01-05' AS lastmod FROM monitored WHERE site_id < 2
       UNION ALL SELECT site_id, 'https://site' || site_id || '.example/part' || (page_id % 2) || '.xml', url, '2024-01-05' FROM monitored WHERE site_id >= 2""",
    "monitored",
)
def sitemap_files(spark, sf):
    """Sites 0 and 1 list their parts in an index, which takes the place of the parts; the others have parts only."""
    part = F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example/part"), (F.col("page_id") % 2).cast("string"), F.lit(".xml"))
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc><lastmod>2024-01-05</lastmod></url>"))
    rows = view(spark, sf, "monitored").select("site_id", part.alias("url"), entry.alias("e"))
    parts = rows.groupBy("site_id", "url").agg(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</urlset>")).alias("body"))
    found = F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "")
    heads = parts.filter("site_id < 2").groupBy("site_id").agg(F.concat(F.lit("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), found, F.lit("</sitemapindex>")).alias("body"))
    heads = heads.select("site_id", F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example/sitemap.xml")).alias("url"), "body")
    files = parts.unionByName(heads).select("site_id", "url", F.col("body").cast("binary").alias("body"), F.lit(200).alias("status"))
    return sitemap.read_sitemaps(files)


@query(
    """SELECT site_id, url, '2024-01-06 00:00:00' AS lastmod FROM monitored WHERE page_id % 5 <> 3""",
    "monitored",
)
def normal_entries(spark, sf):
    """Each address twice, with and without a closing slash, the later one counts; some of another host, some files."""
    base = F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example"))
    rows = view(spark, sf, "monitored").withColumn("base_url", base)
    other = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("https://other.example/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 10 == 8, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url"))
    one = rows.select("site_id", "base_url", F.lit(1).alias("pos"), F.concat(other, F.lit("")).alias("url"), F.lit("2024-01-05").alias("lastmod"))
    two = rows.filter("page_id % 10 not in (3, 8)").select("site_id", "base_url", F.lit(2).alias("pos"), F.concat("url", F.lit("/#top")).alias("url"), F.lit("2024-01-06T00:00:00Z").alias("lastmod"))
    return sitemap.to_entries(one.unionByName(two)).select("site_id", "url", _stamp("lastmod"))


@query(
    f"""SELECT site_id, url, {_ts("max(last_checked_at)")} AS fetched_at FROM page_states WHERE last_checked_at > {_AT} - INTERVAL 12 DAY GROUP BY site_id, url""",
    "page_states",
)
def resume_hits(spark, sf):
    cache = view(spark, sf, "page_states").select("site_id", "url", F.col("last_checked_at").alias("fetched_at"))
    return store.resume_hits(cache, NOW, 12 * 24).select("site_id", "url", _stamp("fetched_at"))


_SAID = "CASE change_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'Covered' WHEN 2 THEN 'new' ELSE 'perhaps' END"


@query(
    f"""SELECT change_id AS batch_id, n, CASE WHEN our_url IS NULL THEN 'new' ELSE said END AS decision, our_url,
        CASE WHEN our_url IS NULL THEN 'none' WHEN said = 'update' THEN 'partial' WHEN said = 'new' THEN 'none' ELSE 'full' END AS coverage
        FROM (SELECT change_id, 1 AS n, lower({_SAID}) AS said, CASE WHEN change_id % 3 = 0 THEN 'https://own.example/' || change_id END AS our_url FROM changes WHERE change_id % 4 <> 3
              UNION ALL SELECT change_id, 2, 'new', NULL FROM changes)""",
    "changes",
)
def match_results(spark, sf):
    """Two answers of a batch: the first may name a page that was not offered, the second has none; a third is out of range."""
    offered = F.concat(F.lit("https://own.example/"), F.col("change_id").cast("string"))
    named = F.when(F.col("change_id") % 3 == 0, offered).when(F.col("change_id") % 3 == 1, "https://unknown.example").otherwise("")
    raw = F.format_string('So: {"results": [{"n": 1, "decision": " %s ", "our_url": "%s"}, {"n": "2", "decision": "new"}, {"n": 3, "decision": "new"}]} end', F.expr(_SAID), named)
    rows = view(spark, sf, "changes").select(F.col("change_id").alias("batch_id"), F.array(F.array(offered), F.array(F.lit("x"))).alias("candidates"), raw.alias("raw"))
    return parsers.match_results(rows).select("batch_id", "n", "decision", "our_url", "coverage")


@query(
    """SELECT change_id AS batch_id, 1 AS n, 'Topic ' || page_id AS topic, CASE WHEN change_id % 2 = 0 THEN 'Intent' ELSE 'Topic ' || page_id END AS main_intent,
       CASE WHEN change_id % 5 = 0 THEN 'чек-лист' ELSE 'другое' END AS material_type, 'a,b' AS subintents FROM changes""",
    "changes",
)
def intent_cards(spark, sf):
    """One card of each answer: a topic stands in for a missing intent, kinds are known ones, empty subintents go."""
    raw = F.format_string(
        '{"cards": [{"n": 1, "topic": "old"}, {"n": 1, "topic": "Topic %d", "main_intent": "%s", "subintents": ["a", " ", "b"], "material_type": "%s"}, {"n": 7, "topic": "x"}]}',
        F.col("page_id"), F.when(F.col("change_id") % 2 == 0, "Intent").otherwise(""), F.when(F.col("change_id") % 5 == 0, "Чек-лист для мам").otherwise("поэма"),
    )
    rows = view(spark, sf, "changes").select(F.col("change_id").alias("batch_id"), F.lit(2).alias("size"), raw.alias("raw"))
    return parsers.intent_cards(rows).select("batch_id", "n", "topic", "main_intent", "material_type", F.array_join("subintents", ",").alias("subintents"))


@query(
    f"""SELECT change_id, name FROM changes JOIN sites USING (site_id)
        WHERE change_type = 'new' AND site_id % 2 = 0 AND url LIKE '%blog/%' AND NOT is_own AND detected_at >= {_AT} - INTERVAL 30 DAY""",
    "changes", "sites",
)
def feed_search(spark, sf):
    """New pages of rivals whose address holds a text, of the last thirty days, on sites with even ids."""
    rows = marts.feed(view(spark, sf, "changes"), view(spark, sf, "sites"), view(spark, sf, "analysis"), kind="new", q="BLOG/", since="2024-01-01 00:00:00")
    return rows.filter("site_id % 2 = 0").select("change_id", "name")


@query(
    "SELECT change_id, name FROM changes JOIN sites USING (site_id) WHERE site_id = 3 AND importance = 'high'",
    "changes", "sites",
)
def feed_of_site(spark, sf):
    rows = marts.feed(view(spark, sf, "changes"), view(spark, sf, "sites"), view(spark, sf, "analysis"), site=3, high=True)
    return rows.select("change_id", "name")
