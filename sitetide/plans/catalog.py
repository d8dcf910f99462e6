"""All queries of the change-intelligence engine by name, each with the SQL of its result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.functions import diffs, markup, noise, parsers, text, urls
from sitetide.operators import marts, planning, similarity, sitewide, snapshots, topics
from sitetide.plans.stand_ins import duck, view
from sitetide.sources import sitemap, store
from sitetide.session import written

NOW = "2024-01-31 00:00:00"
SINCE = "2024-01-24 00:00:00"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a query, and its SQL over the named stand-ins."""

    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = duck(sql, *names)
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- differences of crawls ------------------------------------------------------------------------------------------

_DIFF = """
SELECT coalesce(p.site_id, c.site_id) AS site_id, coalesce(p.url, c.url) AS url,
       CASE WHEN p.url IS NULL THEN 'new' WHEN c.url IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM crawl_prev p FULL JOIN crawl_cur c ON p.site_id = c.site_id AND p.url = c.url
WHERE p.url IS NULL OR c.url IS NULL OR p.text IS DISTINCT FROM c.text"""


@query(f"SELECT change_type, count(*) AS n FROM ({_DIFF}) GROUP BY change_type", "crawl_prev", "crawl_cur")
def snapshot_diff_counts(spark, sf):
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    return found.groupBy("change_type").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM ({_DIFF}) WHERE CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 10 <> 3", "crawl_prev", "crawl_cur")
def snapshot_diff_rows(spark, sf):
    """Changes without those that are noise: pages whose view counter alone differs stay out."""
    return snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur")).select("site_id", "url", "change_type")


def _diffs(spark, sf):
    return snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"))


@query()
def unified_diff(spark, sf):
    return snapshots.with_diff_text(_diffs(spark, sf)).select("site_id", "url", "change_type", "diff_text")


@query()
def diff_hunks(spark, sf):
    """Each island of changed lines as a row: where it lies in both texts, and how many lines it removes and adds."""
    rows = _diffs(spark, sf).filter("change_type = 'changed'").withColumn("d", diffs.opcodes("stripped")("old_text", "new_text"))
    each = diffs.with_hunks(rows, "d").select("site_id", "url", F.posexplode("hunks").alias("nth", "h"))
    of = lambda mark: F.size(F.filter("h.lines", lambda x: F.startswith(x, F.lit(mark))))
    return each.select("site_id", "url", "nth", "h.i1", "h.i2", "h.j1", "h.j2", of("-").alias("removed"), of("+").alias("added"))


@query()
def side_by_side(spark, sf):
    rows = _diffs(spark, sf).filter("change_type = 'changed'")
    rows = rows.select("site_id", "url", diffs.opcodes("worded")("old_text", "new_text").alias("d"))
    return rows.select("site_id", "url", F.posexplode(diffs.side_by_side(F.col("d"))).alias("pos", "r")).select("site_id", "url", "pos", "r.*")


@query()
def sitewide_groups(spark, sf):
    return sitewide.groups(sitewide.marked_lines(_diffs(spark, sf))).select("site_id", "n_pages", "first_url", "lines")


@query()
def sitewide_own_changes(spark, sf):
    return sitewide.own_changes(sitewide.marked_lines(_diffs(spark, sf)))


@query()
def normalize_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", text.content_hash(noise.normalize_for_compare("text")).alias("content_hash"))


_VERDICT = """
SELECT site_id, url, CASE WHEN status IS NULL THEN 'unknown' WHEN status IN (404, 410) THEN 'deleted' WHEN status >= 400 THEN 'unknown'
       WHEN regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/$', '')
            <> regexp_replace(regexp_replace(final_url, '^https?://(www\\.)?', ''), '/$', '') THEN 'moved' ELSE 'still_alive' END AS verdict
FROM responses"""


@query(_VERDICT, "responses")
def recheck_verdicts(spark, sf):
    return snapshots.verdicts(view(spark, sf, "responses")).select("site_id", "url", "verdict")


@query(
    f"SELECT d.site_id, d.url, change_type, verdict FROM ({_DIFF}) d LEFT JOIN ({_VERDICT}) v ON d.site_id = v.site_id AND d.url = v.url "
    "WHERE change_type <> 'removed' OR coalesce(verdict IN ('deleted', 'moved'), false)",
    "crawl_prev", "crawl_cur", "responses",
)
def real_changes(spark, sf):
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    return snapshots.real_changes(found, snapshots.verdicts(view(spark, sf, "responses"))).select("site_id", "url", "change_type", "verdict")


def _ts(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


_AT = f"TIMESTAMP '{NOW}'"


@query(
    f"""SELECT coalesce(p.site_id, s.site_id) AS site_id, coalesce(p.url, s.url) AS url, {_ts(f"coalesce(first_seen_at, {_AT})")} AS first_seen_at,
        {_ts(f"CASE WHEN s.url IS NOT NULL THEN {_AT} ELSE last_seen_at END")} AS last_seen_at,
        CASE WHEN s.url IS NOT NULL THEN false WHEN coalesce(verdict IN ('deleted', 'moved'), false) THEN true ELSE p.is_removed END AS is_removed,
        {_ts(f"CASE WHEN s.url IS NOT NULL THEN NULL WHEN verdict IN ('deleted', 'moved') THEN {_AT} ELSE removed_at END")} AS removed_at,
        CASE WHEN s.url IS NOT NULL THEN NULL WHEN verdict IN ('deleted', 'moved') THEN verdict WHEN verdict IS NOT NULL THEN 'missing_from_crawl'
          ELSE disappearance_reason END AS disappearance_reason,
        CASE WHEN s.url IS NOT NULL THEN NULL WHEN verdict = 'moved' THEN final_url ELSE redirect_to_url END AS redirect_to_url,
        CASE WHEN s.url IS NULL THEN redirect_target_summary END AS redirect_target_summary,
        {_ts("CASE WHEN s.url IS NOT NULL THEN coalesce(s.lastmod, sitemap_lastmod) ELSE sitemap_lastmod END")} AS sitemap_lastmod,
        {_ts(f"CASE WHEN s.url IS NOT NULL OR verdict IS NOT NULL THEN {_AT} ELSE last_checked_at END")} AS last_checked_at
        FROM page_states p FULL JOIN entries s ON p.site_id = s.site_id AND p.url = s.url
        LEFT JOIN (SELECT v.*, final_url FROM ({_VERDICT}) v JOIN responses r ON r.site_id = v.site_id AND r.url = v.url
                   WHERE CAST(regexp_extract(v.url, '([0-9]+)$', 1) AS BIGINT) % 3 <> 2) v
          ON v.site_id = coalesce(p.site_id, s.site_id) AND v.url = coalesce(p.url, s.url)""",
    "page_states", "entries", "responses",
)
def page_lifecycle(spark, sf):
    """The state of every page after a crawl in which a third of the missing pages was not asked about."""
    asked = view(spark, sf, "responses").filter(F.regexp_extract("url", "([0-9]+)$", 1).cast("long") % 3 != 2)
    state = snapshots.fold_pages(view(spark, sf, "page_states"), view(spark, sf, "entries"), snapshots.verdicts(asked), NOW)
    times = ("first_seen_at", "last_seen_at", "removed_at", "sitemap_lastmod", "last_checked_at")
    return state.select(*[_stamp(c) if c in times else c for c in state.columns])


@query(
    f"""SELECT site_id, change_type = 'new' AND site_id = 1 AND NOT regexp_matches(url, '/blog/') AS is_baseline, count(*) AS n
        FROM ({_DIFF}) GROUP BY ALL""",
    "crawl_prev", "crawl_cur",
)
def reopened_sections(spark, sf):
    """New pages outside the rules that site 1 had before are a baseline."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    rules = spark.createDataFrame([(1, ["/blog"])], "site_id long, rules array<string>")
    return snapshots.split_reopened(found, rules).groupBy("site_id", "is_baseline").agg(F.count("*").alias("n"))


# --- crawl planning -------------------------------------------------------------------------------------------------

_PLAN = """
SELECT e.site_id, e.url, CASE WHEN p.url IS NULL THEN 0 WHEN e.lastmod > p.lastmod THEN 1 WHEN e.lastmod IS NULL OR p.lastmod IS NULL THEN 2 END AS priority,
       p.url IS NOT NULL AS known
FROM entries e LEFT JOIN previous_pages p ON e.site_id = p.site_id AND e.url = p.url"""


@query(f"SELECT site_id, url, CASE WHEN priority IS NULL THEN 'carry' ELSE 'fetch' END AS action, priority FROM ({_PLAN})", "entries", "previous_pages")
def crawl_plan(spark, sf):
    return planning.crawl_plan(view(spark, sf, "entries"), view(spark, sf, "previous_pages"), 1 << 30)


@query(
    f"""SELECT site_id, url, CASE WHEN (q = 0 AND nth <= 40) OR (q = 1 AND nth <= 10) THEN 'fetch' WHEN known THEN 'carry' ELSE 'wait' END AS action, priority
        FROM (SELECT *, row_number() OVER (PARTITION BY site_id, q ORDER BY priority, url) AS nth
              FROM (SELECT *, CASE WHEN priority IS NULL THEN 2 WHEN priority = 2 THEN 1 ELSE 0 END AS q FROM ({_PLAN})))""",
    "entries", "previous_pages",
)
def crawl_plan_capped(spark, sf):
    return planning.crawl_plan(view(spark, sf, "entries"), view(spark, sf, "previous_pages"), 40, 10)


_GAPS = r"""
SELECT site_id, CASE WHEN mass THEN '*' ELSE section END AS section, url FROM (
  SELECT m.site_id, m.url, m.section, lost >= 50 AND lost >= known * 0.5 AS mass,
         count(*) OVER (PARTITION BY m.site_id, m.section) >= 10 AND l.section IS NULL AS gone
  FROM (SELECT p.site_id, p.url, '/' || regexp_extract(p.url, '^https://[^/]*/([^/]*)', 1) AS section
        FROM previous_pages p ANTI JOIN entries e ON p.site_id = e.site_id AND p.url = e.url) m
  JOIN (SELECT p.site_id, count(*) AS known, count(*) FILTER (e.url IS NULL) AS lost
        FROM previous_pages p LEFT JOIN entries e ON p.site_id = e.site_id AND p.url = e.url GROUP BY p.site_id) s ON s.site_id = m.site_id
  LEFT JOIN (SELECT DISTINCT site_id, '/' || regexp_extract(url, '^https://[^/]*/([^/]*)', 1) AS section FROM entries) l
    ON l.site_id = m.site_id AND l.section = m.section)
WHERE mass OR gone"""


@query(_GAPS, "entries", "previous_pages")
def sitemap_gaps(spark, sf):
    return planning.sitemap_gaps(view(spark, sf, "entries"), view(spark, sf, "previous_pages"))


@query(
    f"""SELECT site_id, section, url FROM (SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY site_id, section) AS total
        FROM ({_GAPS}) WINDOW w AS (PARTITION BY site_id, section ORDER BY url))
        WHERE total <= 5 OR nth IN (0, total // 5, 2 * total // 5, 3 * total // 5, 4 * total // 5)""",
    "entries", "previous_pages",
)
def systematic_sample(spark, sf):
    return planning.spread_sample(planning.sitemap_gaps(view(spark, sf, "entries"), view(spark, sf, "previous_pages")))


@query(
    f"""SELECT site_id, '/' || regexp_extract(url, '^https://[^/]*/([^/]*)', 1) AS section, count(*) AS n_pages FROM ({_GAPS}) GROUP BY ALL""",
    "entries", "previous_pages",
)
def restored_sections(spark, sf):
    return planning.restored_counts(planning.sitemap_gaps(view(spark, sf, "entries"), view(spark, sf, "previous_pages")))


_ACTIONS = f"""SELECT site_id, url, CASE WHEN q = 0 AND nth <= 40 THEN 'fetch' WHEN known THEN 'carry' ELSE 'wait' END AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id, q ORDER BY priority, url) AS nth
          FROM (SELECT *, CASE WHEN priority IS NULL THEN 2 ELSE 0 END AS q FROM ({_PLAN})))"""


@query(
    f"""SELECT a.site_id, urls_total, waiting, coalesce(pages, 0) AS pages, coalesce(failed, 0) AS failed, coalesce(moved, 0) AS moved,
        coalesce(survived, 0) AS survived, coalesce(restored, 0) AS restored, coalesce(restored_sections, '') AS restored_sections,
        urls_total > coalesce(pages, 0) AS is_truncated
        FROM (SELECT site_id, count(*) AS urls_total, count(*) FILTER (action = 'wait') AS waiting FROM ({_ACTIONS}) GROUP BY site_id) a
        LEFT JOIN (SELECT x.site_id, count(*) AS pages, count(*) FILTER (action = 'fetch' AND c.text IS NULL) AS failed
                   FROM ({_ACTIONS}) x LEFT JOIN crawl_cur c ON c.site_id = x.site_id AND c.url = x.url
                   LEFT JOIN previous_pages p ON p.site_id = x.site_id AND p.url = x.url
                   WHERE action <> 'wait' AND CASE WHEN action = 'fetch' THEN coalesce(c.text, p.text) ELSE p.text END IS NOT NULL GROUP BY x.site_id) b
          ON b.site_id = a.site_id
        LEFT JOIN (SELECT site_id, count(*) FILTER (verdict = 'moved') AS moved, count(*) FILTER (verdict NOT IN ('deleted', 'moved')) AS survived
                   FROM ({_VERDICT}) GROUP BY site_id) c ON c.site_id = a.site_id
        LEFT JOIN (SELECT site_id, CAST(sum(n) AS BIGINT) AS restored, string_agg(section || ' (' || n || ')', ', ' ORDER BY n DESC, section) FILTER (nth <= 5) AS restored_sections
                   FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, section) AS nth
                         FROM (SELECT site_id, '/' || regexp_extract(url, '^https://[^/]*/([^/]*)', 1) AS section, count(*) AS n FROM ({_GAPS}) GROUP BY ALL))
                   GROUP BY site_id) d ON d.site_id = a.site_id""",
    "entries", "previous_pages", "crawl_cur", "responses",
)
def run_notes(spark, sf):
    plan = planning.crawl_plan(view(spark, sf, "entries"), view(spark, sf, "previous_pages"), 40)
    pages = planning.assemble(plan, view(spark, sf, "crawl_cur"), view(spark, sf, "previous_pages"))
    back = planning.restored_counts(planning.sitemap_gaps(view(spark, sf, "entries"), view(spark, sf, "previous_pages")))
    return marts.run_notes(plan, pages, snapshots.verdicts(view(spark, sf, "responses")), back)


@query(
    r"""SELECT page_id, url, CASE WHEN regexp_matches(url, '/(news|spo)/') THEN false
        WHEN regexp_matches(url, '/(blog|kurs)/') THEN true ELSE false END AS included FROM monitored""",
    "monitored",
)
def path_filter(spark, sf):
    rules = urls.site_rules(F.lit("blog/, /kur*\n!/news"), F.lit(False))
    return view(spark, sf, "monitored").select("page_id", "url", urls.path_included(F.col("url"), rules).alias("included"))


@query(
    """SELECT section, added, removed FROM (SELECT '/' || regexp_extract(url, '^https://[^/]*/([^/]*)', 1) AS section,
       CASE WHEN regexp_matches(url, '/blog/') THEN 0 ELSE count(*) END AS added, CASE WHEN regexp_matches(url, '/blog/') THEN count(*) ELSE 0 END AS removed
       FROM monitored WHERE NOT regexp_matches(url, '/news/') GROUP BY regexp_matches(url, '/blog/'), section) ORDER BY added + removed DESC, section LIMIT 8""",
    "monitored",
)
def rules_what_if(spark, sf):
    before, after = urls.parse_rules(F.lit("/blog /news")), urls.parse_rules(F.lit("!/blog"))
    return planning.what_if(view(spark, sf, "monitored"), before, after)


# --- addresses and pages --------------------------------------------------------------------------------------------


_FORMS = """(SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/Price.PDF?x=1' WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '/a.pdf/' ELSE regexp_replace(url, '[?#].*$', '') || '/b.docx#top' END AS url FROM pages)"""


def _forms(spark, sf):
    """Addresses of pages, of files with a query, of folders named like files, and of files with a fragment."""
    bare, kind = F.regexp_replace("url", "[?#].*$", ""), F.col("page_id") % 4
    made = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat("url", F.lit("/Price.PDF?x=1"))).when(kind == 2, F.concat(bare, F.lit("/a.pdf/"))).otherwise(F.concat(bare, F.lit("/b.docx#top")))
    return view(spark, sf, "pages").select("page_id", made.alias("url"))


@query(
    rf"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), ''), regexp_replace(url, '#.*$', '')) AS normalized,
        '/' || regexp_extract(url, '^https?://[^/?#]*/([^/?#]*)', 1) AS section, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') AS domain,
        regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\.(pdf|docx)$') AS is_file FROM {_FORMS}"""
)
def url_normalize(spark, sf):
    u = F.col("url")
    return _forms(spark, sf).select("page_id", urls.normalize_url(u).alias("normalized"), urls.section(u).alias("section"), urls.domain(u).alias("domain"), urls.is_file(u).alias("is_file"))


@query(
    r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '?id=' || page_id WHEN 2 THEN '?a=1&b=2#part' WHEN 3 THEN '' ELSE '?page=2' END AS url FROM pages"""
)
def url_strip_tracking(spark, sf):
    """Marks of several systems, alone, between and behind other parameters, in any case."""
    bare, k = F.regexp_replace("url", "[?#].*$", ""), F.col("page_id") % 5
    tail = (
        F.when(k == 0, F.lit("?utm_source=x&utm_medium=y")).when(k == 1, F.concat(F.lit("?gclid=7&id="), F.col("page_id").cast("string"), F.lit("&YCLID=8")))
        .when(k == 2, F.lit("?a=1&fbclid=q&b=2&_ga=1.2#part")).when(k == 3, F.lit("?_openstat=abc&_gl=1")).otherwise(F.lit("?page=2&Utm_campaign=z"))
    )
    return view(spark, sf, "pages").select("page_id", urls.strip_tracking(F.concat(bare, tail)).alias("url"))


@query(
    r"""SELECT CASE WHEN regexp_matches(url, '/blog/') OR coalesce(category LIKE 'Новост%', false) THEN 'info' ELSE 'commerce' END AS kind, count(*) AS n
        FROM changes LEFT JOIN analysis USING (change_id) GROUP BY ALL""",
    "changes", "analysis",
)
def info_kind_split(spark, sf):
    rows = view(spark, sf, "changes").join(view(spark, sf, "analysis"), "change_id", "left")
    return rows.groupBy(urls.content_kind(F.col("url"), F.col("category")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'HTTP 403' WHEN length(html) + CASE WHEN page_id % 7 = 1 THEN 21000 ELSE 60 END > 20000 THEN NULL
         WHEN page_id % 5 = 1 THEN 'just a moment' WHEN page_id % 5 = 2 THEN 'доступ ограничен' WHEN page_id % 5 = 3 THEN 'checking your browser' END AS reason FROM pages"""
)
def blocked_pages(spark, sf):
    """Challenge pages by one marker or two, in any case; a seventh of the pages is too long to be one."""
    k = F.col("page_id")
    mark = F.when(k % 5 == 1, "Just a Moment").when(k % 5 == 2, "ДОСТУП ограничен").when(k % 5 == 3, "unusual traffic, Checking your BROWSER").otherwise("")
    html = F.concat("html", F.rpad(mark, F.when(k % 7 == 1, 21000).otherwise(60), F.lit(" ")))
    return view(spark, sf, "pages").select("page_id", text.blocked_reason(F.when(k % 9 == 0, 403).otherwise(200), html).alias("reason"))


@query()
def html_text(spark, sf):
    return view(spark, sf, "pages").select("page_id", markup.extract_text("html").alias("text"))


@query()
def html_structure(spark, sf):
    return view(spark, sf, "pages").select("page_id", markup.extract_structure("html").alias("s")).select("page_id", "s.*")


@query()
def html_links(spark, sf):
    return sitemap.html_links(view(spark, sf, "pages").select("url", "html"))


@query()
def link_crawl(spark, sf):
    """Pages reached over the links of the pages from the first page of each host, ten thousand for each host at most."""
    links = sitemap.html_links(view(spark, sf, "pages").select("url", "html")).withColumn("site_id", urls.authority(F.col("url")))
    starts = view(spark, sf, "pages").groupBy(urls.authority(F.col("url")).alias("site_id")).agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("url"))
    return sitemap.link_crawl(links.select("site_id", "url", "pos", "target"), starts, 10_000).select("site_id", "url", "depth")


# --- stored tables and marts ----------------------------------------------------------------------------------------


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_snapshot(spark, sf):
    return store.latest(view(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"])


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 4) AS INT) AS batch FROM conversations")
def batches(spark, sf):
    rows = view(spark, sf, "conversations").withColumnRenamed("conv_id", "site_id")
    return store.batches(rows, 4, ["turn", "role", "text"]).select(F.col("site_id").alias("conv_id"), "turn", "batch")


_FEED = "FROM changes c JOIN sites s USING (site_id) LEFT JOIN analysis a USING (change_id) WHERE NOT s.is_own"


@query(
    f"""SELECT change_id, name, change_type, importance, category, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at,
        (SELECT count(*) {_FEED}) AS total_rows, 3 AS page, CAST((SELECT ceil(count(*) / 25.0) {_FEED}) AS INT) AS pages
        {_FEED} ORDER BY c.detected_at DESC, change_id DESC LIMIT 25 OFFSET 50""",
    "changes", "sites", "analysis",
)
def change_feed_page(spark, sf):
    """The third page of the feed, newest first."""
    rows = marts.feed(view(spark, sf, "changes"), view(spark, sf, "sites"), view(spark, sf, "analysis"))
    page = marts.ranked(rows, [F.desc("detected_at"), F.desc("change_id")], 25, 3)
    return page.select("change_id", "name", "change_type", "importance", "category", _stamp("detected_at"), "total_rows", "page", "pages")


@query(
    f"""SELECT change_id, name, importance {_FEED} AND importance = 'high' AND change_type = 'changed'
        AND (regexp_matches(url, '/blog/') OR coalesce(category LIKE 'Новост%', false)) AND detected_at >= TIMESTAMP '{SINCE}'""",
    "changes", "sites", "analysis",
)
def feed_by_audience(spark, sf):
    rows = marts.feed(view(spark, sf, "changes"), view(spark, sf, "sites"), view(spark, sf, "analysis"), kind="changed", high=True, since=SINCE, audience="info")
    return rows.select("change_id", "name", "importance")


@query("SELECT change_id, site_id, url FROM changes ANTI JOIN analysis USING (change_id) ORDER BY change_id LIMIT 50", "changes", "analysis")
def pending_analysis(spark, sf):
    return marts.backfill(view(spark, sf, "changes"), view(spark, sf, "analysis")).select("change_id", "site_id", "url")


_INFO = "regexp_matches(url, '/(blog|news)/')"
_KEPT = """(include_paths = '' OR (include_paths = '/blog' AND regexp_matches(url, '/blog/')) OR (include_paths = '!/news' AND NOT regexp_matches(url, '/news/')))
    AND NOT regexp_matches(url, '/spo/')"""
_AUDIT = f"""(SELECT m.*, name, f.page_id IS NOT NULL AS done FROM monitored m JOIN sites s USING (site_id)
              LEFT JOIN (SELECT DISTINCT page_id FROM findings) f USING (page_id) WHERE NOT is_own AND NOT is_removed AND {_INFO} AND {_KEPT})"""


@query(f"SELECT page_id, site_id, url FROM {_AUDIT} WHERE NOT done AND text_length >= 300", "monitored", "findings", "sites")
def audit_queue(spark, sf):
    return marts.audit_queue(view(spark, sf, "monitored"), view(spark, sf, "findings"), view(spark, sf, "sites")).select("page_id", "site_id", "url")


@query(
    f"""SELECT site_id, name, count(*) AS articles, count(*) FILTER (done) AS done, count(*) FILTER (NOT done AND coalesce(text_length, 0) >= 300) AS ready,
        count(*) FILTER (NOT done AND text_length IS NULL) AS waiting FROM {_AUDIT} GROUP BY ALL""",
    "monitored", "findings", "sites",
)
def audit_progress(spark, sf):
    return marts.audit_progress(view(spark, sf, "monitored"), view(spark, sf, "findings"), view(spark, sf, "sites"))


@query(
    f"""SELECT s.site_id, s.name, coalesce(articles, 0) AS articles, coalesce(ready, 0) AS ready, coalesce(without_structure, 0) AS without_structure,
        coalesce(done, 0) AS done, coalesce(CAST(ceil(cards / 4.0::DOUBLE) + ceil(ready * (1 - 0.2::DOUBLE) / 3) AS BIGINT), 0) AS calls
        FROM sites s LEFT JOIN (SELECT site_id, count(*) AS articles, count(*) FILTER (NOT done AND text_length IS NOT NULL) AS ready,
          count(*) FILTER (NOT done AND text_length IS NULL) AS without_structure, count(*) FILTER (done) AS done,
          count(*) FILTER (NOT done AND text_length IS NOT NULL AND NOT has_card) AS cards FROM {_AUDIT} GROUP BY site_id) USING (site_id)
        WHERE NOT is_own""",
    "monitored", "findings", "sites",
)
def audit_estimate(spark, sf):
    return marts.audit_estimate(view(spark, sf, "monitored"), view(spark, sf, "findings"), view(spark, sf, "sites"))


@query(
    f"""SELECT change_type, count(*) AS n FROM changes SEMI JOIN (SELECT site_id FROM sites WHERE NOT is_own) USING (site_id)
        WHERE detected_at >= TIMESTAMP '{SINCE}' GROUP BY change_type""",
    "changes", "sites",
)
def counts_by_type(spark, sf):
    return marts.counts_by_type(view(spark, sf, "changes"), view(spark, sf, "sites"), SINCE)


@query("SELECT kind, count(DISTINCT decision_id) AS topics, count(*) AS n FROM findings GROUP BY kind", "findings")
def decision_counts(spark, sf):
    return view(spark, sf, "findings").groupBy("kind").agg(F.countDistinct("decision_id").alias("topics"), F.count("*").alias("n"))


@query(
    f"""SELECT s.*, r.* FROM (SELECT count(*) AS sites, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'needs_session') AS needs_session
        FROM sites WHERE NOT is_own) s, (SELECT count(*) AS recent_changes FROM changes SEMI JOIN (SELECT site_id FROM sites WHERE NOT is_own) USING (site_id)
        WHERE detected_at >= TIMESTAMP '{SINCE}') r""",
    "changes", "sites",
)
def dashboard(spark, sf):
    return marts.dashboard(view(spark, sf, "sites"), view(spark, sf, "changes"), NOW)


@query(
    f"""SELECT s.site_id, name, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'changed') AS n_changed,
        count(*) FILTER (change_type = 'removed') AS n_removed, count(*) FILTER (importance = 'high') AS n_high
        FROM sites s LEFT JOIN (SELECT * FROM changes WHERE detected_at >= TIMESTAMP '{SINCE}') c ON c.site_id = s.site_id
        WHERE NOT is_own GROUP BY s.site_id, name""",
    "changes", "sites",
)
def digest_by_site(spark, sf):
    return marts.digest_by_site(view(spark, sf, "changes"), view(spark, sf, "sites"), SINCE)


@query(
    """SELECT site_id, change_id, importance, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY site_id
       ORDER BY CASE WHEN importance = 'high' THEN 0 ELSE 1 END, detected_at DESC, change_id DESC) AS nth
       FROM changes WHERE importance IS DISTINCT FROM 'low') WHERE nth <= 7""",
    "changes",
)
def top_findings(spark, sf):
    return marts.top_findings(view(spark, sf, "changes"), ["site_id"]).select("site_id", "change_id", "importance", "nth")


@query(
    """SELECT CASE WHEN is_paused THEN 'paused' WHEN cookies_only THEN 'cookies_only' WHEN is_crawling THEN 'running' ELSE 'started' END AS result, count(*) AS n
       FROM sites WHERE NOT is_own GROUP BY result""",
    "sites",
)
def start_all(spark, sf):
    return marts.start_all(view(spark, sf, "sites"))


@query(
    f"""SELECT site_id, name, problem FROM (SELECT *, CASE WHEN is_crawling THEN NULL
        WHEN is_own THEN CASE WHEN coalesce(last_crawl_finished_at < {_AT} - INTERVAL 2 DAY, true) THEN 'own_stale' END
        WHEN cookies_only AND NOT is_paused AND coalesce(last_crawl_finished_at < {_AT} - INTERVAL 7 DAY, true) THEN 'cookies_stale' END AS problem
        FROM sites) WHERE problem IS NOT NULL""",
    "sites",
)
def site_health(spark, sf):
    return marts.health(view(spark, sf, "sites"), NOW)


@query(
    f"""SELECT site_id, name, problem FROM (SELECT *, CASE WHEN status = 'needs_session' AND last_crawl_finished_at IS NOT NULL THEN 'needs_session'
        WHEN last_crawl_finished_at IS NULL THEN 'never_crawled' WHEN last_crawl_finished_at < TIMESTAMP '{SINCE}' THEN 'stale' END AS problem
        FROM sites WHERE NOT is_own AND NOT is_paused) WHERE problem IS NOT NULL""",
    "sites",
)
def digest_problems(spark, sf):
    return marts.digest_problems(view(spark, sf, "sites"), SINCE)


@query(
    """SELECT count(*) AS sites, count(*) FILTER (is_paused) AS paused, count(*) FILTER (status = 'needs_session') AS needs_session,
       count(*) FILTER (is_crawling) AS crawling, strftime(min(next_crawl_at) FILTER (NOT is_paused), '%Y-%m-%d %H:%M:%S') AS next_crawl_at,
       arg_max(name, (last_crawl_finished_at, site_id)) FILTER (last_crawl_finished_at IS NOT NULL) AS last_crawled FROM sites WHERE NOT is_own""",
    "sites",
)
def site_summary(spark, sf):
    return marts.summary(view(spark, sf, "sites")).select("sites", "paused", "needs_session", "crawling", _stamp("next_crawl_at"), "last_crawled")


def _items(c: str) -> str:
    """A text of parts with semicolons as a list, in SQL."""
    return f"list_filter(string_split({c}, ';'), lambda x: x <> '')"


def _parts(c: str):
    return F.filter(F.split(c, ";"), lambda x: x != "").alias(c)


def _once(c: str) -> str:
    """Values in order, each at its first place."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


_SHEET = f"""
WITH f AS (SELECT *, CAST(detected_at + INTERVAL 3 HOUR AS DATE) AS day, CAST(date_trunc('week', detected_at + INTERVAL 3 HOUR) AS DATE) AS week FROM sheet_rows),
g AS (SELECT week, decision_id, min(day) AS first_day, min(detected_at) AS born, first(f ORDER BY detected_at, url) AS h,
  list(CASE kind WHEN 'new' THEN 'создание' WHEN 'changed' THEN 'изменение' ELSE 'аудит (статья уже есть)' END ORDER BY detected_at, url) AS kinds,
  list(site ORDER BY detected_at, url) AS sites, list(url ORDER BY detected_at, url) AS pages, flatten(list({_items("added")} ORDER BY detected_at, url)) AS added
  FROM f GROUP BY week, decision_id),
c AS (SELECT *, {_items("h.subintents")} AS sub, {_items("h.add_subintents")} AS more, {_items("h.cannibal_urls")} AS rivals,
  CASE WHEN h.argument IS NULL THEN '' ELSE ' ' || h.argument END AS why FROM g)
SELECT strftime(week, '%Y-%m-%d') AS week, decision_id, strftime(first_day, '%d.%m.%Y') AS first_day, array_to_string({_once("kinds")}, chr(10)) AS kinds,
  array_to_string({_once("sites")}, chr(10)) AS sites, array_to_string({_once("pages")}, chr(10)) AS pages, coalesce(h.material_type, '') AS material_type,
  h.topic || '. Интент: ' || h.main_intent AS topic,
  CASE WHEN len(added) > 0 THEN 'Добавлен подинтент: ' || array_to_string({_once("added")}, '; ') WHEN len(sub) > 0 THEN 'Подинтенты: ' || array_to_string(sub[1:4], '; ')
    || CASE WHEN len(sub) > 4 THEN ' (и ещё ' || (len(sub) - 4) || ')' ELSE '' END ELSE '' END AS usp,
  CASE WHEN h.decision = 'new' OR h.our_url IS NULL THEN 'Нет' WHEN h.decision = 'update' THEN 'Частично' || chr(10) || h.our_url ELSE 'Есть' || chr(10) || h.our_url END
    || CASE WHEN len(rivals) > 1 THEN chr(10) || '⚠️ Риск каннибализации:' || chr(10) || array_to_string(rivals, chr(10)) ELSE '' END AS available,
  CASE WHEN h.decision = 'new' THEN 'Написать новую статью.' WHEN h.decision = 'update' THEN 'Обновить нашу статью: добавить '
    || CASE WHEN len(more) > 0 THEN array_to_string(more, '; ') ELSE 'раскрыть тему подробнее' END || '.' ELSE 'Ничего — у нас раскрыто.' END || why AS to_add,
  CAST(row_number() OVER (PARTITION BY week ORDER BY born DESC, h.url, decision_id) AS INT) AS nth FROM c"""


def sheet_rows(spark, sf):
    """Findings with their decisions, lists as arrays."""
    rows = view(spark, sf, "findings").join(view(spark, sf, "decisions"), "decision_id")
    return rows.select(
        "decision_id", "detected_at", "site", "url", "kind", "topic", "main_intent", "material_type", "decision", "our_url", "argument",
        _parts("subintents"), _parts("add_subintents"), _parts("cannibal_urls"), _parts("added").alias("added_subintents"),
    )


@query(f"SELECT * FROM ({_SHEET.replace('FROM sheet_rows', 'FROM (SELECT * FROM findings JOIN decisions USING (decision_id))')})", "findings", "decisions")
def week_sheet(spark, sf):
    return marts.week_sheet(sheet_rows(spark, sf))


@query(
    """SELECT 'Неделя ' || strftime(week, '%d.%m') || '–' || strftime(week + INTERVAL 6 DAY, '%d.%m.%Y') AS week, count(*) AS n,
       count(*) FILTER (night) AS at_night FROM (SELECT date_trunc('week', detected_at + INTERVAL 3 HOUR) AS week,
       hour(detected_at + INTERVAL 3 HOUR) BETWEEN 1 AND 6 AS night FROM changes) GROUP BY week""",
    "changes",
)
def week_bounds(spark, sf):
    at = F.col("detected_at")
    return view(spark, sf, "changes").groupBy(text.week_title(at).alias("week")).agg(F.count("*").alias("n"), F.count_if(text.in_night_window(at, 1, 7)).alias("at_night"))


@query(
    """SELECT site_id, CASE WHEN nth <= 2 THEN section ELSE 'other' END AS section, CAST(sum(n) AS BIGINT) AS n FROM (
       SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, section) AS nth FROM (
       SELECT site_id, '/' || regexp_extract(url, '^https://[^/]*/([^/]*)', 1) AS section, count(*) AS n FROM monitored GROUP BY ALL)) GROUP BY ALL""",
    "monitored",
)
def new_section_counts(spark, sf):
    return marts.section_counts(view(spark, sf, "monitored"), 2)


@query(
    f"""SELECT site_id, url, change_type, CAST(nth AS INT) AS nth FROM (
        SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN regexp_matches(url, '/kurs/') THEN 0 ELSE 1 END, length(url), url) AS nth
        FROM ({_DIFF}) WHERE change_type = 'new' AND NOT {_INFO}) WHERE nth <= 50""",
    "crawl_prev", "crawl_cur",
)
def baseline_pages(spark, sf):
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    return marts.baseline_pages(found)


# --- annotators -----------------------------------------------------------------------------------------------------

_J = "json_extract_string(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '$.%s')"


@query(
    f"""SELECT change_id, {_J % "category"} AS category, CASE lower(trim({_J % "importance"})) WHEN 'высокая' THEN 'high' WHEN 'важно' THEN 'high'
        WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' END AS importance FROM answers""",
    "answers",
)
def json_card_parse(spark, sf):
    return parsers.with_analysis(view(spark, sf, "answers")).select("change_id", "analysis.category", "analysis.importance")


@query(
    f"""SELECT change_id, CASE WHEN lower({_J % "verdict"}) IN ('exact', 'similar', 'none') THEN lower({_J % "verdict"})
        WHEN nullif({_J % "our_url"}, '') IS NOT NULL THEN 'similar' ELSE 'none' END AS verdict, nullif({_J % "our_url"}, '') AS our_url FROM answers""",
    "answers",
)
def match_validation(spark, sf):
    return parsers.with_comparison(view(spark, sf, "answers")).select("change_id", "comparison.verdict", "comparison.our_url")


# --- similarity -----------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS.split())
_TERMS = rf"""
terms_{{0}} AS (SELECT id, token, count(*) AS tf FROM (SELECT id, regexp_replace(w, '{text.STEM}', '\1') AS token FROM (
  SELECT id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[а-яёa-z0-9]+')) AS w FROM {{1}}) WHERE length(w) > 2 AND w NOT IN ({_STOP}))
  GROUP BY id, token)"""
_TITLED = "concat_ws(' ', text, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(repeat(' ' || source || ' ' || lang || 'topic', 3), '^ ', '') END)"
_SEARCH = f"""
WITH docs AS (SELECT doc_id AS id, {_TITLED} AS text FROM documents), items AS (SELECT doc_id AS id, {_TITLED} AS text FROM documents WHERE doc_id % 20 = 0),
{_TERMS.replace("{0}", "q").replace("{1}", "items")}, {_TERMS.replace("{0}", "d").replace("{1}", "docs")},
idf AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) + 1 AS idf FROM terms_d GROUP BY token),
d AS (SELECT id, token, tf * idf AS v FROM terms_d JOIN idf USING (token)), q AS (SELECT id, token, tf * idf AS w FROM terms_q JOIN idf USING (token)),
score AS (SELECT q.id AS query_id, d.id, sum(w * v) AS dot FROM q JOIN d USING (token) GROUP BY ALL),
ranked AS (SELECT query_id, id, round(dot / (sqrt(nq) * sqrt(nd)), 6) AS score FROM score
  JOIN (SELECT id, sum(v * v) AS nd FROM d GROUP BY id) USING (id) JOIN (SELECT id AS query_id, sum(w * w) AS nq FROM q GROUP BY id) USING (query_id))
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ranked) WHERE nth <= 3"""


@query(_SEARCH)
def tfidf_topk(spark, sf):
    """The three documents most similar to each document whose id is divisible by twenty, which finds itself too. A third
    of the documents have a title, whose words count three times."""
    title = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(" "), "lang", F.lit("topic"))).alias("title")
    docs = view(spark, sf, "documents").select(F.col("doc_id").alias("id"), title, "text")
    return similarity.search(docs.filter("id % 20 = 0"), docs, 3)


_CASES = "SELECT doc_id AS id, doc_id % 4 AS site_id, text FROM documents WHERE doc_id % 3 <> 0"
_KNOWN = f"""
WITH docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 = 0), items AS ({_CASES}),
{_TERMS.replace("{0}", "q").replace("{1}", "items")}, {_TERMS.replace("{0}", "d").replace("{1}", "docs")},
idf AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) + 1 AS idf FROM terms_d GROUP BY token),
d AS (SELECT id, token, tf * idf AS v FROM terms_d JOIN idf USING (token)), q AS (SELECT id, token, tf * idf AS w FROM terms_q JOIN idf USING (token)),
score AS (SELECT q.id AS query_id, d.id, sum(w * v) AS dot FROM q JOIN d USING (token) GROUP BY ALL),
ranked AS (SELECT query_id, id, round(dot / (sqrt(nq) * sqrt(nd)), 6) AS score FROM score
  JOIN (SELECT id, sum(v * v) AS nd FROM d GROUP BY id) USING (id) JOIN (SELECT id AS query_id, sum(w * w) AS nq FROM q GROUP BY id) USING (query_id)),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ranked) WHERE nth <= 5 AND score >= {topics.MERGE}),
known AS (SELECT query_id AS id, id AS decision_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS best
  FROM five WHERE query_id % 4 <> id % 4) WHERE best = 1)"""


def _cases(spark, sf):
    rows = view(spark, sf, "documents")
    return rows.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("site_id"), F.lit(None).cast("string").alias("title"), "text")


def _known(spark, sf):
    """Documents whose id is divisible by three stand for topics of former runs, of one site each; the others are cases."""
    rows = _cases(spark, sf)
    topics_, new = rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0")
    known = topics.known_topic(new, topics_.select("id", "title", "text"), topics_.select(F.col("id").alias("decision_id"), "site_id"))
    return new, written(known, "known")


@query(f"{_KNOWN} SELECT id, decision_id FROM known")
def known_topic(spark, sf):
    return _known(spark, sf)[1]


_TWINS = "twins AS (SELECT id, (SELECT min(o.id) FROM items o WHERE o.text = i.text AND o.id < i.id AND o.site_id <> i.site_id) AS same_as FROM items i)"


def _twins(new):
    """Cases with the text of an earlier one of another site, and the earliest of these."""
    return written(topics.same_text(new), "twins")


_ASK = f"""{_KNOWN}, {_TWINS}, open AS (SELECT id FROM items WHERE id NOT IN (SELECT id FROM known) AND id NOT IN (SELECT id FROM twins WHERE same_as IS NOT NULL)),
asked AS (SELECT id, row_number() OVER (ORDER BY id) <= {topics.COMPARE_LIMIT} AS asked FROM open)"""


@query(f"{_ASK} SELECT id, asked FROM asked")
def cases_to_ask(spark, sf):
    new, known = _known(spark, sf)
    return topics.to_ask(new, known, _twins(new)).select("id", "asked")


@query(
    f"""{_ASK}, own AS (SELECT i.id, CASE WHEN asked AND i.id % 5 <> 0 THEN CASE WHEN i.id % 7 = 0 THEN 1000000 + i.id ELSE i.id END
          WHEN same_as IS NOT NULL AND k.decision_id IS NULL THEN NULL ELSE k.decision_id END AS own, coalesce(asked AND i.id % 5 <> 0, false) AS decided, same_as
        FROM items i LEFT JOIN known k ON k.id = i.id LEFT JOIN asked a ON a.id = i.id LEFT JOIN twins t ON t.id = i.id)
        SELECT o.id, coalesce(o.own, h.own) AS decision_id,
               CASE WHEN coalesce(o.own, h.own) IS NULL THEN 'not_compared' WHEN o.decided THEN 'decided' ELSE 'merged' END AS outcome
        FROM own o LEFT JOIN own h ON h.id = o.same_as"""
)
def recorded_decisions(spark, sf):
    """All cases but those whose id is divisible by five have an answer; those divisible by seven have a topic already."""
    new, known = _known(spark, sf)
    same = _twins(new)
    had = F.when(F.col("id") % 7 == 0, 1000000 + F.col("id")).alias("decision_id")
    answers = new.select("id", F.when(F.col("id") % 5 != 0, "update").alias("verdict"))
    return topics.recorded(new.select("id", had), known, same, topics.to_ask(new, known, same), answers)


_PAIRS = f"""
WITH docs AS (SELECT doc_id AS id, text FROM documents), {_TERMS.replace("{0}", "d").replace("{1}", "docs")},
idf AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) + 1 AS idf FROM terms_d GROUP BY token),
named AS (SELECT id, min(id) OVER (PARTITION BY words) AS class FROM (SELECT id, string_agg(token || ' ' || tf, ' ' ORDER BY token) AS words FROM terms_d GROUP BY id)),
d AS (SELECT id, token, tf * idf AS v FROM terms_d JOIN idf USING (token) JOIN named USING (id) WHERE id = class),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM d GROUP BY id),
links AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.token = b.token AND b.id < a.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
  GROUP BY a.id, b.id HAVING sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)) >= {topics.MERGE})
SELECT named.id, class, count(links.a) AS n_links FROM named LEFT JOIN links ON class IN (links.a, links.b) GROUP BY named.id, class"""


@query(_PAIRS)
def similar_documents(spark, sf):
    """The class of equal texts of each document, and to how many other classes it is similar."""
    member, pairs = similarity.similarity_join(_cases(spark, sf), topics.MERGE)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))  # pairs are made once
    return member.join(ends, "class", "left").select("id", "class", F.coalesce("n", F.lit(0)).alias("n_links"))


@query()
def topic_merge(spark, sf):
    """Which documents repeat the topic of an earlier one of another site."""
    return topics.same_run_topics(_cases(spark, sf))


@query(
    r"""WITH lines AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[0-9][0-9  ]*', '#', 'g')) AS m
        FROM documents), pieces AS (SELECT doc_id, array_to_string(m[s + 1:s + 3], chr(10)) AS piece FROM (
          SELECT doc_id, m, unnest(range(0, greatest(len(m) - 3, 0) + 1)) AS s FROM lines))
        SELECT md5(piece) AS piece, count(DISTINCT doc_id) AS pages FROM pieces
        WHERE length(regexp_replace(piece, '(?i)[^a-zа-яё]', '', 'g')) >= 4 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3"""
)
def shingle_pages(spark, sf):
    """Pieces of three lines, digits masked, that stand on at least three pages."""
    runs = view(spark, sf, "documents").select(F.lit(0).alias("site_id"), F.col("doc_id").cast("string").alias("url"), F.lit(0).alias("run"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = sitewide.shingles(runs).filter(text.letters(F.col("piece")) >= sitewide.MIN_LETTERS)
    return rows.select(F.md5("piece").alias("piece"), "url").distinct().groupBy("piece").agg(F.count("*").alias("pages")).filter(F.col("pages") >= sitewide.MIN_PAGES)


from sitetide.plans import more_queries, run_queries, text_queries  # noqa: E402,F401  register further queries
