"""Queries of what runs write and how they are cut: logs and keyed tables, portions, bounded texts, sources, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitetide.operators import assembly, ordered, portions, reports, snapshots, topics
from sitetide.plans import more_queries
from sitetide.plans.catalog import _DIFF, NOW, query
from sitetide.plans.more_queries import _LISTS
from sitetide.plans.stand_ins import view
from sitetide.session import own_folder
from sitetide.sources import journal, sitemap


def _folder(spark, name):
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- logs and keyed tables ------------------------------------------------------------------------------------------

_LOG = "page_id string, change_type string, old_hash string, new_hash string"


@query(
    f"""SELECT 'r1' AS run, d.url AS page_id, change_type, sha256(p.text) AS old_hash, sha256(c.text) AS new_hash FROM ({_DIFF}) d
        LEFT JOIN crawl_prev p ON p.site_id = d.site_id AND p.url = d.url LEFT JOIN crawl_cur c ON c.site_id = d.site_id AND c.url = d.url""",
    "crawl_prev", "crawl_cur",
)
def recorded_changes(spark, sf):
    """A run that was written twice, and one that broke off before its commit: the log has the first once."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    rows = found.select(F.col("url").alias("page_id"), "change_type", "old_text", "new_text", F.lit(None).cast("string").alias("diff_text"))
    shots, changes = journal.change_rows(rows, "r1")
    hashes = shots.select("snapshot_id", "content_hash")
    old = hashes.withColumnsRenamed({"snapshot_id": "old_snapshot_id", "content_hash": "old_hash"})
    new = hashes.withColumnsRenamed({"snapshot_id": "new_snapshot_id", "content_hash": "new_hash"})
    log = changes.join(old, "old_snapshot_id", "left").join(new, "new_snapshot_id", "left").select("page_id", "change_type", "old_hash", "new_hash")
    path = _folder(spark, "changes")
    journal.append_run(log, path, "r1")
    journal.append_run(log, path, "r1")
    log.write.parquet(f"{path}/rows/run=r2")
    return journal.read_runs(spark, path, _LOG).select("run", "page_id", "change_type", "old_hash", "new_hash")


@query(
    """SELECT change_id AS message_id, site_id, change_id, 'chat' AS channel, CASE WHEN change_id % 9 = 4 THEN 'failed' ELSE 'sent' END AS status,
       change_type || ': ' || url AS message, CASE WHEN change_id % 9 = 4 THEN 'no answer' END AS error FROM changes""",
    "changes",
)
def notification_log(spark, sf):
    rows = view(spark, sf, "changes")
    messages = rows.select(F.col("change_id").alias("message_id"), "site_id", "change_id", F.lit("chat").alias("channel"), F.concat_ws(": ", "change_type", "url").alias("message"))
    failures = rows.filter("change_id % 9 = 4").select(F.col("change_id").alias("message_id"), F.explode(F.array(F.lit("no answer"), F.lit("bad gateway"))).alias("error"))
    path = _folder(spark, "notifications")
    journal.append_run(journal.notification_rows(messages, failures), path, "r1")
    kind = "message_id long, site_id long, change_id long, channel string, status string, message string, error string"
    return journal.read_runs(spark, path, kind).drop("run")


_CARD = "page_id long, topic string, main_intent string, step int"


@query(
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'none' ELSE topic END AS topic, main_intent, step FROM (
       SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY step DESC) AS nth FROM (
       SELECT page_id, topic, main_intent, 1 AS step FROM cards UNION ALL
       SELECT page_id, coalesce(h1, 'no heading') AS topic, main_text AS main_intent, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 2 END AS step FROM structures)) WHERE nth = 1""",
    "cards", "structures",
)
def upserted_cards(spark, sf):
    """Cards, then newer ones and a few older ones of the pages' structures, then a change by a condition."""
    path = _folder(spark, "cards")
    first = view(spark, sf, "cards").select("page_id", "topic", "main_intent", F.lit(1).alias("step"))
    again = view(spark, sf, "structures").select("page_id", F.coalesce("h1", F.lit("no heading")).alias("topic"), F.col("main_text").alias("main_intent"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(2).alias("step"))
    for run, rows in (("r1", first), ("r2", again), ("r2", first)):
        journal.upsert_run(rows, path, run, ["page_id"], ["step"], 16)
    journal.update_where(spark, path, "r3", _CARD, F.col("page_id") % 6 == 0, {"topic": F.lit("none")})
    return journal.read_state(spark, path, _CARD)


# --- portions -------------------------------------------------------------------------------------------------------

_QUEUE = "SELECT site_id, page_id, NOT has_card AS needs_card, page_id % 4 < 3 AS asks FROM monitored WHERE NOT is_removed"
_PORTIONS = f"""
WITH q AS ({_QUEUE}), p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY site_id ORDER BY page_id) - 1) / {portions.PORTION}) AS INT) AS portion FROM q),
c AS (SELECT site_id, portion, ceil(count(*) FILTER (needs_card) / 4.0) + ceil(count(*) FILTER (asks) / 3.0) AS calls FROM p GROUP BY ALL),
b AS (SELECT site_id, portion, coalesce(sum(calls) OVER (ORDER BY site_id, portion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS calls_before FROM c),
r AS (SELECT p.site_id, page_id, portion, CAST(calls_before AS BIGINT) AS calls_before, calls_before < {portions.MAX_CALLS} AS taken FROM p JOIN b USING (site_id, portion))"""


def _queue(spark, sf):
    rows = view(spark, sf, "monitored").filter("not is_removed")
    return rows.select("site_id", "page_id", (~F.col("has_card")).alias("needs_card"), (F.col("page_id") % 4 < 3).alias("asks"))


@query(f"SELECT * FROM ({_PORTIONS} SELECT * FROM r)", "monitored")
def audit_portions(spark, sf):
    made = portions.portions(_queue(spark, sf), ["site_id", "page_id"])
    return made.select("site_id", "page_id", "portion", "calls_before", "taken")


@query(f"SELECT q.site_id, q.page_id, r.taken AS first_run FROM ({_QUEUE}) q JOIN ({_PORTIONS} SELECT * FROM r) r ON r.page_id = q.page_id", "monitored")
def audit_in_two_runs(spark, sf):
    """What the cap leaves over is taken by a second run from the stored point on: together all pages, once each."""
    queue, order = _queue(spark, sf), ["site_id", "page_id"]
    first = portions.portions(queue, order)
    path = _folder(spark, "resume")
    point = portions.resume_point(first, order)
    kind = "name string, site_id long, page_id long, step int"
    journal.upsert_run(spark.createDataFrame([("audit", *point, 1)] if point else [], kind), path, "r1", ["name"], ["step"])
    stored = journal.read_state(spark, path, kind).filter("name = 'audit'").select(*order).first()
    second = portions.portions(queue, order, max_calls=None, after=tuple(stored) if stored else None)
    return first.filter("taken").select(*order, F.lit(True).alias("first_run")).unionByName(second.filter("taken").select(*order, F.lit(False).alias("first_run")))


@query(
    f"""SELECT page_id, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / {portions.CARD_BATCH}) AS INT) AS batch FROM (
        SELECT s.page_id FROM structures s LEFT JOIN cards c USING (page_id) WHERE c.page_id IS NULL OR s.page_id % 4 = 2 ORDER BY page_id LIMIT {portions.CARD_LIMIT})""",
    "structures", "cards",
)
def card_refresh_batches(spark, sf):
    """The first thirty pages whose card is missing or stale, four to a call."""
    pages = view(spark, sf, "structures").select("page_id", F.lit("x").alias("content_hash"))
    cards = view(spark, sf, "cards").select("page_id", F.when(F.col("page_id") % 4 == 2, "old").otherwise("x").alias("content_hash"))
    return portions.card_batches(topics.cards_to_refresh(pages, cards), ["page_id"]).select("page_id", "batch")


# --- sources --------------------------------------------------------------------------------------------------------

_SOURCED = """
SELECT * FROM (WITH m AS (SELECT site_id, page_id, url, page_id % 3 AS part FROM monitored),
e AS (SELECT site_id % 5 AS kind, * FROM (SELECT CAST(page_id % 7 AS BIGINT) AS site_id, page_id FROM m))
SELECT site_id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS rank,
       'https://s' || CAST(site_id AS STRING) || '.example/p/' || CAST(page_id AS STRING) AS url,
       CASE WHEN kind IN (0, 1, 4) THEN '2024-01-05 00:00:00' END AS lastmod
FROM e WHERE kind <> 1 OR page_id % 3 < 2)"""


@query(_SOURCED, "monitored")
def discovered_pages(spark, sf):
    """Five kinds of sites, seven in all: a main map; an empty main map and two of three files in robots.txt; a home page that
    links a page of links, with broken maps; a page of links of its own setting; an index of its own setting, although
    there is a main map. Each page is on the site of its number's rest by seven."""
    rows = view(spark, sf, "monitored").select((F.col("page_id") % 7).cast("long").alias("site_id"), "page_id", (F.col("page_id") % 3).alias("part"))
    kind, host = F.col("site_id") % 5, F.concat(F.lit("https://s"), F.col("site_id").cast("string"), F.lit(".example"))
    page = F.concat(host, F.lit("/p/"), F.col("page_id").cast("string"))
    rows = rows.withColumns({"kind": kind, "host": host, "page": page})
    entry = F.concat(F.lit("<url><loc>"), F.col("page"), F.lit("/</loc><lastmod>2024-01-05</lastmod></url>"))
    xml = lambda body: F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), body, F.lit("</urlset>"))
    anchors = F.array_join(F.collect_list(F.concat(F.lit("<a href='"), F.regexp_extract("page", "(/p/.*)$", 1), F.lit("?utm_source=m#x'>p</a>"))), "")
    by = rows.groupBy("site_id", "kind", "host")
    whole = by.agg(xml(F.array_join(F.collect_list(entry), "")).alias("all"), anchors.alias("links"))
    parts = rows.groupBy("site_id", "kind", "host", "part").agg(xml(F.array_join(F.collect_list(entry), "")).alias("body"))
    files = parts.filter("kind in (1, 4)").select("site_id", F.concat("host", F.lit("/part"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), "body")
    part = lambda k: F.concat(F.lit("<sitemap><loc>"), F.col("host"), F.lit(f"/part{k}.xml</loc></sitemap>"))
    index = F.concat(F.lit("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), *[part(k) for k in range(3)], F.lit("</sitemapindex>"))
    robots = F.concat(F.lit("User-agent: *\nSitemap: "), F.col("host"), F.lit("/part0.xml\nsitemap: "), F.col("host"), F.lit("/part1.xml\nSitemap: "), F.col("host"), F.lit("/lost.xml\n"))
    made = (
        ("/sitemap.xml", F.when(F.col("kind") == 0, F.col("all")).when(F.col("kind") == 1, xml(F.lit(""))).when(F.col("kind") == 2, F.lit("<html>no map</html>")).when(F.col("kind") == 4, xml(F.lit("<url><loc>https://x/</loc></url>")))),
        ("/robots.txt", F.when(F.col("kind").isin(0, 1), robots).when(F.col("kind") == 2, F.lit("User-agent: *"))),
        ("/", F.lit("<a href='/about'>About</a><a href='/all'>Карта  сайта</a>")),
        ("/all", F.when(F.col("kind").isin(2, 3), F.col("links"))),
        ("/index.xml", F.when(F.col("kind") == 4, index)),
    )
    each = [whole.select("site_id", F.concat("host", F.lit(p)).alias("url"), body.alias("body")) for p, body in made]
    responses = files
    for rows_ in each:
        responses = responses.unionByName(rows_)
    responses = responses.withColumn("status", F.when(F.col("body").isNull(), 404).otherwise(200))
    own = F.when(F.col("kind") == 3, F.concat("host", F.lit("/all"))).when(F.col("kind") == 4, F.concat("host", F.lit("/index.xml")))
    sites = whole.select("site_id", F.concat("host", F.lit("/")).alias("base_url"), own.alias("sitemap_url"))
    return sitemap.discover(sites, responses).select("site_id", "rank", "url", F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss").alias("lastmod"))


# --- bounded texts --------------------------------------------------------------------------------------------------

_BUDGET = 600


@query(
    f"""SELECT site_id, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (ends <= {_BUDGET}), '')
          || CASE WHEN count(*) > count(*) FILTER (ends <= {_BUDGET}) THEN chr(10) || '…и ещё ' || (count(*) - count(*) FILTER (ends <= {_BUDGET})) ELSE '' END AS text,
          count(*) FILTER (ends <= {_BUDGET}) AS shown, count(*) - count(*) FILTER (ends <= {_BUDGET}) AS left
        FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY site_id ORDER BY nth) - 1 AS ends FROM (
          SELECT site_id, change_type || ' ' || url AS line, row_number() OVER (PARTITION BY site_id ORDER BY detected_at DESC, change_id) AS nth FROM changes)) GROUP BY site_id""",
    "changes",
)
def fitted_changes(spark, sf):
    """The latest changes of each site that fit into six hundred characters, and how many are left out."""
    rows = view(spark, sf, "changes").select("site_id", (-F.unix_micros("detected_at")).alias("newest"), "change_id", F.concat_ws(" ", "change_type", "url").alias("line"))
    return assembly.fitted(rows, ["site_id"], ["newest", "change_id"], "line", _BUDGET)


@query(
    f"""SELECT d.site_id, d.url, CASE WHEN change_type <> 'changed' THEN change_type WHEN m.page_id % 3 = 0 THEN 'own' ELSE 'diff' END AS about,
        substring(coalesce(CASE WHEN change_type = 'new' THEN c.text WHEN change_type = 'removed' THEN p.text WHEN m.page_id % 3 = 0 THEN '+own ' || d.url ELSE c.text || p.text END, ''), 1, {assembly.CONTENT_LIMIT}) AS content
        FROM ({_DIFF}) d JOIN monitored m ON m.site_id = d.site_id AND m.url = d.url LEFT JOIN crawl_prev p ON p.site_id = d.site_id AND p.url = d.url
        LEFT JOIN crawl_cur c ON c.site_id = d.site_id AND c.url = d.url""",
    "crawl_prev", "crawl_cur", "monitored",
)
def asked_contents(spark, sf):
    """What is shown of each change: a third of the changed pages have a part of their own that takes the place of the whole."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    found = found.withColumn("diff_text", F.when(F.col("change_type") == "changed", F.concat("new_text", "old_text")))
    own = view(spark, sf, "monitored").filter("page_id % 3 = 0").select("site_id", "url", F.concat(F.lit("+own "), "url").alias("own_text"))
    return assembly.asked_content(assembly.with_own_part(found, own))


@query(
    f"""SELECT case_id, count(*) AS n, string_agg('--- ' || nth || ' ---' || chr(10) || url || chr(10) || coalesce(nullif(title, ''), 'не указан') || chr(10) || substring(coalesce(text, ''), 1, {assembly.COMPARE_LIMIT}),
          chr(10) || chr(10) ORDER BY nth) AS text
        FROM (SELECT doc_id // 3 AS case_id, CAST(doc_id % 3 + 1 AS INT) AS nth, m.url, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE 'Title ' || lang END AS title, text
              FROM documents JOIN monitored m ON m.page_id = doc_id) GROUP BY case_id""",
    "monitored",
)
def candidate_blocks(spark, sf):
    docs = view(spark, sf, "documents").join(view(spark, sf, "monitored").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    title = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 > 1, F.concat(F.lit("Title "), "lang"))
    return assembly.candidate_blocks(docs.select(F.floor(F.col("doc_id") / 3).alias("case_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("nth"), "url", title.alias("title"), "text"))


def _context_sql(part: str, own: str, most: int, head: str) -> str:
    return f"""SELECT '{part}' AS part, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (kept), '')
          || CASE WHEN count(*) > count(*) FILTER (kept) THEN chr(10) || '…и ещё ' || (count(*) - count(*) FILTER (kept)) ELSE '' END AS text,
          count(*) FILTER (kept) AS shown, count(*) - count(*) FILTER (kept) AS left FROM (
        SELECT *, nth <= {most} AND sum(length(line) + 1) OVER (ORDER BY nth) - 1 <= {assembly.CONTENT_LIMIT} AS kept FROM (
          SELECT concat_ws(' | ', {head}change_type, c.url, 'Found ' || change_type) AS line, row_number() OVER (ORDER BY detected_at DESC, change_id) AS nth
          FROM changes c JOIN sites s USING (site_id) WHERE detected_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND {own})) HAVING count(*) > 0"""


@query(f"{_context_sql('rivals', 'NOT is_own', 40, 'name, ')} UNION ALL {_context_sql('own', 'is_own', 15, '')}", "changes", "sites")
def recent_context(spark, sf):
    """The latest forty findings of rivals and fifteen of the own site, within eight thousand characters each."""
    rows = view(spark, sf, "changes").join(view(spark, sf, "sites").select("site_id", "is_own", F.col("name").alias("site")), "site_id")
    return assembly.context_lines(rows.withColumn("summary", F.concat(F.lit("Found   "), "change_type")), NOW)


_TITLES = {"important": "🔥 Важное", "missing": "❌ У нас такого нет"}
_INTRO = f"""
SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY a, b) AS INT) AS place, style, text FROM (
  SELECT site_id, 0 AS a, 0 AS b, 'h1' AS style, 'Коротко: ' || name AS text FROM sites
  UNION ALL SELECT site_id, 1, 0, 'normal', 'Главное: overview' FROM sites WHERE site_id % 2 = 0
  UNION ALL SELECT site_id, 2, 0, 'normal', 'Counts' FROM sites UNION ALL SELECT site_id, 900, 0, 'h1', 'Подробности' FROM sites
  UNION ALL SELECT site_id, 901, 1, 'normal', 'Note' FROM sites WHERE site_id % 3 = 0
  UNION ALL SELECT site_id, CASE list WHEN 'important' THEN 10 ELSE 13 END, 0, 'h2', CASE list WHEN 'important' THEN '🔥 Важное' ELSE '❌ У нас такого нет' END FROM (SELECT DISTINCT site_id, list FROM ({_LISTS}))
  UNION ALL SELECT site_id, CASE list WHEN 'important' THEN 11 ELSE 14 END, nth, 'normal', CASE WHEN line <> '' THEN '• ' || line || ' — ' || url ELSE '• ' || url END FROM ({_LISTS})
  UNION ALL SELECT site_id, CASE list WHEN 'important' THEN 12 ELSE 15 END, 0, 'normal', '…и ещё ' || (total - n) || ' — в таблице ниже.' FROM (SELECT site_id, list, max(total) AS total, count(*) AS n FROM ({_LISTS}) GROUP BY ALL) WHERE total > n)"""


@query(_INTRO, "run_findings", "compared", "changes", "sites")
def report_intro(spark, sf):
    sites = view(spark, sf, "sites")
    heads = sites.select("site_id", F.concat(F.lit("Коротко: "), "name").alias("heading"), F.when(F.col("site_id") % 2 == 0, "overview").alias("overview"), F.lit("Counts").alias("counts"))
    notes = sites.filter("site_id % 3 = 0").select("site_id", F.lit(1).alias("nth"), F.lit("Note").alias("note"))
    return assembly.intro_paragraphs(heads, more_queries.report_lists(spark, sf), notes, _TITLES)


# --- answers --------------------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(event_id AS BIGINT) AS answer_id, CASE WHEN k IN (0, 1, 3, 4, 6) THEN 'Done ' || CAST(user_id AS STRING) END AS reply,
       CASE k WHEN 0 THEN 'crawl' WHEN 1 THEN 'add_competitor' WHEN 7 THEN 'crawl_all' END AS action,
       CASE k WHEN 0 THEN '{"competitor_id":' || CAST(user_id AS STRING) || '}' WHEN 1 THEN '{"name":"Foo","url":"foo.example"}' WHEN 7 THEN '{}' END AS args,
       CASE WHEN k IN (0, 1, 7) THEN 'accepted' WHEN k = 2 THEN 'empty' WHEN k = 3 THEN 'none' WHEN k = 4 THEN 'unknown' WHEN k = 5 THEN 'unreadable' ELSE 'incomplete' END AS verdict
       FROM (SELECT *, event_id % 8 AS k FROM events)"""
)
def checked_replies(spark, sf):
    """Eight kinds of answers: good ones, one that names an unknown action, one whose argument is null, broken ones."""
    said, k = F.concat(F.lit('"reply": "Done '), F.col("user_id").cast("string"), F.lit(' "')), F.col("event_id") % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("Sure: {"), said, F.lit(', "action": {"type": "crawl", "competitor_id": '), F.col("user_id").cast("string"), F.lit("}} bye")))
        .when(k == 1, F.concat(F.lit("{"), said, F.lit(', "action": {"type": "add_competitor", "name": "Foo", "url": "foo.example"}}')))
        .when(k == 2, F.lit('{"reply": "  ", "action": {"type": "crawl"}}'))
        .when(k == 3, F.concat(F.lit("{"), said, F.lit(', "action": null}')))
        .when(k == 4, F.concat(F.lit("{"), said, F.lit(', "action": {"type": "erase_all", "competitor_id": 1}}')))
        .when(k == 5, F.lit("no object {here"))
        .when(k == 6, F.concat(F.lit("{"), said, F.lit(', "action": {"type": "add_competitor", "name": "Foo", "url": null}}')))
        .otherwise(F.lit('{"action": {"type": "crawl_all"}}'))
    )
    answers = view(spark, sf, "events").select(F.col("event_id").cast("long").alias("answer_id"), raw.alias("raw"))
    return assembly.checked_replies(answers, assembly.rules(spark))


@query(
    """SELECT name, 'v' AS value, domain, CASE WHEN expires IS NULL THEN '/' ELSE '/p' END AS path, CASE WHEN expires IS NULL OR session THEN -1.0 ELSE CAST(expires AS DOUBLE) END AS expires,
       expires IS NOT NULL AS http_only, false AS secure, CASE WHEN name = 'sid0' THEN 'None' WHEN name = 'sid1' THEN 'Strict' ELSE 'Lax' END AS same_site FROM cookies""",
    "cookies",
)
def converted_cookies(spark, sf):
    same = F.when(F.col("name") == "sid0", "No_Restriction").when(F.col("name") == "sid1", "strict").when(F.col("name") == "qrator_jsid0", "odd")
    rows = view(spark, sf, "cookies").withColumns({"value": F.lit("v"), "path": F.when(F.col("expires").isNotNull(), "/p"), "expirationDate": F.col("expires"), "sameSite": same})
    return reports.converted_cookies(rows.withColumns({"httpOnly": F.when(F.col("expires").isNotNull(), True), "secure": F.lit(None).cast("boolean")}))


@query(
    """SELECT run_id, CAST(sum(cards) AS BIGINT) AS cards, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(merged) AS BIGINT) AS merged, bool_or(limit_hit) AS limit_hit,
       CAST(sum(CASE WHEN kind = 'new' THEN n ELSE 0 END) AS BIGINT) AS n_new, CAST(sum(CASE WHEN kind = 'covered' THEN n ELSE 0 END) AS BIGINT) AS n_covered FROM (SELECT user_id % 9 AS run_id, event_id % 5 AS cards, event_id % 3 AS calls, event_id % 2 AS merged, event_id % 97 = 0 AS limit_hit,
         CASE WHEN event_id % 4 = 0 THEN 'covered' WHEN event_id % 4 = 1 THEN 'new' END AS kind, event_id % 7 AS n FROM events) GROUP BY run_id"""
)
def merged_results(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, F.create_map(F.lit("covered"), (e % 7).cast("long"))).when(e % 4 == 1, F.create_map(F.lit("new"), (e % 7).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>"))
    rows = view(spark, sf, "events").select((F.col("user_id") % 9).alias("run_id"), (e % 5).alias("cards"), F.lit(0).alias("cards_skipped"), (e % 3).alias("calls"), (e % 2).alias("merged"), F.lit(0).alias("not_compared"), (e % 97 == 0).alias("limit_hit"), kind.alias("decisions"))
    made = reports.merged_results(rows)
    of = lambda k: F.coalesce(F.try_element_at("decisions", F.lit(k)), F.lit(0)).alias(f"n_{k}")
    return made.select("run_id", "cards", "calls", "merged", "limit_hit", of("new"), of("covered"))


@query("SELECT CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(done) AS BIGINT) AS done, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(waiting) AS BIGINT) AS waiting, sum(ready) = 0 AS finished FROM (SELECT site_id, count(*) AS articles, count(*) FILTER (has_card) AS done, count(*) FILTER (NOT has_card) AS ready, count(*) FILTER (is_removed) AS waiting FROM monitored GROUP BY site_id)", "monitored")
def audit_totals(spark, sf):
    per = view(spark, sf, "monitored").groupBy("site_id").agg(F.count("*").alias("articles"), F.count_if("has_card").alias("done"), F.count_if(~F.col("has_card")).alias("ready"), F.count_if("is_removed").alias("waiting"))
    return reports.audit_totals(per)


@query("SELECT url, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at, CAST(row_number() OVER (ORDER BY last_seen_at DESC, url) AS INT) AS nth FROM page_states WHERE site_id = 2", "page_states")
def pages_of_site(spark, sf):
    """The pages of site 2 in their order, which the numbers show."""
    rows = ordered.numbered(reports.site_pages(view(spark, sf, "page_states"), 2).withColumn("newest", -F.unix_micros("last_seen_at")), ["newest", "url"], "n")
    return rows.select("url", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"), (F.col("n") + 1).cast("int").alias("nth"))
