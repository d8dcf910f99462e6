"""Queries of the line, page and address rules on texts made from the tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.functions import markup, noise, text, urls
from sitetide.operators import marts, reports, sitewide, snapshots
from sitetide.plans.catalog import _DIFF, NOW, SINCE, query
from sitetide.plans.stand_ins import view
from sitetide.sources import store


def _lines(*parts):
    """A text of the lines that are not null."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n():
    return F.col("doc_id")


def _id():
    return _n().cast("string")


# --- lines ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, concat_ws(chr(10), 'Курс ' || doc_id, '#', 'Смотрели', 'Цена от', doc_id || '00', '₽ в месяц', 'Рейтинг', CASE WHEN doc_id % 2 = 0 THEN '# отзывы' ELSE '#' END,
         CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'отзывы' END, 'отзывов', 'Уже #… скидка', '#', '#', '…', CASE WHEN doc_id % 3 = 0 THEN 'cookie' || repeat(' long', 100) END, 'Конец') AS normalized FROM documents"""
)
def levelled_lines(spark, sf):
    """Bare numbers with and without a price beside them, counts of reviews in one line and in two, tickers, timers, consent."""
    even = F.col("doc_id") % 2 == 0
    made = _lines(
        F.concat(F.lit("Курс "), _id()), _id(), "Смотрели", "Цена от", F.concat(_id(), F.lit("00")), "₽ в месяц", "Рейтинг", F.when(even, F.concat(_id(), F.lit(" отзывов"))).otherwise(_id()), F.when(~even, "отзывов"), "отзывов",
        "Уже 5 дней скидка", "10:20", "5 мин", "часов", F.concat(F.lit("Мы используем Cookie "), _id()), "Ок", F.when(_n() % 3 == 0, F.concat(F.lit("cookie"), F.repeat(F.lit(" long"), 100))), "Конец",
    )
    return view(spark, sf, "documents").select("doc_id", noise.normalize_for_compare(made).alias("normalized"))


@query(
    """SELECT doc_id, concat_ws(chr(10), 'Статья ' || doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Популярные статьи' || chr(10) || 'Текст ' || doc_id END,
         repeat('далеко' || chr(10), 9) || CASE WHEN doc_id % 3 = 1 THEN '14 марта 2024' ELSE 'близко' END, 'Середина',
         CASE WHEN doc_id % 2 = 0 THEN NULL ELSE concat_ws(chr(10), 'Отзывы', 'А', 'Имя ' || doc_id, '01.02.2024', 'Хорошо') END, 'После') AS kept FROM documents"""
)
def rotating_blocks(spark, sf):
    """Lists of related articles up to their last date within eight lines; reviews up to where the last card closes; a
    heading without dates and reviews with one date stay."""
    related = F.when(_n() % 3 == 2, F.concat(F.lit("Популярные статьи\nТекст "), _id())).otherwise(F.concat(F.lit("Читайте также\nПервая "), _id(), F.lit("\n12 января 2024\nВторая\n\n13 января 2024")))
    far = F.concat(F.repeat(F.lit("далеко\n"), 9), F.when(_n() % 3 == 1, "14 марта 2024").otherwise("близко"))
    two = F.concat(F.lit("Отзывы\nА\nИмя "), _id(), F.lit("\n01.02.2024\nХорошо\nна курс\nматематика\nБ\nДругое\n02.02.2024\nОчень\nдлинный отзыв\nна курс\nматематика"))
    one = F.concat(F.lit("Отзывы\nА\nИмя "), _id(), F.lit("\n01.02.2024\nХорошо"))
    made = _lines(F.concat(F.lit("Статья "), _id()), related, far, "Середина", F.when(_n() % 2 == 0, two).otherwise(one), "После")
    return view(spark, sf, "documents").select("doc_id", noise.strip_rotating_blocks(made).alias("kept"))


@query(
    """SELECT site_id, count(*) AS n_pages, min(url) AS first_url, true AS named FROM crawl_cur WHERE CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 10 = 2
       GROUP BY site_id HAVING count(*) >= 3""",
    "crawl_cur",
)
def sitewide_blocks(spark, sf):
    """The block that a tenth of the pages got is one change of each site, whatever else changed beside it."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"))
    made = sitewide.groups(sitewide.marked_lines(found))
    return made.select("site_id", "n_pages", "first_url", F.exists("lines", lambda x: F.startswith(x, F.lit("+New block for all"))).alias("named"))


@query(
    f"""SELECT site_id, url, 'Сквозное изменение на ' || n || ' стр.: Banner' AS summary, 'medium' AS importance, n AS sitewide_pages FROM (
        SELECT d.site_id, d.url, count(*) OVER (PARTITION BY d.site_id) AS n FROM ({_DIFF}) d WHERE change_type = 'changed') WHERE n >= 3""",
    "crawl_prev", "crawl_cur",
)
def shared_answers(spark, sf):
    """Changed pages that got the same three lines and nothing else take the answer for the block."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False).filter("change_type = 'changed'")
    same = found.withColumn("old_text", F.concat(F.lit("Page "), "url")).withColumn("new_text", F.concat(F.lit("Page "), "url", F.lit("\nBanner of all\nwith two lines more\nand the last one")))
    marked = sitewide.marked_lines(same)
    answers = marked.filter("cluster is not null").select("cluster").distinct().select("cluster", F.lit("Banner").alias("summary"), F.lit("medium").alias("importance"))
    return sitewide.group_answers(marked, sitewide.own_changes(marked), answers)


# --- pages ----------------------------------------------------------------------------------------------------------

_BODY = "repeat('Lesson ' || doc_id || ' in ' || lang || ' for all. ', 30)"


def _page():
    """A page of one of four builds: marked body, article with its heading, main part, or bare paragraphs."""
    body = F.repeat(F.concat(F.lit("Lesson "), _id(), F.lit(" in "), "lang", F.lit(" for all. ")), 30)
    inner = F.concat(F.lit("<h1> Head \n "), _id(), F.lit("</h1><nav><a href='/in'>Inside menu</a></nav><p>"), body, F.lit("</p><h2>Part <b>one</b></h2><p>More <a href='/x?a=1&amp;b=2'>of it</a>.</p><h3> </h3><h3>Last</h3>"))
    box = (
        F.when(_n() % 4 == 0, F.concat(F.lit("<div><div itemprop='articleBody'>"), inner, F.lit("</div></div>")))
        .when(_n() % 4 == 1, F.concat(F.lit("<main><article>"), inner, F.lit("</article></main>")))
        .when(_n() % 4 == 2, F.concat(F.lit("<main>"), inner, F.lit("</main>")))
        .otherwise(F.concat(F.lit("<section>"), inner, F.lit("</section>")))
    )
    head = F.concat(F.lit("<html><head><title> Title  "), _id(), F.lit("</title><meta name='Description' content=' About  "), "lang", F.lit("'><script>var a='<p>no</p>';</script></head>"))
    return F.concat(head, F.lit("<body><nav><ul><li><a href='/menu'>Menu</a></li></ul></nav><div><p>Short</p></div>"), box, F.lit("<footer><p>Foot</p></footer></body></html>"))


@query(
    f"""SELECT doc_id, 'Title ' || doc_id AS meta_title, 'About ' || lang AS meta_description, 'Head ' || doc_id AS h1, '2 Part one;3 Last' AS headings,
        'Head' || chr(10) || doc_id || chr(10) || trim({_BODY}) || chr(10) || 'Part one' || chr(10) || 'More of it.' || chr(10) || 'Last' AS main_text FROM documents"""
)
def page_structures(spark, sf):
    made = view(spark, sf, "documents").select("doc_id", markup.extract_structure(_page()).alias("s"))
    heads = F.array_join(F.transform("s.headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"])), ";")
    return made.select("doc_id", "s.meta_title", "s.meta_description", "s.h1", heads.alias("headings"), "s.main_text")


@query(
    """SELECT doc_id, nth, href, text FROM (SELECT doc_id, unnest([0, 1, 2]) AS nth, unnest(['/menu', '/in', '/x?a=1&b=2']) AS href, unnest(['Menu', 'Inside menu', 'of it']) AS text FROM documents)"""
)
def page_links(spark, sf):
    made = view(spark, sf, "documents").select("doc_id", F.posexplode(markup.extract_links(_page())).alias("nth", "l"))
    return made.select("doc_id", "nth", "l.href", "l.text")


@query(
    """SELECT doc_id, 'Item ' || lang AS meta_title, CASE WHEN doc_id % 2 = 0 THEN 'Said' END AS meta_description, 'Top ' || doc_id AS h1, '2 Part;3 Deep' AS headings, 'Line one' || chr(10) || 'Line two' AS main_text FROM documents"""
)
def item_structures(spark, sf):
    """Crawled items: clean text, headings from the lines of their markdown."""
    marked = F.concat(F.lit("# *Top*  "), _id(), F.lit("\ntext # no heading\n## Part\n###   Deep \n####### seven\n## **\n"))
    item = markup.item_structure(F.concat(F.lit(" Item  "), "lang"), F.when(_n() % 2 == 0, "Said").otherwise(" "), marked, F.lit("  Line   one\n\n Line two \n"))
    made = view(spark, sf, "documents").select("doc_id", item.alias("s"))
    heads = F.array_join(F.transform("s.headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"])), ";")
    return made.select("doc_id", "s.meta_title", "s.meta_description", "s.h1", heads.alias("headings"), "s.main_text")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'M' WHEN 2 THEN 'meta' ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'marked ' || doc_id ELSE 'plain ' || doc_id END AS text
       FROM documents WHERE doc_id % 5 <> 0"""
)
def crawled_items(spark, sf):
    """Items without an address or a text are left out; the text, else the markdown; the title of the metadata first."""
    rows = view(spark, sf, "documents").select(
        F.when(_n() % 10 == 0, "").when(_n() % 5 != 0, F.concat(F.lit("https://x.example/"), _id())).alias("url"), F.when(_n() % 3 == 0, "").otherwise(F.concat(F.lit("plain "), _id())).alias("text"),
        F.concat(F.lit("marked "), _id()).alias("markdown"), F.when(_n() % 4 == 0, "T").when(_n() % 4 == 2, "other").alias("title"),
        F.struct(F.when(_n() % 4 == 1, "M").when(_n() % 4 == 2, "meta").otherwise("").alias("title"), F.lit("d").alias("description")).alias("metadata"),
    )
    return store.crawled_items(rows).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("doc_id"), "title", "text")


# --- addresses, lists, pages of a feed ------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://a' || doc_id || '.ru' WHEN 1 THEN 'http://a' || doc_id || '.ru/x' WHEN 2 THEN 'https://a' || doc_id || '.ru/x?y=1' END AS url,
       doc_id % 5 IN (0, 1) AS blocked FROM documents"""
)
def user_addresses(spark, sf):
    """Addresses as users type them, and requests that a crawl does not make: by kind, by tracker."""
    k, host = _n() % 6, F.concat(F.lit("a"), _id())
    raw = (
        F.when(k == 0, F.concat(F.lit("  "), host, F.lit(".ru/ "))).when(k == 1, F.concat(F.lit("http://"), host, F.lit(".ru/x//"))).when(k == 2, F.concat(host, F.lit(".ru/x?y=1")))
        .when(k == 3, host).when(k == 4, F.concat(F.lit("ftp://"), host, F.lit(".ru"))).otherwise(F.lit("https:// "))
    )
    kind = F.when(_n() % 5 == 0, "image").otherwise("document")
    asked = F.when(_n() % 5 == 1, f"https://{urls.TRACKER_PARTS[0]}/t.js").otherwise("https://a.example/")
    return view(spark, sf, "documents").select("doc_id", urls.checked_url(raw).alias("url"), urls.is_blocked_request(kind, asked).alias("blocked"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN CAST(least(doc_id, 13) AS INT) WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 13 END AS page,
       CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id || chr(10) || repeat('x', 20) ELSE 'Head ' || doc_id END AS message,
       'A;b;' || CASE WHEN doc_id % 3 = 0 THEN 'c' ELSE 'C' || doc_id END AS united FROM documents"""
)
def feed_paging(spark, sf):
    """Page numbers as users type them, kept within the thirteen pages of 125 rows; messages cut at a whole line; lists
    united whatever the case."""
    k = _n() % 5
    raw = F.when(k == 0, "x").when(k == 1, _id()).when(k == 2, "-3").when(k == 4, "999")
    page = text.clamp_page(F.greatest(F.coalesce(raw.try_cast("int"), F.lit(1)), F.lit(1)), F.lit(125), 10)
    long = F.concat(F.lit("Head "), _id(), F.lit("\n"), F.repeat(F.lit("x"), F.when(_n() % 2 == 0, 20).otherwise(90)), F.lit("\n"), F.repeat(F.lit("y"), 60))
    more = F.array(F.lit("B"), F.when(_n() % 3 == 0, "c").otherwise(F.concat(F.lit("C"), _id())))
    united = F.array_join(text.union_ci(F.array(F.lit("A"), F.lit("b")), more), ";")
    return view(spark, sf, "documents").select("doc_id", page.alias("page"), text.cut_lines(long, 64).alias("message"), united.alias("united"))


@query(
    f"""SELECT site_id, strftime(CASE WHEN due THEN TIMESTAMP '{NOW}' + INTERVAL 2 MINUTE ELSE TIMESTAMP '2024-02-04 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS next_run, due AS overdue
        FROM (SELECT site_id, coalesce(next_crawl_at <= TIMESTAMP '{NOW}' + INTERVAL 2 MINUTE AND site_id % 4 <> 3, false) AS due FROM (SELECT site_id, CASE WHEN site_id % 5 = 0 THEN NULL WHEN site_id % 5 = 1 THEN next_crawl_at + INTERVAL 20 DAY ELSE next_crawl_at END AS next_crawl_at FROM sites))""",
    "sites",
)
def planned_runs(spark, sf):
    """Runs that are overdue start soon, those reset and those to come wait for the next Sunday at three in Moscow."""
    saved = F.when(F.col("site_id") % 5 == 1, F.col("next_crawl_at") + F.expr("interval 20 days")).when(F.col("site_id") % 5 != 0, F.col("next_crawl_at"))
    now, reset = F.lit(NOW).cast("timestamp"), F.col("site_id") % 4 == 3
    return view(spark, sf, "sites").select("site_id", F.date_format(text.next_run(saved, now, reset=reset), "yyyy-MM-dd HH:mm:ss").alias("next_run"), text.is_overdue(saved, now, reset).alias("overdue"))


@query("SELECT site_id FROM previous_pages GROUP BY site_id HAVING site_id % 2 = 1", "previous_pages")
def unavailable_sites(spark, sf):
    """Sites with odd numbers bring no page."""
    current = view(spark, sf, "crawl_cur").filter("site_id % 2 = 0")
    return snapshots.unavailable(view(spark, sf, "previous_pages"), current)


@query(
    """SELECT page_id, coalesce(meta_title, '') AS meta_title, h1, CASE WHEN page_id % 2 = 0 THEN '2 Part one;3 Part ' || page_id ELSE '' END AS headings, coalesce(main_text, '') AS main_text
       FROM structures""",
    "structures",
)
def structure_records(spark, sf):
    """Stored structures with their headings as JSON, some without any."""
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('[[2, "Part one"], ["3", "Part '), F.col("page_id").cast("string"), F.lit('"]]'))).when(F.col("page_id") % 4 == 1, "null")
    made = reports.structure_records(view(spark, sf, "structures").withColumn("headings", raw))
    heads = F.array_join(F.transform("headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"])), ";")
    return made.select("page_id", F.coalesce("meta_title", F.lit("")).alias("meta_title"), "h1", heads.alias("headings"), "main_text")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Head ' || doc_id END AS h1,
        CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat_ws(chr(10), 'Title  ' || doc_id, 'Short', 'Head', doc_id, trim({_BODY}), 'Part', 'one', 'More', 'of it', '.', 'Last') END AS text FROM documents"""
)
def fetched_pages(spark, sf):
    """What a fetch brings: title, text and structure; a page without content has an empty text and structure."""
    rows = view(spark, sf, "documents").select("doc_id", F.when(_n() % 7 != 0, _page()).alias("html"))
    return reports.fetched_pages(rows).select("doc_id", "title", "structure.h1", "text")


# --- labels and notes -----------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ab cd ' || doc_id ELSE 'ab cdefgh…' END AS clipped, CASE WHEN doc_id % 2 = 0 THEN 'ab cd ' || doc_id ELSE 'ab cdefg …' END AS hard,
       2 + 2 * (doc_id % 3) + length(CAST(doc_id AS STRING)) AS units, CASE WHEN doc_id % 5 = 0 THEN '—' ELSE strftime(TIMESTAMP '2024-01-31 22:30:00' + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') END AS screen,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE '01.02.2024' END AS sheet, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'не задано' WHEN doc_id % 4 = 0 THEN 'каждые ' || doc_id % 3 || ' дн.'
         WHEN doc_id % 3 = 0 THEN 'каждые ' || doc_id % 4 || ' ч' ELSE 'каждые ' || doc_id % 3 || ' дн. ' || doc_id % 4 || ' ч' END AS interval FROM documents"""
)
def written_forms(spark, sf):
    """Clipped texts with and without the blank before the ellipsis, lengths in code units, times and intervals."""
    raw = F.concat(F.lit(" ab   cd "), _id())
    one = lambda f: F.when(_n() % 2 == 0, f(raw, 20)).otherwise(f(F.lit("ab cdefgh ijkl") if f is text.clip else F.lit("ab cdefg ijklm"), 10))
    at = F.when(_n() % 5 != 0, F.lit("2024-01-31 22:30:00").cast("timestamp"))
    wide = F.concat(F.lit("ab"), F.repeat(F.lit("😀"), (_n() % 3).cast("int")), _id())
    return view(spark, sf, "documents").select(
        "doc_id", one(text.clip).alias("clipped"), one(text.clip_hard).alias("hard"), text.utf16_length(wide).cast("long").alias("units"), text.stamp(at, "screen").alias("screen"),
        text.stamp(at, "sheet", empty="").alias("sheet"), text.interval_label(_n() % 3, _n() % 4).alias("interval"),
    )


@query(
    """SELECT site_id, CASE status WHEN 'active' THEN 'работает' ELSE 'нужна ручная сессия' END || CASE WHEN is_paused THEN ', пауза' ELSE '' END || CASE WHEN is_crawling THEN ', ⏳ обход идёт' ELSE '' END AS state,
       CASE WHEN is_paused THEN 'на паузе' WHEN cookies_only THEN 'по свежим кукам — пришлите выгрузку из Cookie-Editor' ELSE strftime(next_crawl_at + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') END AS next_crawl,
       CASE WHEN NOT is_crawling THEN NULL WHEN site_id % 2 = 0 THEN 'обошли ' || coalesce(n, 0) || ' из 340 страниц' WHEN n IS NULL THEN 'ищем страницы в карте сайта' ELSE 'обошли ' || n || ' страниц' END AS progress
       FROM sites LEFT JOIN (SELECT site_id, count(*) AS n FROM changes GROUP BY site_id) USING (site_id)""",
    "sites", "changes",
)
def site_labels(spark, sf):
    sites = view(spark, sf, "sites").withColumn("crawl_pages_total", F.when(F.col("site_id") % 2 == 0, 340))
    return reports.site_labels(sites, view(spark, sf, "changes").groupBy("site_id").agg(F.count("*").alias("n")))


@query(
    """SELECT run_id, CASE WHEN attempted = 0 THEN NULL WHEN done = attempted THEN 'Дозаправлен ИИ-разбор для находок, оставшихся без него раньше: ' || done || '.'
         ELSE 'Дозаправлен ИИ-разбор для находок без него: ' || done || ' из ' || attempted || '. Остальные ' || (attempted - done) || ' попробуем в следующем обходе.' END AS backfill,
       CASE WHEN cards + skipped > 0 THEN 'SEO: разобрано инфостатей (интент, подинтенты) — ' || cards || '.' || CASE WHEN n_new + n_covered > 0 THEN ' Решения: ' || concat_ws(', ',
         CASE WHEN n_new > 0 THEN 'написать новую статью — ' || n_new END, CASE WHEN n_covered > 0 THEN 'у нас раскрыто — ' || n_covered END) || '.' ELSE '' END
         || CASE WHEN merged > 0 THEN ' Тех же тем, что уже разобраны (склеены): ' || merged || '.' ELSE '' END || CASE WHEN skipped > 0 THEN ' Не успели — ' || skipped || ', доберём стартовым аудитом или в следующий раз.' ELSE '' END
         || CASE WHEN run_id % 13 = 0 THEN ' Упёрлись в лимит подписки Claude.' ELSE '' END END AS seo
       FROM (SELECT CAST(event_id AS BIGINT) AS run_id, event_id % 3 AS done, event_id % 3 + event_id % 2 AS attempted, event_id % 4 AS cards, event_id % 5 AS skipped, event_id % 7 AS n_new, event_id % 2 AS n_covered, event_id % 6 AS merged FROM events)"""
)
def run_note_texts(spark, sf):
    e = F.col("event_id")
    rows = view(spark, sf, "events").select(
        e.cast("long").alias("run_id"), (e % 3).alias("done"), (e % 3 + e % 2).alias("attempted"), (e % 4).alias("cards"), (e % 5).alias("cards_skipped"), F.lit(0).alias("not_compared"),
        (e % 6).alias("merged"), (e % 13 == 0).alias("limit_hit"), (e % 7).alias("n_new"), F.lit(0).alias("n_update"), (e % 2).alias("n_covered"),
    )
    return reports.run_note(rows)


@query(
    """SELECT finding_id, CAST(nth AS INT) AS nth, line FROM (SELECT finding_id, unnest(range(0, 9)) AS nth, unnest(['## ' || url, '- Тема: ' || topic || ' (тип: ' || coalesce(material_type, '—') || ')', '- Основной интент: ' || main_intent,
         '- Подинтенты: ' || replace(subintents, ';', '; '), '- Решение: **' || decision || '**' || coalesce(' → ' || our_url, ''), '- Добавить: ' || coalesce(nullif(replace(add_subintents, ';', '; '), ''), '—'),
         '- Аргумент: ' || coalesce(argument, '—'), '- Каннибализация: ' || coalesce(nullif(replace(cannibal_urls, ';', ', '), ''), 'нет'), '']) AS line FROM findings JOIN decisions USING (decision_id) WHERE kind = 'audit')
       UNION ALL SELECT -1, CAST(unnest([0, 1, 2, 3]) AS INT), unnest(['# Pilot', '', 'Тем: ' || (SELECT count(*) FROM findings JOIN decisions USING (decision_id) WHERE kind = 'audit') || '.', ''])""",
    "findings", "decisions",
)
def pilot_lines(spark, sf):
    """The findings of the audit with their decisions as the lines of a Markdown file."""
    listed = lambda c: F.when(F.col(c) != "", F.split(c, ";"))
    rows = view(spark, sf, "findings").filter("kind = 'audit'").join(view(spark, sf, "decisions"), "decision_id")
    rows = rows.withColumns({c: listed(c) for c in ("subintents", "add_subintents", "cannibal_urls")})
    return reports.pilot_lines(rows, "Pilot").select("place.finding_id", F.col("place.k").alias("nth"), "line")


# --- counters and queues of the marts -------------------------------------------------------------------------------


@query(
    f"""SELECT 'runs' AS part, decision, count(DISTINCT decision_id) AS topics FROM findings JOIN decisions USING (decision_id) WHERE kind IN ('new', 'changed') AND detected_at >= TIMESTAMP '{SINCE}' GROUP BY decision
        UNION ALL SELECT 'audit', decision, count(DISTINCT decision_id) FROM findings JOIN decisions USING (decision_id) WHERE kind = 'audit' GROUP BY decision""",
    "findings", "decisions",
)
def topics_by_decision(spark, sf):
    """Topics by decision: those that crawls found in the last week, and those of the audit."""
    found, decided = view(spark, sf, "findings"), view(spark, sf, "decisions")
    week = reports.decision_counts(found, decided, ["new", "changed"], SINCE).select(F.lit("runs").alias("part"), "decision", "topics")
    return week.unionByName(reports.decision_counts(found, decided, ["audit"]).select(F.lit("audit").alias("part"), "decision", "topics"))


_WEEK = f"(SELECT c.*, CASE importance WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS rank, verdict FROM changes c JOIN sites s USING (site_id) LEFT JOIN compared USING (change_id) WHERE NOT is_own AND detected_at >= TIMESTAMP '{SINCE}')"


@query(
    f"""SELECT list, CAST(nth AS INT) AS nth, change_id, total FROM (
        SELECT 'top' AS list, row_number() OVER (ORDER BY rank, detected_at DESC, change_id DESC) AS nth, change_id, count(*) OVER () AS total FROM {_WEEK} WHERE rank < 2
        UNION ALL SELECT 'missing', row_number() OVER (ORDER BY detected_at DESC, change_id DESC), change_id, count(*) OVER () FROM {_WEEK} WHERE verdict = 'none')
        WHERE nth <= CASE list WHEN 'top' THEN 7 ELSE 5 END""",
    "changes", "sites", "compared",
)
def digest_lists(spark, sf):
    rows = view(spark, sf, "changes").join(view(spark, sf, "compared").select("change_id", "verdict"), "change_id", "left")
    return marts.digest_lists(rows, view(spark, sf, "sites"), SINCE)


@query(
    f"""SELECT change_id, site_id, url FROM (SELECT m.page_id AS change_id, d.* FROM ({_DIFF}) d JOIN monitored m ON m.site_id = d.site_id AND m.url = d.url) d JOIN sites s USING (site_id)
        LEFT JOIN crawl_prev p ON p.site_id = d.site_id AND p.url = d.url LEFT JOIN crawl_cur c ON c.site_id = d.site_id AND c.url = d.url
        WHERE (change_type <> 'changed' OR regexp_replace(p.text, '\\n[0-9]+$', '') <> regexp_replace(c.text, '\\n[0-9]+$', '')) AND change_id % 6 <> 0
          AND (include_paths = '' OR (include_paths = '/blog' AND regexp_matches(d.url, '/blog/')) OR (include_paths = '!/news' AND NOT regexp_matches(d.url, '/news/')))
          AND (is_own OR NOT regexp_matches(d.url, '/spo/')) ORDER BY change_id LIMIT 50""".replace("SELECT change_id, site_id, url FROM", "SELECT change_id, d.site_id, d.url FROM"),
    "crawl_prev", "crawl_cur", "monitored", "sites",
)
def backfill_queue(spark, sf):
    """The oldest fifty changes without an analysis (numbers divisible by six have one) that rules and noise leave over."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False)
    ids = view(spark, sf, "monitored").select("site_id", "url", F.col("page_id").alias("change_id"))
    analysed = ids.filter("change_id % 6 = 0").select("change_id")
    return marts.backfill_queue(found.join(ids, ["site_id", "url"]), analysed, view(spark, sf, "sites")).select("change_id", "site_id", "url")


@query("SELECT change_id FROM changes WHERE site_id NOT IN (SELECT site_id FROM sites WHERE is_own)", "changes", "sites")
def changes_to_compare(spark, sf):
    return reports.to_compare(view(spark, sf, "changes"), view(spark, sf, "sites")).select("change_id")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Page   ' || page_id END AS title FROM pages""")
def loaded_titles(spark, sf):
    """Titles over several lines and in capitals; some are empty."""
    head = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("<html><TITLE lang='x'>\n Page   "), F.col("page_id").cast("string"), F.lit(" \n</Title>"))).otherwise(F.lit("<title> </title>"))
    return view(spark, sf, "pages").select("page_id", text.page_title(F.concat(head, "html")).alias("title"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '[[2,"Part \\"one\\""],[3,"Part ' || page_id || '"]]' END AS headings FROM structures""", "structures"
)
def stored_headings(spark, sf):
    """Headings as they are stored, and read back the same."""
    heads = F.array(F.struct(F.lit(2).alias("level"), F.lit('Part "one"').alias("text")), F.struct(F.lit(3).alias("level"), F.concat(F.lit("Part "), F.col("page_id").cast("string")).alias("text")))
    rows = view(spark, sf, "structures").withColumn("headings", F.when(F.col("page_id") % 3 > 0, heads).otherwise(F.array().cast("array<struct<level:int,text:string>>")))
    stored = reports.stored_structures(rows)
    back = reports.structure_records(stored).select("page_id", F.col("headings").alias("again")).join(rows.select("page_id", F.col("headings").alias("had")), "page_id").filter("again = had")
    return stored.join(back, "page_id", "left_semi").select("page_id", "headings")


_LETTERS = "translate(regexp_extract(d.url, '([0-9]+)$', 1), '0123456789', 'abcdefghij')"


@query(
    f"""SELECT d.site_id, d.url, CASE WHEN length({_LETTERS}) % 2 = 0 THEN '+Own addition of this page ' || {_LETTERS} END AS own_text
        FROM (SELECT d.*, count(*) OVER (PARTITION BY d.site_id) AS n FROM ({_DIFF}) d WHERE change_type = 'changed') d WHERE n >= 3""",
    "crawl_prev", "crawl_cur",
)
def own_parts(spark, sf):
    """Changed pages that got the same three lines; some a line of their own apart from them, which is what is left."""
    found = snapshots.snapshot_diff(view(spark, sf, "crawl_prev"), view(spark, sf, "crawl_cur"), with_noise=False).filter("change_type = 'changed'")
    own = F.translate(F.regexp_extract("url", "([0-9]+)$", 1), "0123456789", "abcdefghij")
    line = F.when(F.length(own) % 2 == 0, F.concat(F.lit("\nOwn addition of this page "), own)).otherwise("")
    same = found.withColumn("old_text", F.concat(F.lit("Page "), "url", F.lit("\nmiddle line")))
    same = same.withColumn("new_text", F.concat(F.lit("Page "), "url", F.lit("\nBanner of all\nwith two lines more\nand the last one\nmiddle line"), line))
    return sitewide.own_changes(sitewide.marked_lines(same)).select("site_id", "url", "own_text")
