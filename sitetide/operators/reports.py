"""Queues, article inputs, comparison picks, report rows and counters that feed the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions import text, urls
from sitetide.functions.markup import extract_page
from sitetide.functions.noise import normalize_for_compare
from sitetide.operators.sitewide import SITEWIDE_LABEL
from sitetide.session import free_name

RECHECK_PAGES = 100
FULL_RECHECK_DAYS = 30
INDEX_TEXT = 3000
SUMMARY_LIMIT = 5
SUMMARY_LINE = 200
COMPARISONS = 10
#: Names of findings, of importance, of verdicts and of kinds of content in a report.
FINDING_LABELS = {"new": "Новая страница", "changed": "Изменение", "removed": "Страница удалена"}
MOVED_LABEL = "Страница переехала"
VERDICT_RANK = {"none": 0, "similar": 1, "exact": 2}


def _choice(of: Column, values: dict, otherwise=None) -> Column:
    made = F.lit(otherwise)
    for key, value in reversed(values.items()):
        made = F.when(of == key, F.lit(value)).otherwise(made)
    return made


# --- queues ---------------------------------------------------------------------------------------------------------


def recheck_queue(missing: DataFrame, most: int = RECHECK_PAGES) -> DataFrame:
    """``missing (site_id, url, last_checked_at)`` with ``asked``: of each site the ``most`` pages that were never checked
    or longest ago; the others stay unknown until the next crawl.

    The cut is taken by a filter on the rank, so Spark keeps no more than ``most`` rows of a site for each task.
    """
    order = Window.partitionBy("site_id").orderBy(F.col("last_checked_at").asc_nulls_first(), "url")
    asked = missing.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("site_id", "url", F.lit(True).alias("asked"))
    return missing.join(asked, ["site_id", "url"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def needs_full_crawl(last: Column, now, days: int = FULL_RECHECK_DAYS) -> Column:
    return last.isNull() | (F.lit(now).cast("timestamp") - last >= F.make_dt_interval(days=F.lit(days)))


def nightly_sites(sites: DataFrame) -> DataFrame:
    """Rivals to audit at night: neither paused nor being crawled."""
    return sites.filter("not is_own and not is_paused and not is_crawling")


def retire_pages(pages: DataFrame, seen: DataFrame, rules: DataFrame, now) -> DataFrame:
    """``pages`` with those removed now that were not seen, lie in a section opened anew, and did not before.

    ``seen`` has the pages and the failed loads of the crawl, ``rules (site_id, new_rules, old_rules)`` the opened sites.
    """
    keys = ["site_id", "url"]
    rows = pages.join(rules, "site_id", "left").join(seen.select(*keys).distinct().withColumn("met", F.lit(True)), keys, "left")
    stale = F.col("met").isNull() & F.col("old_rules").isNotNull() & urls.path_included(F.col("url"), F.col("new_rules")) & ~urls.path_included(F.col("url"), F.col("old_rules"))
    retire = ~F.col("is_removed") & F.coalesce(stale, F.lit(False))
    rows = rows.withColumn("removed_at", F.when(retire, F.lit(now).cast("timestamp")).otherwise(F.col("removed_at")))
    return rows.withColumn("is_removed", F.col("is_removed") | retire).select(pages.columns)


def without_structure(pages: DataFrame, structures: DataFrame) -> DataFrame:
    """Known info pages that have no structure yet: the next crawl loads them again."""
    return pages.filter(urls.is_info(F.col("url"))).join(structures.select("page_id"), "page_id", "left_anti")


def fresh_articles(diffs: DataFrame, structures: DataFrame) -> DataFrame:
    """New and changed info pages of a crawl with a structure from it."""
    rows = diffs.filter(F.col("change_type").isin("new", "changed")).filter(urls.is_info(F.col("url")))
    return rows.join(structures, ["site_id", "url"])


# --- article inputs -------------------------------------------------------------------------------------------------


def intent_hash(structures: DataFrame) -> DataFrame:
    """``page_id, content_hash`` of what a card is made of: first heading, outline, and text without noise.

    ``structures`` has ``h1``, ``headings`` (array of level and text) and ``main_text``.
    """
    outline = F.array_join(F.transform("headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["text"])), "\n")
    plain = F.coalesce(normalize_for_compare(F.coalesce("main_text", F.lit(""))), F.lit(""))
    whole = F.concat(F.coalesce("h1", F.lit("")), F.lit("\n"), F.coalesce(outline, F.lit("")), F.lit("\n"), plain)
    return structures.select("page_id", text.content_hash(whole).alias("content_hash"))


def card_text(topic: Column, intent: Column, subintents: Column, entities: Column) -> Column:
    return F.concat_ws(" ", topic, intent, subintents, entities)


def own_documents(pages: DataFrame, snapshots: DataFrame, sites: DataFrame) -> DataFrame:
    """``page_id, url, title, text`` of active pages of the own site with their latest text; pages without one are out."""
    own = pages.filter("not is_removed").join(sites.filter("is_own").select("site_id"), "site_id", "left_semi")
    last = snapshots.groupBy("page_id").agg(F.max_by("text", F.struct("taken_at", "snapshot_id")).alias("text"))
    return own.join(last, "page_id").select("page_id", "url", "title", "text")


def own_articles(pages: DataFrame, structures: DataFrame, snapshots: DataFrame, cards: DataFrame, sites: DataFrame) -> DataFrame:
    """``page_id, url, title, text`` of the own site's articles for the index: card, headings and the first of the text.

    The title is the first heading, else the title of the head, else that of the page; without a structure the page's
    title and latest text stand, and without either a page is out.
    """
    own = pages.filter("not is_removed").filter(urls.is_info(F.col("url"))).join(sites.filter("is_own").select("site_id"), "site_id", "left_semi")
    last = snapshots.groupBy("page_id").agg(F.max_by("text", F.struct("taken_at", "snapshot_id")).alias("last_text"))
    rows = own.select("page_id", "url", "title").join(structures.select("page_id", "h1", "meta_title", "headings", "main_text", F.lit(True).alias("has")), "page_id", "left")
    rows = rows.join(last, "page_id", "left").join(cards, "page_id", "left").filter("has or last_text is not null")

    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    title = F.when(F.col("has"), F.coalesce(filled("h1"), filled("meta_title"), F.col("title"))).otherwise(F.col("title"))
    body = F.when(F.col("has"), F.coalesce("main_text", F.lit(""))).otherwise(F.col("last_text"))
    return rows.select("page_id", "url", title.alias("title"), index_text(body).alias("text"))


def index_text(body: Column) -> Column:
    """Card text, headings and the first characters of a body, of rows with a card's and a structure's columns."""
    card = F.when(F.col("topic").isNotNull(), card_text(F.col("topic"), F.col("main_intent"), F.col("subintents"), F.col("entities"))).otherwise(F.lit(""))
    heads = F.coalesce(F.array_join(F.transform("headings", lambda h: h["text"]), " "), F.lit(""))
    return F.concat(card, F.lit(" "), heads, F.lit(" "), F.substring(body, 1, INDEX_TEXT))


def rival_articles(structures: DataFrame, cards: DataFrame) -> DataFrame:
    """``page_id, title, text`` of rivals' articles as queries: first heading and topic; card, headings and text."""
    rows = structures.join(cards, "page_id")
    return rows.select("page_id", F.concat_ws(" ", F.nullif("h1", F.lit("")), F.nullif("topic", F.lit(""))).alias("title"), index_text(F.coalesce("main_text", F.lit(""))).alias("text"))


# --- comparisons ----------------------------------------------------------------------------------------------------


def comparison_picks(diffs: DataFrame, k: int = COMPARISONS) -> DataFrame:
    """Of each site the first ``k`` differences to compare with the own one: new pages, then changed ones, by address.

    ``compare_text`` is the page's present text; removed pages are out.
    """
    rows = diffs.filter("change_type <> 'removed'").withColumn("rank", (F.col("change_type") == "changed").cast("int"))
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("rank", "url"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= k)
    return rows.select("site_id", "url", "change_type", "nth", F.nullif("new_text", F.lit("")).alias("compare_text"))


def verdict_rank(verdict: Column) -> Column:
    return F.coalesce(_choice(verdict, VERDICT_RANK), F.lit(3))


def comparison_summary(compared: DataFrame, k: int = SUMMARY_LIMIT) -> DataFrame:
    """Of each site the first ``k`` comparisons, those without an own page first, and how many more there are."""
    order = Window.partitionBy("site_id").orderBy(F.col("our_url").isNotNull(), "ord")
    rows = compared.withColumn("nth", F.row_number().over(order)).withColumn("more", F.greatest(F.count("*").over(Window.partitionBy("site_id")) - k, F.lit(0)))
    return rows.filter(F.col("nth") <= k)


# --- reports --------------------------------------------------------------------------------------------------------


def finding_label(change_type: Column, moved_to: Column, sitewide_pages: Column) -> Column:
    """A shared change, else a move, else by type."""
    return F.when(sitewide_pages.isNotNull(), SITEWIDE_LABEL).when(moved_to.isNotNull(), MOVED_LABEL).otherwise(_choice(change_type, FINDING_LABELS))


def finding_url(url: Column, related: Column, sitewide_pages: Column) -> Column:
    """A shared change leads to the page that it advertises, if that is an address."""
    return F.when(sitewide_pages.isNotNull() & F.startswith(related, F.lit("http")), related).otherwise(url)


def short(value: Column, limit: int = SUMMARY_LINE) -> Column:
    """Blanks run together, cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def finding_counts(findings: DataFrame) -> DataFrame:
    """For each site: findings by label, high ones, and those for readers of articles; low ones only as ``minor``.

    ``findings`` has ``change_type, moved_to, sitewide_pages, importance, category, url``.
    """
    label = finding_label(F.col("change_type"), F.col("moved_to"), F.col("sitewide_pages"))
    minor = F.coalesce(F.col("importance") == "low", F.lit(False))
    rows = findings.withColumn("label", label).withColumn("minor", minor)
    info = urls.content_kind(F.col("url"), F.col("category")) == "info"
    named = {"new": FINDING_LABELS["new"], "changed": FINDING_LABELS["changed"], "removed": FINDING_LABELS["removed"], "moved": MOVED_LABEL, "sitewide": SITEWIDE_LABEL}
    return rows.groupBy("site_id").agg(
        F.count_if(~F.col("minor")).alias("findings"),
        *[F.count_if(~F.col("minor") & (F.col("label") == said)).alias(f"n_{name}") for name, said in named.items()],
        F.count_if(F.col("importance") == "high").alias("n_high"),
        F.count_if(~F.col("minor") & info).alias("n_info"),
        F.count_if(~F.col("minor") & ~info).alias("n_commerce"),
        F.count_if("minor").alias("minor"),
    )


def report_lists(findings: DataFrame, baseline: DataFrame | None = None, k: int = SUMMARY_LIMIT) -> DataFrame:
    """``site_id, list, nth, line, url, total``: the first ``k`` important findings and those that the own site lacks.

    Important ones keep their order ``ord``; the missing ones (verdict ``none``) come by importance, then the first
    comparisons ``baseline (site_id, ord, url, verdict, missing)`` with that verdict, in their order.
    """
    rows = findings.filter(~F.coalesce(F.col("importance") == "low", F.lit(False)))
    rows = rows.withColumn("to", finding_url(F.col("url"), F.col("related_url"), F.col("sitewide_pages")))
    why = F.coalesce(F.nullif("importance_reason", F.lit("")), F.col("summary"))
    important = rows.filter("importance = 'high'").select("site_id", F.lit("important").alias("list"), F.lit(0).alias("rank"), "ord", short(why).alias("line"), "to")
    lacking = rows.filter("verdict = 'none'").select("site_id", F.lit("missing").alias("list"), text.importance_rank(F.col("importance")).alias("rank"), "ord", short(F.col("summary")).alias("line"), "to")
    both = important.unionByName(lacking)
    if baseline is not None:
        first = baseline.filter("verdict = 'none'")
        both = both.unionByName(first.select("site_id", F.lit("missing").alias("list"), F.lit(3).alias("rank"), "ord", short(F.col("missing")).alias("line"), F.col("url").alias("to")))
    totals = both.groupBy("site_id", "list").agg(F.count("*").alias("total"))
    top = both.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "list").orderBy("rank", "ord"))).filter(F.col("nth") <= k)
    return top.join(totals, ["site_id", "list"]).select("site_id", "list", "nth", "line", F.col("to").alias("url"), "total")


def overview_items(findings: DataFrame, baseline: DataFrame, most: int = 40) -> DataFrame:
    """``site_id, nth, label, url``: findings that are not minor by importance, then first comparisons, lacking ones first."""
    label = F.when(F.col("sitewide_pages").isNotNull(), F.concat(F.lit(f"{SITEWIDE_LABEL} на "), F.col("sitewide_pages"), F.lit(" стр."))).otherwise(
        finding_label(F.col("change_type"), F.col("moved_to"), F.col("sitewide_pages"))
    )
    own = findings.filter(~F.coalesce(F.col("importance") == "low", F.lit(False)))
    own = own.select("site_id", F.lit(0).alias("part"), text.importance_rank(F.col("importance")).alias("rank"), "ord", label.alias("label"), finding_url(F.col("url"), F.col("related_url"), F.col("sitewide_pages")).alias("url"))
    first = baseline.select("site_id", F.lit(1).alias("part"), (F.col("verdict") != "none").cast("int").alias("rank"), "ord", F.lit("Первый обход").alias("label"), "url")
    rows = own.unionByName(first)
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("part", "rank", "ord"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select("site_id", "nth", "label", "url")


#: Names in the cells of a report's rows.
TYPE_CELLS = FINDING_LABELS
IMPORTANCE_CELLS = {"high": "🔥 Важно", "low": "Мелочь"}
KIND_CELLS = {"info": "Инфо (SEO)", "commerce": "Коммерция (продукт)"}
VERDICT_CELLS = {"exact": "У нас такое есть", "similar": "У нас похожее есть", "none": "У нас такого нет"}


def report_rows(findings: DataFrame, types: dict = TYPE_CELLS, grades: dict = IMPORTANCE_CELLS, kinds: dict = KIND_CELLS, verdicts: dict = VERDICT_CELLS) -> DataFrame:
    """The ten cells of each finding of a report, null-free; the names in them are parameters. A shared change has a row
    of its first page here; ``shared_rows`` makes that of its block.

    ``findings`` has the columns of a change, of its analysis (``category, usp, cta, summary, importance,
    importance_reason``), of a move (``moved_to, moved_summary``) and of a comparison (``verdict, our_url, differences,
    missing``).
    """
    empty = F.lit("")

    def said(c: str) -> Column:
        return F.coalesce(F.col(c), empty)

    def line(head: str, c: str, when: Column | None = None) -> Column:
        has = F.coalesce(F.col(c) != "", F.lit(False))
        return F.when(has if when is None else has & when, F.concat(F.lit(head), F.col(c)))

    high = F.coalesce(F.col("importance") == "high", F.lit(False))
    grade = _choice(F.col("importance"), grades)
    kind = F.when(F.coalesce("moved_to", empty) != "", MOVED_LABEL).otherwise(_choice(F.col("change_type"), types))
    verdict = F.coalesce(_choice(F.col("verdict"), verdicts), empty)
    return findings.select(
        F.date_format("detected_at", "yyyy-MM-dd\nHH:mm").alias("detected"),
        F.concat_ws("\n", kind, grade).alias("type"),
        "url",
        said("category").alias("category"),
        _choice(urls.content_kind(F.col("url"), F.col("category")), kinds).alias("kind"),
        said("usp").alias("usp"),
        said("cta").alias("cta"),
        F.concat_ws("\n", F.nullif("summary", empty), line("Новый адрес: ", "moved_to"), line("Теперь там: ", "moved_summary"), line("Почему важно: ", "importance_reason", high)).alias("description"),
        F.concat_ws("\n", F.nullif(verdict, empty), F.nullif("our_url", empty)).alias("verdict"),
        F.concat_ws("\n", line("Отличия: ", "differences"), line("Чего нам не хватает: ", "missing")).alias("details"),
    )


def shared_rows(groups: DataFrame, grades: dict = IMPORTANCE_CELLS, kinds: dict = KIND_CELLS, examples: int = 3) -> DataFrame:
    """The ten cells of each change that many pages share: one row for the block, not one for each page.

    ``groups (detected_at, urls, n_pages, related_url, category, usp, cta, summary, importance, importance_reason)``, where
    ``urls`` holds the first pages at least. The address cell has the page that the block advertises, if that is an
    address, a few examples and how many more there are; the cells of a comparison stay empty.
    """
    empty = F.lit("")
    grade = _choice(F.col("importance"), grades)
    leads = F.when(F.startswith("related_url", F.lit("http")), F.concat(F.lit("Ведёт на: "), "related_url"))
    rest = F.when(F.col("n_pages") > examples, F.concat(F.lit("и ещё "), (F.col("n_pages") - examples).cast("string")))
    why = F.when((F.col("importance") == "high") & (F.coalesce("importance_reason", empty) != ""), F.concat(F.lit("Почему важно: "), "importance_reason"))
    return groups.select(
        F.date_format("detected_at", "yyyy-MM-dd\nHH:mm").alias("detected"),
        F.concat_ws("\n", F.lit(SITEWIDE_LABEL), F.concat(F.lit("на "), F.col("n_pages").cast("string"), F.lit(" стр.")), grade).alias("type"),
        F.concat_ws("\n", leads, F.lit("Примеры:"), F.array_join(F.slice("urls", 1, examples), "\n"), rest).alias("url"),
        F.coalesce("category", empty).alias("category"),
        _choice(urls.content_kind(F.get("urls", F.lit(0)), F.col("category")), kinds).alias("kind"),
        F.coalesce("usp", empty).alias("usp"),
        F.coalesce("cta", empty).alias("cta"),
        F.concat_ws("\n", F.coalesce(F.nullif("summary", empty), F.lit("Блок изменился на многих страницах сразу.")), why).alias("description"),
        empty.alias("verdict"),
        empty.alias("details"),
    )


def structure_records(rows: DataFrame) -> DataFrame:
    """Stored structures with ``headings``, a JSON list of pairs (level, text), as a list of structs; nothing is null but
    what has no default: no headings are an empty list, no text is empty."""
    pairs = F.from_json("headings", "array<array<string>>")
    made = F.transform(F.coalesce(pairs, F.array().cast("array<array<string>>")), lambda h: F.struct(h[0].cast("int").alias("level"), h[1].alias("text")))
    return rows.withColumns({"headings": made, "main_text": F.coalesce("main_text", F.lit(""))})


def stored_structures(rows: DataFrame) -> DataFrame:
    """The other way round: ``headings`` as the JSON list of pairs that is stored, null where there are none."""
    def pair(h: Column) -> Column:
        text_ = F.to_json(F.array(h["text"]))
        return F.concat(F.lit("["), h["level"].cast("string"), F.lit(","), F.substring(text_, F.lit(2), F.length(text_) - 2), F.lit("]"))

    listed = F.concat(F.lit("["), F.array_join(F.transform("headings", pair), ","), F.lit("]"))
    return rows.withColumn("headings", F.when(F.size("headings") > 0, listed))


def fetched_pages(rows: DataFrame) -> DataFrame:
    """``rows (.., html)`` with ``title``, ``text`` and ``structure``; a page that cannot be read has an empty text and a
    structure of its title alone."""
    page = free_name("page", rows)
    made = rows.withColumn(page, extract_page("html"))
    return made.withColumns({"text": F.col(page)["text"], "structure": F.col(page)["structure"], "title": F.col(page)["structure"]["meta_title"]}).drop(page)


# --- counters -------------------------------------------------------------------------------------------------------


def decision_tallies(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each decision kind its topics, findings and rival sites, newest first by ``updated_at``, then by id."""
    per = findings.groupBy("decision_id").agg(F.count("*").alias("n"), F.countDistinct("site_id").cast("int").alias("n_sites"))
    rows = decisions.join(per, "decision_id", "left")
    made = rows.select("decision_id", "decision", "updated_at", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("n_sites", F.lit(0)).alias("sites"))
    return made.orderBy(F.desc("updated_at"), "decision_id")


def decision_counts(findings: DataFrame, decisions: DataFrame, kinds: list[str], since=None) -> DataFrame:
    """``decision, topics``: how many topics have each decision, by findings of the given kinds; a topic counts once."""
    rows = findings.filter(F.col("kind").isin(*kinds))
    if since is not None:
        rows = rows.filter(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    met = rows.select("decision_id").distinct()
    return decisions.join(met, "decision_id", "left_semi").groupBy("decision").agg(F.countDistinct("decision_id").alias("topics"))


def to_compare(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Changes that are compared with the own site: those of rivals, as a site is never compared with itself."""
    return changes.join(sites.filter("is_own").select("site_id"), "site_id", "left_anti")


def run_tallies(matched: DataFrame) -> DataFrame:
    """For each run: decisions by kind, cases merged without being asked, and cases that were not compared."""
    return matched.groupBy("run_id").agg(
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("new", "update", "covered")],
        F.count_if("merged").alias("merged"),
        F.count_if(F.col("decision").isNull() & ~F.col("merged")).alias("not_compared"),
    )


def topic_list(findings: DataFrame, decisions: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Each finding with its decision, page and site; inner joins, so that a finding without one of them is out."""
    rows = findings.select("finding_id", "decision_id", "page_id", "kind", "detected_at")
    rows = rows.join(decisions.select("decision_id", "decision", "updated_at"), "decision_id").join(pages.select("page_id", "site_id", "url"), "page_id")
    return rows.join(sites.select("site_id", "name", "is_own"), "site_id")


def site_cards(sites: DataFrame, pages: DataFrame, changes: DataFrame, cache: DataFrame, now, days: int = 30) -> DataFrame:
    """Each site with its active pages, pages fetched by a running crawl, and changes of the last days by type."""
    active = pages.filter("not is_removed").groupBy("site_id").agg(F.count("*").alias("pages"))
    fetched = cache.groupBy("site_id").agg(F.count("*").alias("fetched"))
    recent = changes.filter(F.col("detected_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))).groupBy("site_id")
    counts = recent.agg(*[F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in ("new", "changed", "removed")])
    names = ["pages", "fetched", "n_new", "n_changed", "n_removed"]
    rows = sites.select("site_id", "name", "is_own").join(active, "site_id", "left").join(fetched, "site_id", "left").join(counts, "site_id", "left")
    return rows.na.fill(0, names)


def site_pages(pages: DataFrame, site_id) -> DataFrame:
    """All pages of one site, those seen last first."""
    return pages.filter(F.col("site_id") == F.lit(site_id)).orderBy(F.desc("last_seen_at"), "url")


def merged_results(results: DataFrame, key: str = "run_id") -> DataFrame:
    """The parts of a run as one: counts are summed, and a limit that any part hit was hit.

    ``results (run_id, cards, cards_skipped, calls, merged, not_compared, limit_hit, decisions)``, where ``decisions`` maps
    a kind to its number; the kinds are few.
    """
    counts = ["cards", "cards_skipped", "calls", "merged", "not_compared"]
    sums = results.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts], F.max("limit_hit").alias("limit_hit"))
    each = results.select(key, F.explode("decisions").alias("k", "n")).groupBy(key, "k").agg(F.sum("n").alias("n"))
    kinds = each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("decisions"))
    return sums.join(kinds, key, "left").withColumn("decisions", F.coalesce("decisions", F.create_map().cast("map<string,bigint>")))


def audit_totals(progress: DataFrame) -> DataFrame:
    """One row over ``progress (site_id, articles, done, ready, waiting)``: sums, and whether the queue is empty."""
    made = progress.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("articles", "done", "ready", "waiting")])
    return made.withColumn("finished", F.col("ready") == 0)


def own_counts(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Changes of the own site by type."""
    return changes.join(sites.filter("is_own").select("site_id"), "site_id", "left_semi").groupBy("change_type").agg(F.count("*").alias("n"))


def planned_crawls(sites: DataFrame, next_run) -> DataFrame:
    """``next_crawl_at`` of each site for a new plan: paused ones keep theirs, sites with cookies only have none."""
    at = F.when(F.col("is_paused"), F.col("next_crawl_at")).when(F.col("cookies_only"), None).otherwise(F.lit(next_run).cast("timestamp"))
    return sites.withColumn("next_crawl_at", at)


def cookie_reminder(sites: DataFrame) -> DataFrame:
    """One row: the names of unpaused rivals with cookies only, in order of their ids."""
    rows = sites.filter("cookies_only and not is_paused and not is_own")
    listed = F.array_sort(F.collect_list(F.struct("site_id", "name")))
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["name"]), ", ").alias("names"))


def pick_sites(sites: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Rivals by name, id or any ending of the address; without a wish all that are not paused. A wish that nothing fits
    is an error."""
    rivals = sites.filter("not is_own")
    if not wanted:
        return rivals.filter("not is_paused")
    address = F.regexp_replace("base_url", "/+$", "")
    hit = F.lit(False)
    for w in wanted:
        hit = hit | (F.col("name") == w) | (F.col("site_id").cast("string") == w) | F.endswith(address, F.lit(w))
    found = rivals.filter(hit)
    if found.isEmpty():
        raise ValueError(f"no site fits {', '.join(wanted)}")
    return found


def pilot_sample(pages: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``k`` info pages of each site in an order that depends on the seed alone (a sampling feature)."""
    rows = pages.filter("not is_removed").filter(urls.is_info(F.col("url")))
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy(F.xxhash64("url", F.lit(seed)), "url"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k)


# --- notes and labels -----------------------------------------------------------------------------------------------

#: States of a site and kinds of decisions as they are shown.
STATUS_LABELS = {"active": "работает", "needs_session": "нужна ручная сессия", "paused": "на паузе"}
DECISION_LABELS = {"new": "написать новую статью", "update": "обновить нашу", "covered": "у нас раскрыто"}


def site_labels(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """``site_id, state, next_crawl, progress`` of ``sites``; ``fetched (site_id, n)`` counts the pages of running crawls.

    A crawl that knows its total says how far it is; one without says how many pages it has, or that it looks for them.
    """
    state = F.concat_ws(", ", _choice(F.col("status"), STATUS_LABELS), F.when(F.col("is_paused") & (F.col("status") != "paused"), "пауза"), F.when(F.col("is_crawling"), "⏳ обход идёт"))
    at = F.when(F.col("is_paused"), "на паузе").when(F.col("cookies_only"), "по свежим кукам — пришлите выгрузку из Cookie-Editor").otherwise(text.stamp(F.col("next_crawl_at"), "screen"))
    n = F.coalesce("n", F.lit(0)).cast("string")
    far = F.when(F.coalesce("crawl_pages_total", F.lit(0)) > 0, F.concat(F.lit("обошли "), n, F.lit(" из "), F.col("crawl_pages_total").cast("string"), F.lit(" страниц")))
    far = far.when(n == "0", "ищем страницы в карте сайта").otherwise(F.concat(F.lit("обошли "), n, F.lit(" страниц")))
    return sites.join(fetched, "site_id", "left").select("site_id", state.alias("state"), at.alias("next_crawl"), F.when(F.col("is_crawling"), far).alias("progress"))


def run_note(runs: DataFrame) -> DataFrame:
    """``run_id, backfill, seo``: what a report says of a run, null where there is nothing to say.

    ``runs (run_id, done, attempted, cards, cards_skipped, not_compared, merged, limit_hit, n_new, n_update, n_covered)``.
    """
    c = lambda name: F.col(name).cast("string")
    left = F.col("attempted") - F.col("done")
    some = F.concat(F.lit("Дозаправлен ИИ-разбор для находок без него: "), c("done"), F.lit(" из "), c("attempted"), F.lit(". Остальные "), left.cast("string"), F.lit(" попробуем в следующем обходе."))
    backfill = F.when(F.col("attempted") == 0, None).when(left == 0, F.concat(F.lit("Дозаправлен ИИ-разбор для находок, оставшихся без него раньше: "), c("done"), F.lit("."))).otherwise(some)
    decided = F.concat_ws(", ", *[F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{said} — "), c(f"n_{k}"))) for k, said in DECISION_LABELS.items()])
    waiting = F.col("cards_skipped") + F.col("not_compared")
    seo = F.concat_ws(
        " ",
        F.concat(F.lit("SEO: разобрано инфостатей (интент, подинтенты) — "), c("cards"), F.lit(".")),
        F.when(decided != "", F.concat(F.lit("Решения: "), decided, F.lit("."))),
        F.when(F.col("merged") > 0, F.concat(F.lit("Тех же тем, что уже разобраны (склеены): "), c("merged"), F.lit("."))),
        F.when(waiting > 0, F.concat(F.lit("Не успели — "), waiting.cast("string"), F.lit(", доберём стартовым аудитом или в следующий раз."))),
        F.when(F.col("limit_hit"), "Упёрлись в лимит подписки Claude."),
    )
    return runs.select("run_id", backfill.alias("backfill"), F.when((F.col("cards") + waiting) > 0, seo).alias("seo"))


def pilot_lines(topics: DataFrame, title: str) -> DataFrame:
    """``place, line`` of a pilot's outcome as Markdown: a head with the number of topics, then eight lines for each.

    ``topics (finding_id, url, topic, material_type, main_intent, subintents, decision, our_url, add_subintents, argument,
    cannibal_urls)``; the lists are arrays.
    """
    listed = lambda c, sep, none: F.coalesce(F.nullif(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep), F.lit("")), F.lit(none))
    said = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    lines = F.array(
        F.concat(F.lit("## "), "url"),
        F.concat(F.lit("- Тема: "), "topic", F.lit(" (тип: "), said("material_type", "—"), F.lit(")")),
        F.concat(F.lit("- Основной интент: "), said("main_intent", "")),
        F.concat(F.lit("- Подинтенты: "), listed("subintents", "; ", "")),
        F.concat(F.lit("- Решение: **"), "decision", F.lit("**"), F.coalesce(F.concat(F.lit(" → "), F.nullif("our_url", F.lit(""))), F.lit(""))),
        F.concat(F.lit("- Добавить: "), listed("add_subintents", "; ", "—")),
        F.concat(F.lit("- Аргумент: "), said("argument", "—")),
        F.concat(F.lit("- Каннибализация: "), listed("cannibal_urls", ", ", "нет")),
        F.lit(""),
    )
    body = topics.select("finding_id", F.posexplode(lines).alias("k", "line")).select(F.struct(F.col("finding_id").cast("long").alias("finding_id"), "k").alias("place"), "line")
    count = topics.agg(F.concat(F.lit("Тем: "), F.count("*").cast("string"), F.lit(".")).alias("n"))
    head = count.select(F.posexplode(F.array(F.lit(f"# {title}"), F.lit(""), F.col("n"), F.lit(""))).alias("k", "line"))
    return head.select(F.struct(F.lit(-1).cast("long").alias("finding_id"), "k").alias("place"), "line").unionByName(body)


# --- cookies --------------------------------------------------------------------------------------------------------


def converted_cookies(cookies: DataFrame) -> DataFrame:
    """Exported cookies in a browser's form: ``name, value, domain, path, expires, http_only, secure, same_site``.

    ``expires`` is -1 for cookies of a session and those without a date; an unknown ``sameSite`` is ``Lax``.
    """
    kind = F.lower(F.coalesce("sameSite", F.lit("unspecified")))
    same = F.when(kind == "no_restriction", "None").when(kind == "strict", "Strict").otherwise("Lax")
    lasting = F.col("expirationDate").isNotNull() & ~F.coalesce("session", F.lit(False))
    return cookies.select(
        "name", "value", "domain", F.coalesce("path", F.lit("/")).alias("path"),
        F.when(lasting, F.col("expirationDate").cast("double")).otherwise(-1.0).alias("expires"),
        F.coalesce("httpOnly", F.lit(False)).alias("http_only"), F.coalesce("secure", F.lit(False)).alias("secure"), same.alias("same_site"),
    )


def expired_guards(cookies: DataFrame, now: float, prefix: str = "qrator_jsid") -> DataFrame:
    """Cookies of a site's guard that are out of date: a crawl with them would be refused."""
    rows = cookies.filter(F.startswith(F.lower("name"), F.lit(prefix)) & ~F.coalesce("session", F.lit(False)))
    return rows.filter(F.col("expires") <= now)


def sites_of_cookies(sites: DataFrame, cookies: DataFrame) -> DataFrame:
    """``site_id, domain``: the sites that cookies belong to, where one host is the other's or lies under it.

    Each side's host is expanded to its own endings, so the join is on equal names.
    """

    def endings(host: Column) -> Column:
        parts = F.split(host, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))

    host = F.regexp_replace(F.lower(urls.authority(F.col("base_url"))), r"^.*@|:\d*$", "")  # without user and port
    left = sites.select("site_id", F.regexp_replace(host, r"^www\.", "").alias("host"))
    right = cookies.select(F.lower(F.regexp_replace("domain", r"^\.+", "")).alias("domain")).distinct()
    under = left.select("site_id", F.explode(endings(F.col("host"))).alias("domain")).join(right, "domain")
    over = right.select("domain", F.explode(endings(F.col("domain"))).alias("host")).join(left, "host")
    return under.select("site_id", "domain").unionByName(over.select("site_id", "domain")).distinct()
