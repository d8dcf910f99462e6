"""Texts of bounded size put together from rows: lists cut at a budget of characters, what an annotator is asked, report
introductions, context of recent findings, and answers checked against rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.parsers import json_object
from sitetide.functions.text import clip

# Limits in characters and lines.
CONTENT_LIMIT = 8000
COMPARE_LIMIT = 3000
INDEX_LIMIT = 1200
CONTEXT_LINES = 40
OWN_LINES = 15
LINE_LIMIT = 300
LISTED = 5
# Actions that an answer may name, and the arguments that each must have.
ACTIONS = {
    "crawl": ["competitor_id"], "stop": ["competitor_id"], "pause": ["competitor_id"], "resume": ["competitor_id"], "delete_competitor": ["competitor_id"],
    "crawl_all": [], "crawl_own": [], "add_competitor": ["name", "url"], "set_schedule": ["days", "hours"], "show": ["section"],
}


def fitted(rows: DataFrame, group: list[str], order: list[str], text: str, budget: int, most: int | None = None, separator: str = "\n", more: str = "…и ещё {}") -> DataFrame:
    """``group, text, shown, left``: the first texts of each group, in order, that fit into ``budget`` characters together
    with the separators between them; the last one is whole. Where some are left a line ``more`` with their number follows,
    which does not count. Null texts count as empty.

    Each text takes a character at least, so no more than ``budget`` of a group can fit: all tasks cut theirs by rank
    before any group is brought together, and the sums run over what is left.
    """
    line = F.coalesce(F.col(text), F.lit(""))
    least = min(budget + 1, most) if most is not None else budget + 1
    own = Window.partitionBy(*group).orderBy(*order)
    totals = rows.groupBy(*group).agg(F.count("*").alias("_total"))
    first = rows.select(*group, *[c for c in order if c not in group], line.alias("_line")).withColumn("_nth", F.row_number().over(own)).filter(F.col("_nth") <= least)
    ends = F.sum(F.length("_line") + len(separator)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(separator)
    kept = first.withColumn("_end", ends).filter(F.col("_end") <= budget)
    made = kept.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_nth", "_line"))).alias("_lines"))  # at most ``budget`` characters
    out = totals.join(made, group, "left")
    shown = F.coalesce(F.size("_lines"), F.lit(0))
    body = F.array_join(F.transform(F.coalesce("_lines", F.array().cast("array<struct<_nth:int,_line:string>>")), lambda x: x["_line"]), separator)
    rest = F.col("_total") - shown
    head, _, tail = more.partition("{}")
    last = F.when(rest > 0, F.concat(F.when(shown > 0, separator).otherwise(""), F.lit(head), rest.cast("string"), F.lit(tail))).otherwise("")
    return out.select(*group, F.concat(body, last).alias("text"), shown.cast("long").alias("shown"), rest.cast("long").alias("left"))


def with_own_part(diffs: DataFrame, own: DataFrame) -> DataFrame:
    """``diffs`` with ``own_diff_text``: of a page with shared lines only what changed on itself is looked at."""
    return diffs.join(own.select("site_id", "url", F.col("own_text").alias("own_diff_text")), ["site_id", "url"], "left")


def asked_content(diffs: DataFrame, limit: int = CONTENT_LIMIT) -> DataFrame:
    """``site_id, url, about, content`` of what an annotator is shown of each change, ``limit`` characters at most.

    ``about``: ``new`` and ``removed`` pages show their text, changed ones their ``own`` part where there is one, else the
    whole ``diff``.
    """
    kind = F.col("change_type")
    about = F.when(kind.isin("new", "removed"), kind).when(F.col("own_diff_text").isNotNull(), "own").otherwise("diff")
    content = F.when(kind == "new", F.col("new_text")).when(kind == "removed", F.col("old_text")).otherwise(F.coalesce("own_diff_text", "diff_text"))
    return diffs.select("site_id", "url", about.alias("about"), F.substring(F.coalesce(content, F.lit("")), 1, limit).alias("content"))


def candidate_blocks(pairs: DataFrame, limit: int = COMPARE_LIMIT) -> DataFrame:
    """``case_id, n, text``: the pages that a case is compared with, one block each in order of ``nth``, texts clipped.

    ``pairs (case_id, nth, url, title, text)`` has the best few of each case.
    """
    block = F.concat(F.lit("--- "), F.col("nth").cast("string"), F.lit(" ---\n"), "url", F.lit("\n"), F.coalesce(F.nullif("title", F.lit("")), F.lit("не указан")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, limit))
    listed = F.array_sort(F.collect_list(F.struct("nth", block.alias("b"))))  # the best few
    made = pairs.groupBy("case_id").agg(listed.alias("x"))
    return made.select("case_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda b: b["b"]), "\n\n").alias("text"))


def context_lines(changes: DataFrame, now, days: int = 30, most: int = CONTEXT_LINES, own_most: int = OWN_LINES, limit: int = LINE_LIMIT, budget: int = CONTENT_LIMIT) -> DataFrame:
    """``part, text, shown, left``: the latest findings of rivals, and of the own site, of the last days as clipped lines.

    ``changes (change_id, is_own, detected_at, site, url, change_type, summary)``. Each part has a cap of lines and the
    budget of characters, and says how many it leaves out.
    """
    rows = changes.filter(F.col("detected_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    said = F.concat_ws(" | ", F.when(~F.col("is_own"), F.col("site")), "change_type", "url", clip(F.col("summary"), limit))
    rows = rows.select(F.when(F.col("is_own"), "own").otherwise("rivals").alias("part"), (-F.unix_micros("detected_at")).alias("newest"), "change_id", said.alias("line"))
    own = fitted(rows.filter("part = 'own'"), ["part"], ["newest", "change_id"], "line", budget, own_most)
    return own.unionByName(fitted(rows.filter("part = 'rivals'"), ["part"], ["newest", "change_id"], "line", budget, most))


def intro_paragraphs(reports: DataFrame, lists: DataFrame, notes: DataFrame, titles: dict[str, str]) -> DataFrame:
    """``site_id, place, style, text``: what stands before the table of each report.

    ``reports (site_id, heading, overview, counts)``; ``lists (site_id, list, nth, line, url, total)``, already cut, one
    block for each list of ``titles`` in turn, with the number of those left out; ``notes (site_id, nth, note)``. A site
    with notes only has these.
    """
    head = [("h1", F.col("heading"), 0), ("normal", F.concat(F.lit("Главное: "), F.nullif("overview", F.lit(""))), 1), ("normal", F.col("counts"), 2), ("h1", F.lit("Подробности"), 900)]
    parts = [reports.select("site_id", F.lit(at).alias("a"), F.lit(0).alias("b"), F.lit(style).alias("style"), text.alias("text")) for style, text, at in head]
    for number, (name, title) in enumerate(titles.items()):
        own, at = lists.filter(F.col("list") == name), 10 + 3 * number
        ends = own.groupBy("site_id").agg(F.max("total").alias("total"), F.count("*").alias("n"))
        bullet = F.when(F.coalesce("line", F.lit("")) != "", F.concat(F.lit("• "), "line", F.lit(" — "), "url")).otherwise(F.concat(F.lit("• "), "url"))
        parts += [
            ends.select("site_id", F.lit(at).alias("a"), F.lit(0).alias("b"), F.lit("h2").alias("style"), F.lit(title).alias("text")),
            own.select("site_id", F.lit(at + 1).alias("a"), F.col("nth").alias("b"), F.lit("normal").alias("style"), bullet.alias("text")),
            ends.filter("total > n").select("site_id", F.lit(at + 2).alias("a"), F.lit(0).alias("b"), F.lit("normal").alias("style"), F.concat(F.lit("…и ещё "), (F.col("total") - F.col("n")).cast("string"), F.lit(" — в таблице ниже.")).alias("text")),
        ]
    parts.append(notes.select("site_id", F.lit(901).alias("a"), F.col("nth").alias("b"), F.lit("normal").alias("style"), F.col("note").alias("text")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("a", "b"))  # a few lines for each report
    return rows.filter("text is not null").select("site_id", place.alias("place"), "style", "text")


def rules(spark, actions: dict[str, list[str]] = ACTIONS) -> DataFrame:
    """``action, required``: the table that answers are checked against."""
    return spark.createDataFrame(list(actions.items()), "action string, required array<string>")


def checked_replies(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """``answer_id, reply, action, args, verdict`` of ``answers (answer_id, raw)``.

    The answer's object is read as a variant. Its action is ``accepted`` if the table has it and every required argument
    is there and not null; otherwise it is dropped: ``unknown`` or ``incomplete``. ``none`` names no action, ``empty`` says
    nothing at all, ``unreadable`` has no object. Arguments are given as JSON, without the type.
    """
    rows = answers.select("answer_id", F.try_parse_json(json_object(F.col("raw"))).alias("v"))
    rows = rows.withColumn("o", F.expr("try_cast(v as map<string,variant>)"))
    act = F.col("o")["action"]
    rows = rows.select("answer_id", "o", F.trim(F.expr("try_variant_get(o['reply'], '$', 'string')")).alias("reply"), F.expr("try_cast(o['action'] as map<string,variant>)").alias("a"), (act.isNotNull() & ~F.is_variant_null(act)).alias("named"))
    rows = rows.withColumn("action", F.when(F.expr("schema_of_variant(a['type'])") == "STRING", F.expr("try_variant_get(a['type'], '$', 'string')")))
    rows = rows.join(F.broadcast(allowed), "action", "left")  # the rules: a row for each action
    has = F.forall("required", lambda r: F.col("a")[r].isNotNull() & ~F.is_variant_null(F.col("a")[r]))
    ok = F.coalesce(F.col("required").isNotNull() & has, F.lit(False))
    reply = F.coalesce("reply", F.lit(""))
    verdict = (
        F.when(F.col("o").isNull(), "unreadable").when(ok, "accepted").when(reply == "", "empty")
        .when(~F.col("named") | F.col("a").isNull(), "none").when(F.col("required").isNull(), "unknown").otherwise("incomplete")
    )
    given = F.filter(F.map_entries("a"), lambda e: e["key"] != "type")
    said = F.transform(given, lambda e: F.concat(F.lit('"'), F.regexp_replace(e["key"], r'(["\\\\])', r"\\\\$1"), F.lit('":'), F.to_json(e["value"])))
    args = F.when(ok, F.concat(F.lit("{"), F.array_join(F.array_sort(said), ","), F.lit("}")))
    return rows.select("answer_id", F.nullif(reply, F.lit("")).alias("reply"), F.when(ok, F.col("action")).alias("action"), args.alias("args"), verdict.alias("verdict"))
