"""Tables shaped like those of a site monitor, derived from the driver's tables by SQL that both engines run as it is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sitetide.session import table

_DAY = "CAST('2024-01-' || lpad(CAST(1 + {0} AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP)"
_PAGE = "'https://site' || CAST(doc_id % 4 AS STRING) || '.example/' || CASE WHEN doc_id % 5 = 0 THEN 'blog/' WHEN doc_id % 5 = 1 THEN 'news/' WHEN doc_id % 5 = 2 THEN 'kurs/' ELSE 'spo/' END || CAST(doc_id AS STRING)"

SQL = {
    "sites": f"""
        SELECT CAST(s_suppkey AS BIGINT) AS site_id, s_name AS name, s_suppkey = 0 AS is_own, s_acctbal < 0 AS is_paused,
               s_suppkey % 7 = 3 AS cookies_only, s_suppkey % 11 = 5 AS is_crawling,
               CASE WHEN s_suppkey % 13 = 4 THEN 'needs_session' ELSE 'active' END AS status,
               CASE WHEN s_suppkey % 9 = 2 THEN NULL ELSE {_DAY.format("s_suppkey % 28")} END AS last_crawl_finished_at,
               {_DAY.format("(s_suppkey * 5) % 28")} AS next_crawl_at,
               CASE WHEN s_suppkey % 3 = 1 THEN '/blog' WHEN s_suppkey % 3 = 2 THEN '!/news' ELSE '' END AS include_paths,
               CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE {_DAY.format("(s_suppkey * 3) % 28")} END AS last_full_crawl_at,
               {_DAY.format("(s_suppkey * 7) % 28")} AS created_at,
               CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.site' ELSE 'https://site' END || CAST(s_suppkey AS STRING) || '.example/' AS base_url
        FROM {{supplier}}""",
    "changes": """
        SELECT CAST(event_id AS BIGINT) AS change_id, CAST(user_id % 20 AS BIGINT) AS site_id, CAST(user_id AS BIGINT) AS page_id,
               'https://site' || CAST(user_id % 20 AS STRING) || '.example/' || CASE WHEN event_id % 3 = 0 THEN 'blog/' ELSE 'kurs/' END
                 || CAST(user_id AS STRING) AS url,
               CAST(ts AS TIMESTAMP) AS detected_at,
               CASE WHEN event_type IN ('view', 'signup') THEN 'new' WHEN event_type = 'purchase' THEN 'removed' ELSE 'changed' END AS change_type,
               CASE WHEN event_id % 10 = 9 THEN NULL WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS importance
        FROM {events}""",
    "analysis": """
        SELECT CAST(event_id AS BIGINT) AS change_id, CASE WHEN event_id % 4 = 0 THEN 'Новости школы' ELSE 'Цены' END AS category
        FROM {events} WHERE event_id % 5 <> 0""",
    "answers": """
        SELECT CAST(event_id AS BIGINT) AS change_id,
               'Ответ: {{"category": "' || event_type || '", "importance": "' || CASE WHEN event_id % 5 = 0 THEN 'Высокая' WHEN event_id % 5 = 1 THEN ' low '
                 WHEN event_id % 5 = 2 THEN 'важно' WHEN event_id % 5 = 3 THEN 'other' ELSE 'medium' END || '", "our_url": "'
                 || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://own.example/' || CAST(user_id AS STRING) END || '", "verdict": "'
                 || CASE WHEN event_id % 4 = 0 THEN 'exact' WHEN event_id % 4 = 1 THEN 'None' ELSE 'maybe' END || '"}} конец' AS raw
        FROM {events}""",
    "monitored": f"""
        SELECT doc_id AS page_id, doc_id % 4 AS site_id, {_PAGE} AS url, doc_id % 17 = 0 AS is_removed,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS text_length, doc_id % 3 = 0 AS has_card
        FROM {{documents}}""",
    "findings": f"""
        SELECT doc_id AS finding_id, doc_id AS page_id, doc_id % 60 AS decision_id, doc_id % 4 AS site_id,
               'Site ' || CAST(doc_id % 4 AS STRING) AS site, {_PAGE} AS url, 'Topic ' || CAST(doc_id % 60 AS STRING) AS topic,
               CASE WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 7 = 0 THEN 'audit' ELSE 'new' END AS kind, {_DAY.format("doc_id % 28")} AS detected_at,
               CASE WHEN doc_id % 6 = 0 THEN 'sub ' || CAST(doc_id % 9 AS STRING) || ';own ' || CAST(doc_id % 4 AS STRING) ELSE '' END AS added
        FROM {{labels}}""",
    "decisions": f"""
        SELECT DISTINCT doc_id % 60 AS decision_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'update' ELSE 'covered' END AS decision,
               'Intent ' || CAST(doc_id % 60 AS STRING) AS main_intent, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'статья' END AS material_type,
               CASE WHEN doc_id % 4 = 2 THEN NULL ELSE 'https://own.example/blog/' || CAST(doc_id % 60 AS STRING) END AS our_url,
               CASE WHEN doc_id % 5 = 0 THEN 'a;b;c;d;e;f' WHEN doc_id % 5 = 1 THEN 'a;b' ELSE '' END AS subintents,
               CASE WHEN doc_id % 2 = 0 THEN 'x;y' ELSE '' END AS add_subintents, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Because.' END AS argument,
               CASE WHEN doc_id % 10 = 1 THEN 'https://own.example/1;https://own.example/2' ELSE '' END AS cannibal_urls,
               {_DAY.format("doc_id % 20")} AS updated_at
        FROM {{labels}}""",
    "page_states": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url, {_DAY.format("doc_id % 9")} AS first_seen_at, {_DAY.format("9 + doc_id % 9")} AS last_seen_at,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_DAY.format("doc_id % 23")} END AS last_checked_at, doc_id % 7 = 0 AS is_removed,
               CASE WHEN doc_id % 7 = 0 THEN {_DAY.format("doc_id % 25")} END AS removed_at, CASE WHEN doc_id % 7 = 0 THEN 'deleted' END AS disappearance_reason,
               CASE WHEN doc_id % 14 = 0 THEN 'https://old.example/' || CAST(doc_id AS STRING) END AS redirect_to_url,
               CASE WHEN doc_id % 14 = 0 THEN 'Old summary' END AS redirect_target_summary,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_DAY.format("doc_id % 11")} END AS sitemap_lastmod
        FROM {{documents}} WHERE doc_id % 6 <> 4""",
    "structures": """
        SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'Heading ' || lang END AS h1,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Meta ' || lang END AS meta_title, 'Part one;Part ' || lang AS heading_texts,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'Plain text of an article about ' || lang || ' schools and their teachers' END AS main_text
        FROM {documents} WHERE doc_id % 3 <> 1""",
    "cards": """
        SELECT doc_id AS page_id, 'Topic ' || lang AS topic, 'Intent ' || lang AS main_intent, 'first second' AS subintents, 'school' AS entities
        FROM {documents} WHERE doc_id % 2 = 0""",
    "texts": f"""
        SELECT doc_id AS page_id, doc_id AS snapshot_id, {_DAY.format("doc_id % 5")} AS taken_at, 'Old text ' || lang AS text FROM {{documents}} WHERE doc_id % 8 <> 3
        UNION ALL
        SELECT doc_id AS page_id, doc_id + 1000000 AS snapshot_id, {_DAY.format("10 + doc_id % 5")} AS taken_at, 'New text ' || lang AS text FROM {{documents}} WHERE doc_id % 8 < 3""",
    "compared": """
        SELECT CAST(event_id AS BIGINT) AS change_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN 'exact' ELSE 'similar' END AS verdict,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://own.example/' || CAST(user_id AS STRING) END AS our_url,
               CASE WHEN event_id % 4 = 0 THEN 'Longer course' END AS differences, CASE WHEN event_id % 5 = 0 THEN 'A free lesson' END AS missing
        FROM {events} WHERE event_id % 2 = 0""",
    "run_findings": """
        SELECT CAST(event_id AS BIGINT) AS ord, CAST(user_id % 20 AS BIGINT) AS site_id, CAST(ts AS TIMESTAMP) AS detected_at,
               'https://site' || CAST(user_id % 20 AS STRING) || '.example/' || CASE WHEN event_id % 3 = 0 THEN 'blog/' ELSE 'kurs/' END || CAST(event_id AS STRING) AS url,
               CASE WHEN event_type IN ('view', 'signup') THEN 'new' WHEN event_type = 'purchase' THEN 'removed' ELSE 'changed' END AS change_type,
               CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'https://moved.example/' || CAST(event_id AS STRING) END AS moved_to,
               CASE WHEN event_id % 14 = 0 THEN 'Now a list' END AS moved_summary,
               CASE WHEN event_id % 13 = 0 THEN 3 + event_id % 5 END AS sitewide_pages,
               CASE WHEN event_id % 26 = 0 THEN 'https://ad.example/' || CAST(event_id AS STRING) WHEN event_id % 13 = 0 THEN 'nowhere' END AS related_url,
               CASE WHEN event_id % 10 = 9 THEN NULL WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS importance,
               CASE WHEN event_id % 4 = 0 THEN 'Новости школы' WHEN event_id % 4 = 1 THEN NULL ELSE 'Цены' END AS category,
               CASE WHEN event_id % 3 = 0 THEN 'Free' END AS usp, CASE WHEN event_id % 3 = 1 THEN 'Call' END AS cta,
               'Sum  of ' || event_type AS summary, CASE WHEN event_id % 2 = 0 THEN 'Reason ' || event_type ELSE '' END AS importance_reason
        FROM {events}""",
    "cookies": """
        SELECT CASE WHEN c_custkey % 3 = 0 THEN 'qrator_jsid' ELSE 'sid' END || CAST(c_custkey % 2 AS STRING) AS name,
               CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE 'a.' END || 'Site' || CAST(c_custkey % 7 AS STRING) || '.example' AS domain,
               c_custkey % 5 = 0 AS session, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1.0 * c_custkey END AS expires
        FROM {customer}""",
    "crawl_prev": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url, CASE WHEN doc_id % 10 = 3 THEN text || chr(10) || '4100' ELSE text END AS text
        FROM {{documents}} WHERE doc_id % 10 <> 7""",
    "crawl_cur": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url,
               CASE WHEN doc_id % 10 = 2 THEN text || ' rewritten' || chr(10) || 'New block for all' || chr(10) || 'Price from ' || CAST(doc_id AS STRING)
                      || chr(10) || 'Order today please'
                    WHEN doc_id % 10 = 3 THEN text || chr(10) || '5313' ELSE text END AS text
        FROM {{documents}} WHERE doc_id % 10 <> 1""",
    "entries": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE {_DAY.format("(doc_id * 3) % 28")} END AS lastmod
        FROM {{documents}} WHERE doc_id % 5 <> 1 OR doc_id % 4 = 3""",
    "previous_pages": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url, text, CASE WHEN doc_id % 9 = 7 THEN NULL ELSE {_DAY.format("(doc_id * 2) % 28")} END AS lastmod
        FROM {{documents}} WHERE doc_id % 8 <> 0""",
    "responses": f"""
        SELECT doc_id % 4 AS site_id, {_PAGE} AS url,
               CASE WHEN doc_id % 6 = 0 THEN 404 WHEN doc_id % 6 = 1 THEN 503 WHEN doc_id % 12 = 5 THEN NULL ELSE 200 END AS status,
               CASE WHEN doc_id % 6 = 2 THEN 'http://www.site' || CAST(doc_id % 4 AS STRING) || '.example/moved/' || CAST(doc_id AS STRING)
                    WHEN doc_id % 6 = 3 THEN replace({_PAGE}, 'https://', 'http://www.') || '/' ELSE {_PAGE} END AS final_url,
               '<p>' || text || '</p>' AS body
        FROM {{documents}}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a driver table of that name."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    base = {n: table(spark, sf_dir, n) for n in _NAME.findall(SQL[name])}
    return spark.sql(SQL[name], **base)


def duck(body: str, *names: str) -> str:
    """``body`` for DuckDB with the stand-ins that it names."""
    parts = [f"{n} AS ({_NAME.sub(r'\1', SQL[n]).replace('{{', '{').replace('}}', '}')})" for n in names]
    return f"WITH {', '.join(parts)} {body}" if parts else body
