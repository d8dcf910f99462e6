"""Answers of an annotator, taken apart and validated in the JVM: a JSON object somewhere inside a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import clip, importance

# Fixed values.
VERDICTS = ("exact", "similar", "none")
DECISIONS = ("new", "update", "covered")
COVERAGES = ("none", "partial", "full")
MATERIAL_OTHER = "другое"
MATERIAL_TYPES = ("статья", "чек-лист", "советы", "тест", "новость", "глоссарий", "вопрос-ответ", "видеоурок", "подборка", "другое")
MAX_SUBINTENTS, MAX_ENTITIES, MAX_RELATIONS, MAX_ADDED = 12, 15, 15, 10
CARD_MAX, ARGUMENT_MAX, RELATION_MAX, ADDED_MAX = 300, 400, 100, 150


def json_object(raw: Column) -> Column:
    """From the first brace to the last one; null where there are none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


_OBJECT = "_object"


def _parsed(rows: DataFrame, raw: str, *names: str) -> DataFrame:
    """``rows`` with the object of an answer parsed once: behind an explode, through which the optimizer copies nothing."""
    fields = F.from_json(json_object(F.col(raw)), ", ".join(f"{n} string" for n in names))
    return rows.withColumn(_OBJECT, F.explode(F.array(fields)))


def _field(name: str) -> Column:
    """A field of the object, null where it is missing or empty."""
    return F.nullif(F.col(f"{_OBJECT}.{name}"), F.lit(""))


def with_analysis(rows: DataFrame, raw: str = "raw", name: str = "analysis") -> DataFrame:
    """Category, offer, call to action, summary and importance of a change; null without an object."""
    names = ("category", "usp", "cta", "summary", "importance_reason")
    made = F.struct(*[_field(n).alias(n) for n in names], importance(_field("importance")).alias("importance"))
    parsed = _parsed(rows, raw, *names, "importance")
    return parsed.withColumn(name, F.when(F.col(_OBJECT).isNotNull(), made)).drop(_OBJECT)


def with_comparison(rows: DataFrame, raw: str = "raw", name: str = "comparison") -> DataFrame:
    """Verdict and page of a comparison with the own site; an unknown verdict follows from whether a page is named."""
    field = _field
    url, verdict = field("our_url"), F.lower(F.trim(field("verdict")))
    known = F.when(verdict.isin(*VERDICTS), verdict).when(url.isNotNull(), "similar").otherwise("none")
    found = F.struct(known.alias("verdict"), url.alias("our_url"), field("differences").alias("differences"), field("missing").alias("missing"))
    parsed = _parsed(rows, raw, "our_url", "verdict", "differences", "missing")
    return parsed.withColumn(name, F.when(F.col(_OBJECT).isNotNull(), found)).drop(_OBJECT)


_CARDS = (
    "struct<cards:array<struct<n:string,topic:string,main_intent:string,subintents:array<string>,entities:array<string>,"
    "relations:array<array<string>>,material_type:string,added_subintents:array<string>>>>"
)
_MATCHES = (
    "struct<results:array<struct<n:string,decision:string,our_url:string,coverage:string,add_subintents:array<string>,"
    "argument:string,cannibalization_urls:array<string>>>>"
)


def _numbered(raw: Column, schema: str, field: str) -> Column:
    return F.from_json(json_object(raw), schema)[field]


def _texts(items: Column, most: int, limit: int) -> Column:
    kept = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.coalesce(F.slice(F.transform(kept, lambda x: clip(x, limit)), 1, most), F.array().cast("array<string>"))


def material_type(x: Column) -> Column:
    low, kind = F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit(MATERIAL_OTHER)
    for name in reversed(MATERIAL_TYPES):
        kind = F.when(F.startswith(low, F.lit(name)), F.lit(name)).otherwise(kind)
    return kind


def intent_cards(answers: DataFrame) -> DataFrame:
    """``batch_id, n`` and the card of each article of a batch ``(batch_id, size, raw)``; the last answer for one counts."""
    each = answers.select("batch_id", "size", F.posexplode(_numbered(F.col("raw"), _CARDS, "cards")).alias("pos", "c"))
    topic, intent = F.nullif(clip(F.col("c.topic"), CARD_MAX), F.lit("")), F.nullif(clip(F.col("c.main_intent"), CARD_MAX), F.lit(""))
    rows = each.withColumn("n", F.col("c.n").try_cast("int")).filter((F.col("n") >= 1) & (F.col("n") <= F.col("size")))
    relations = F.filter(F.col("c.relations"), lambda r: (F.size(r) == 3) & F.forall(r, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""))
    relations = F.transform(relations, lambda r: F.transform(r, lambda p: clip(p, RELATION_MAX)))
    card = rows.select(
        "batch_id",
        "n",
        "pos",
        F.coalesce(topic, intent).alias("topic"),
        F.coalesce(intent, topic).alias("main_intent"),
        _texts(F.col("c.subintents"), MAX_SUBINTENTS, CARD_MAX).alias("subintents"),
        _texts(F.col("c.entities"), MAX_ENTITIES, CARD_MAX).alias("entities"),
        F.coalesce(F.slice(relations, 1, MAX_RELATIONS), F.array().cast("array<array<string>>")).alias("relations"),
        material_type(F.col("c.material_type")).alias("material_type"),
        _texts(F.col("c.added_subintents"), MAX_SUBINTENTS, CARD_MAX).alias("added_subintents"),
    ).filter("topic is not null")
    names = [c for c in card.columns if c not in ("batch_id", "n", "pos")]
    last = card.groupBy("batch_id", "n").agg(F.max_by(F.struct(*names), "pos").alias("c"))
    return last.select("batch_id", "n", "c.*")


def match_results(answers: DataFrame) -> DataFrame:
    """``batch_id, n`` and the decision for each article of ``(batch_id, candidates, raw)``.

    ``candidates`` has the own addresses offered for each article. An answer may only name those; one that needs a page
    and names none becomes ``new``.
    """
    each = answers.select("batch_id", "candidates", F.posexplode(_numbered(F.col("raw"), _MATCHES, "results")).alias("pos", "r"))
    rows = each.withColumn("n", F.col("r.n").try_cast("int")).filter((F.col("n") >= 1) & (F.col("n") <= F.size("candidates")))
    rows = rows.withColumn("allowed", F.element_at("candidates", F.col("n"))).withColumn("said", F.lower(F.trim("r.decision"))).filter(F.col("said").isin(*DECISIONS))
    url = F.trim("r.our_url")
    rows = rows.withColumn("our_url", F.when(F.array_contains("allowed", url), url))
    rows = rows.withColumn("decision", F.when(F.col("our_url").isNull(), "new").otherwise(F.col("said")))
    given = F.lower(F.trim("r.coverage"))
    default = F.when(F.col("decision") == "new", "none").when(F.col("decision") == "update", "partial").otherwise("full")
    made = rows.select(
        "batch_id",
        "n",
        "pos",
        "decision",
        "our_url",
        F.when(F.col("decision") == "new", "none").when(given.isin(*COVERAGES), given).otherwise(default).alias("coverage"),
        _texts(F.col("r.add_subintents"), MAX_ADDED, ADDED_MAX).alias("add_subintents"),
        F.nullif(clip(F.col("r.argument"), ARGUMENT_MAX), F.lit("")).alias("argument"),
        F.coalesce(
            F.filter(F.transform("r.cannibalization_urls", lambda u: F.trim(u)), lambda u: F.array_contains("allowed", u)), F.array().cast("array<string>")
        ).alias("cannibal_urls"),
    )
    names = [c for c in made.columns if c not in ("batch_id", "n", "pos")]
    return made.groupBy("batch_id", "n").agg(F.max_by(F.struct(*names), "pos").alias("m")).select("batch_id", "n", "m.*")
