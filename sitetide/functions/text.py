"""Text, number, date and JSON expressions of the marts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = """
без более больше будет будто был была были было быть вам вас ваш ваша ваши вдруг ведь весь вот все
всего всех всю вы где да даже для до его ему если есть ещё еще же за здесь или им их как какой когда
кто ли лучше между меня мне много может можно мой мы на над надо наш наша наши не него неё нее нет
ни них но ну об однако он она они оно от очень перед по под после потом потому почти при про раз
разве сам свой своя себе себя сейчас скидка так такой там те тем теперь то тоже только том тот три
тут ты уже хоть чего чем через что чтобы эти этой этом этот эту явно
"""
ENDINGS = """
ами ями ого его ому ему ыми ими ость ация ение ания ая яя ое ее ые ие ый ий ой ей ам ям ах ях ов ев ию ия ии ем ом
ут ют ат ят ла ло ли а я о е у ю ы и ь й
"""
MIN_STEM = 4
TITLE_WEIGHT = 3
IMPORTANCE = {
    "high": "high", "высокая": "high", "важно": "high", "medium": "medium", "средняя": "medium", "средне": "medium",
    "low": "low", "низкая": "low", "мелочь": "low",
}
BLOCKED_STATUS = (401, 403, 429, 503)
CHALLENGE_MARKERS = (
    "checking your browser", "just a moment", "attention required! | cloudflare", "cf-browser-verification", "cf_chl_opt",
    "please enable cookies", "verify you are human", "unusual traffic", "доступ ограничен", "подтвердите, что вы не робот",
)
CHALLENGE_MAX = 20_000
DIGITS = "[0-9][0-9  ]*"

#: The longest ending that leaves at least four letters; the lazy head makes the alternation prefer it.
STEM = "^(.{%d,}?)(?:%s)$" % (MIN_STEM, "|".join(sorted(ENDINGS.split(), key=len, reverse=True)))


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


def clip(x: Column, limit: int) -> Column:
    """At most ``limit`` characters of the collapsed text, the last of them an ellipsis where it was cut."""
    text = collapse(F.coalesce(x, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def clip_hard(x: Column, limit: int) -> Column:
    """Like ``clip``, but a blank before the ellipsis stays."""
    text = collapse(F.coalesce(x, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def utf16_length(x: Column) -> Column:
    """Code units of a text, by which documents count places: characters beyond the first 65,536 are two."""
    return F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))


def cut_lines(x: Column, limit: int) -> Column:
    """A message of at most ``limit`` characters that ends with a whole line where it has one."""
    head = F.substring(x, 1, limit)
    whole = F.regexp_replace(head, r"\n[^\n]*$", "")
    return F.when(F.length(x) <= limit, x).otherwise(whole)


def mask_digits(x: Column) -> Column:
    return F.regexp_replace(x, DIGITS, "#")


def letters(x: Column) -> Column:
    """How many Latin or Cyrillic letters a text has."""
    return F.length(F.regexp_replace(x, "(?iu)[^a-zа-яё]", ""))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def stem(word: Column) -> Column:
    """The word without its ending; all endings are Cyrillic, so other words are not searched for one."""
    return F.when(word.rlike("[а-я]$"), F.regexp_replace(word, STEM, "$1")).otherwise(word)


def tokens(x: Column) -> Column:
    """Lower-case words of more than two letters that are not stop words, by their stems."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit("([а-яёa-z0-9]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS.split()))
    return F.transform(kept, stem)


def importance(x: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in IMPORTANCE.items() for v in kv]), F.lower(collapse(x)))


def importance_rank(x: Column) -> Column:
    """0 high, 1 medium or unknown, 2 low."""
    return F.when(x == "high", 0).when(x == "low", 2).otherwise(1)


def page_title(html: Column) -> Column:
    """What stands in the first title of a page as it is loaded, without blanks at its ends; null without a title."""
    title = r"(?is)<title[^>]*>(.*?)</title>"
    return F.when(html.rlike(title), F.regexp_replace(F.regexp_extract(html, title, 1), r"(?U)^\s+|\s+$", ""))


def blocked_reason(status: Column, html: Column) -> Column:
    """``HTTP n``, the first marker of a challenge page, or null; long pages are real."""
    low, found = F.lower(html), F.lit(None).cast("string")
    for marker in reversed(CHALLENGE_MARKERS):
        found = F.when(F.contains(low, F.lit(marker)), F.lit(marker)).otherwise(found)
    return (
        F.when(status.isin(*BLOCKED_STATUS), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(F.length(html) > CHALLENGE_MAX, F.lit(None).cast("string"))
        .otherwise(found)
    )


def is_blocked(status: Column, html: Column) -> Column:
    return blocked_reason(status, html).isNotNull()


def union_ci(first: Column, second: Column) -> Column:
    """``first`` and what of ``second`` it lacks, whatever the case; repeats inside ``second`` stay."""
    first = F.coalesce(first, F.array().cast("array<string>"))
    known = F.transform(first, F.lower)
    return F.concat(first, F.filter(F.coalesce(second, F.array().cast("array<string>")), lambda x: ~F.array_contains(known, F.lower(x))))


def unique(items: Column) -> Column:
    """In order, once each, without nulls and empty texts."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def page_number(raw: Column) -> Column:
    """A page number typed by a user; anything that is not a positive whole number is 1."""
    return F.greatest(F.coalesce(F.expr("try_cast(null as int)") if raw is None else raw.try_cast("int"), F.lit(1)), F.lit(1))


def clamp_page(page: Column, total: Column, size: int) -> Column:
    return F.least(F.greatest(page, F.lit(1)), F.greatest(F.ceil(total / size), F.lit(1))).cast("int")


# --- dates ------------------------------------------------------------------------------------------------------

ZONE = "Europe/Moscow"


def parse_lastmod(raw: Column) -> Column:
    """An ISO-8601 date or time, extended or basic; without a zone it is UTC; anything else is null."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    text = F.regexp_replace(text, r"T(\d{2})(\d{2})(\d{2})?(?=$|Z|[+-])", "T$1:$2:$3")
    text = F.regexp_replace(text, r"(T\d{2}:\d{2}):(?=$|Z|[+-])", "$1")
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def week_start(ts: Column, zone: str = ZONE) -> Column:
    """Monday of the local week, as a date."""
    return F.date_trunc("WEEK", F.from_utc_timestamp(ts, zone)).cast("date")


def week_title(ts: Column, zone: str = ZONE) -> Column:
    start = week_start(ts, zone)
    return F.concat(F.lit("Неделя "), F.date_format(start, "dd.MM"), F.lit("–"), F.date_format(F.date_add(start, 6), "dd.MM.yyyy"))


#: How times are written on screens, in reports and in sheets.
STAMPS = {"screen": "dd.MM.yyyy HH:mm", "report": "yyyy-MM-dd\nHH:mm", "sheet": "dd.MM.yyyy"}


def stamp(ts: Column, form: str, zone: str = ZONE, empty: str = "—") -> Column:
    """A local time in one of the forms of ``STAMPS``."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), STAMPS[form]), F.lit(empty))


def interval_label(days: Column, hours: Column) -> Column:
    """How often a crawl runs; parts of zero are left out."""
    parts = F.concat_ws(" ", F.when(days != 0, F.concat(days.cast("string"), F.lit(" дн."))), F.when(hours != 0, F.concat(hours.cast("string"), F.lit(" ч"))))
    return F.when(parts == "", "не задано").otherwise(F.concat(F.lit("каждые "), parts))


def in_night_window(ts: Column, start: int, end: int, zone: str = ZONE) -> Column:
    """Whether the local hour lies in ``[start, end)``, which may pass midnight."""
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def is_overdue(saved: Column, now: Column, reset: Column | None = None, grace_minutes: int = 2) -> Column:
    """Whether a saved run has passed, or is due within two minutes, and was not reset."""
    due = F.coalesce(saved <= now + F.make_dt_interval(mins=F.lit(grace_minutes)), F.lit(False))
    return due & ~F.coalesce(reset, F.lit(False)) if reset is not None else due


def next_run(saved: Column, now: Column, hour: int = 3, zone: str = ZONE, grace_minutes: int = 2, reset: Column | None = None) -> Column:
    """An overdue run starts in two minutes; else the next Sunday's is planned, this very moment included."""
    local = F.from_utc_timestamp(now, zone)
    sunday = F.next_day(F.date_sub(local.cast("date"), 1), "Sunday").cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))
    sunday = F.when(sunday < local, sunday + F.make_dt_interval(days=F.lit(7))).otherwise(sunday)
    planned = F.to_utc_timestamp(sunday, zone)
    return F.when(is_overdue(saved, now, reset, grace_minutes), now + F.make_dt_interval(mins=F.lit(grace_minutes))).otherwise(planned)
