"""URL parts, clean-up and path rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PREFIXES = ("utm_", "_gl", "_ga", "gclid", "yclid", "fbclid", "_openstat")
FILE_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp4", ".mp3",
)
RIVAL_EXCLUSIONS = ("!*college*", "!*kolledzh*", "!*kolledj*", "!*koledzh*", "!*tehnikum*", "!/spo", "!/spo-*")
INFO_PATH = (
    r"/(?:articles?|blog|news|novosti[\w-]*|media|journal|zhurnal|wiki|polza|poleznoe|videouroki|questions?|"
    r"voprosy|glossary|slovar\w*|terminy|encyclopedia|enciklopediya|spravochnik|stat[iy]a?|stati|"
    r"sovety|chek-?listy?|checklists?|baza-znanij|knowledge|faq|testy?|quiz)(?:/|$)"
)
INFO_CATEGORY = r"стать|новост|чек-?лист|тест|совет|блог|вопрос"
BASELINE_SKIP_PATH = (
    r"/(articles?|blog|news|novosti|media|questions?|voprosy|polza|stat[iy]a?|wiki|tags?|"
    r"category|author|page|search|faq|oferta[^/]*|polic[yi][^/]*|politika[^/]*|soglasie[^/]*|"
    r"privacy[^/]*|documents?|dokumenty|svedeniya[^/]*|vakansii|jobs?|login|lk|account)(/|$)"
)
BASELINE_SKIP_SLUG = r"variant|zadani|otvet|reshebnik|gdz|konspekt|urok-\d"
BASELINE_KEY_PATH = (
    r"kurs|course|price|cen[ay]|stoimost|tarif|shkol|school|klass|class|program|ege|oge|"
    r"repetitor|tutor|podgotovk|obuchen|napravlen|predmet|homeschool|semejn|eksternat"
)
BLOCKED_TYPES = ("image", "media", "font")
TRACKER_PARTS = (
    "mc.yandex.", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "googleadservices.com",
    "top-fwz1.mail.ru", "vk.com/rtrg", "connect.facebook.net", "facebook.com/tr", "jivosite.com", "jivo.ru",
    "carrotquest.", "roistat.com", "calltouch.ru", "callibri.ru", "comagic.ru", "uiscom.ru", "hotjar.com", "clarity.ms",
)

#: Scheme, authority, path and query of any string; the same pattern runs in DuckDB.
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def domain(url: Column) -> Column:
    """The authority without a leading ``www.``"""
    return F.regexp_replace(authority(url), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return authority(a) == authority(b)


def normalize_url(url: Column) -> Column:
    """Without fragment and closing slashes, unless nothing else is left."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "/+$", ""), F.lit("")), bare)


def section(url: Column) -> Column:
    """``/`` and the first segment of the path."""
    return F.concat(F.lit("/"), F.regexp_extract(path(url), r"^/*([^/]*)", 1))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_tracking(url: Column) -> Column:
    """Drop advertising parameters of the query and encode the others anew; a URL without a query stays as it is."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, r"^[^=]*=?([\s\S]*)$", 1)).alias("v")
        ),
    )

    def wanted(p: Column) -> Column:
        low, hit = F.lower(p["k"]), F.lit(False)
        for prefix in TRACKING_PREFIXES:
            hit = hit | F.startswith(low, F.lit(prefix))
        return ~hit

    kept = F.array_join(F.transform(F.filter(keyed, wanted), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    before, after = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#[\s\S]*)$", 1)
    made = F.concat(before, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), after)
    return F.when(query(url) == "", url).otherwise(made)


def is_file(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:" + "|".join(e[1:] for e in FILE_EXTENSIONS) + r")$")


def identity(url: Column) -> Column:
    """What makes two addresses the same page: host, path and query; scheme, ``www.``, fragment and slash do not count."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.struct(
        F.regexp_replace(F.lower(authority(url)), r"^www\.", "").alias("host"),
        F.coalesce(F.nullif(bare, F.lit("")), F.lit("/")).alias("path"),
        query(url).alias("query"),
    )


def same_page(a: Column, b: Column) -> Column:
    return identity(a) == identity(b)


def checked_url(raw: Column) -> Column:
    """A user's address with ``https://`` where no scheme stands; null where it has no host with a dot."""
    text = F.trim(raw)
    full = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(full.rlike(r"^https?://[^\s/?#]*\.[^\s/?#]+[^\s]*$"), F.regexp_replace(full, "/+$", ""))


def parse_rules(raw: Column) -> Column:
    """Path rules of a site: separated by commas or blanks, ``!`` excludes, ``*`` at the end is a prefix."""
    parts = F.filter(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit(","), F.lit(" ")), r"\s+"), lambda p: p != "")

    def one(part: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(part, "^!+", ""), "^/+", "")
        bare = F.when(F.endswith(bare, F.lit("*")), bare).otherwise(F.regexp_replace(bare, "/+$", ""))
        return F.concat(F.when(F.startswith(part, F.lit("!")), F.lit("!")).otherwise(F.lit("")), F.lit("/"), bare)

    return F.transform(parts, one)


def site_rules(raw: Column, is_own: Column) -> Column:
    """Rules of a site; rivals also get the built-in exclusions."""
    return F.when(is_own, parse_rules(raw)).otherwise(F.concat(parse_rules(raw), parse_rules(F.lit(" ".join(RIVAL_EXCLUSIONS)))))


def rule_matches(of: Column, rule: Column) -> Column:
    inside = F.startswith(rule, F.lit("/*")) & F.endswith(rule, F.lit("*")) & (F.length(rule) > 3)
    word = F.lower(F.substring(rule, F.lit(3), F.greatest(F.length(rule) - 3, F.lit(0))))
    prefix = F.substring(rule, F.lit(1), F.length(rule) - 1)
    return (
        F.when(inside, F.contains(F.lower(of), word))
        .when(F.endswith(rule, F.lit("*")), F.startswith(of, prefix))
        .otherwise((of == rule) | F.startswith(of, F.concat(rule, F.lit("/"))))
    )


def path_included(url: Column, rules: Column) -> Column:
    """Whether the rules keep a page: no rules keep all, the home page always stays, an exclusion wins."""
    bare = F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))
    out = F.exists(rules, lambda r: F.startswith(r, F.lit("!")) & rule_matches(bare, F.substring(r, F.lit(2), F.length(r))))
    only = F.filter(rules, lambda r: ~F.startswith(r, F.lit("!")))
    kept = F.when(out, False).when(F.size(only) == 0, True).otherwise(F.exists(only, lambda r: rule_matches(bare, r)))
    return F.when((F.size(rules) == 0) | (bare == "/"), True).otherwise(kept)


def is_info(url: Column) -> Column:
    return path(url).rlike("(?iU)" + INFO_PATH)


def content_kind(url: Column, category: Column) -> Column:
    by_name = F.coalesce(category.rlike("(?iuU)" + INFO_CATEGORY), F.lit(False))
    return F.when(is_info(url) | by_name, "info").otherwise("commerce")


def is_blocked_request(kind: Column, url: Column) -> Column:
    hit = kind.isin(*BLOCKED_TYPES)
    for part in TRACKER_PARTS:
        hit = hit | F.contains(url, F.lit(part))
    return hit
