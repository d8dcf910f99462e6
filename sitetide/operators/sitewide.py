"""One change on many pages: clusters of changed lines shared by pages of a site, and what is left of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.diffs import change_runs, opcodes
from sitetide.functions.text import letters, mask_digits
from sitetide.operators.components import connected_components
from sitetide.session import written

SHINGLE = 3
MIN_PAGES = 3
MIN_LETTERS = 4
JACCARD = 0.8
OWN_LETTERS = 15
GROUP_LINES = 60
SHUFFLE_LINES, SHUFFLE_LENGTH = 6, 60
PAGE = ["site_id", "url"]
#: How shared changes and shuffles of links are named.
SITEWIDE_LABEL = "Сквозное изменение"
SHUFFLE_SUMMARY = "Перетасовка блока ссылок (другие термины/статьи) — шум, не правка."


def change_lines(diffs: DataFrame) -> DataFrame:
    """``site_id, url, run, lines`` of the changed pages."""
    rows = diffs.filter("change_type = 'changed'").select(*PAGE, opcodes("normal")("old_text", "new_text").alias("d"))
    rows = rows.select(*PAGE, change_runs(F.col("d")).alias("runs"))
    return rows.select(*PAGE, F.posexplode("runs").alias("run", "lines"))


def shingles(runs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``site_id, url, run, start, width, piece`` with digits masked; a run of at most ``size`` lines is one piece."""
    masked = runs.withColumn("m", F.transform("lines", mask_digits))
    starts = F.sequence(F.lit(0), F.greatest(F.size("m") - size, F.lit(0)))
    each = masked.select(*PAGE, "run", "m", F.explode(starts).alias("start"))
    piece = F.slice("m", F.col("start") + 1, F.lit(size))
    return each.select(*PAGE, "run", "start", F.size(piece).alias("width"), F.array_join(piece, "\n").alias("piece"))


def shared_pieces(pieces: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site_id, node, pages`` of pieces with letters on at least ``min_pages`` pages; ``node`` is a hash of the piece."""
    rows = pieces.filter(letters(F.col("piece")) >= MIN_LETTERS).select("site_id", F.xxhash64("site_id", "piece").alias("node"), "url").distinct()
    return rows.groupBy("site_id", "node").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)


def _set_edges(members: DataFrame, threshold: float) -> DataFrame:
    """Edges between pieces whose sets of pages are equal or have a Jaccard of at least ``threshold``.

    Equal sets meet by a signature. Of two different sets that are that close, the first pages of both, in an order
    by hash, must share one (a set of n pages needs n - ceil(threshold n) + 1 of them), so only these are joined; the
    sizes of the intersections then decide.
    """
    sign = members.groupBy("site_id", "node").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("url").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("url", F.lit(1)).cast("decimal(20,0)")).alias("t")
    )
    heads = written(sign.groupBy("site_id", "n", "s", "t").agg(F.min("node").alias("head")), "sets")
    same = sign.join(heads, ["site_id", "n", "s", "t"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    sets = members.join(heads.select("site_id", F.col("head").alias("node"), "n"), ["site_id", "node"])
    nth = F.row_number().over(Window.partitionBy("site_id", "node").orderBy(F.xxhash64("url"), "url"))
    prefix = sets.withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    x = prefix.select("site_id", "url", F.col("node").alias("a"), F.col("n").alias("na"))
    y = prefix.select("site_id", "url", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    pairs = x.join(y, ["site_id", "url"]).filter(near).select("site_id", "a", "b", "na", "nb").distinct()
    left = pairs.join(sets.select("site_id", F.col("node").alias("a"), "url"), ["site_id", "a"])
    both = left.join(sets.select("site_id", F.col("node").alias("b"), "url"), ["site_id", "b", "url"])
    common = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    close = common.filter(F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    return same.unionByName(close)


def clusters(pieces: DataFrame, shared: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """``node, cluster``: pieces next to each other in a run, and pieces of almost the same pages, belong together."""
    rows = pieces.withColumn("node", F.xxhash64("site_id", "piece"))
    on = rows.join(shared.select("site_id", "node"), ["site_id", "node"], "left_semi")
    before = Window.partitionBy(*PAGE, "run").orderBy("start")
    beside = on.withColumn("p", F.lag("node").over(before)).withColumn("q", F.lag("start").over(before))
    edges = beside.filter(F.col("q") == F.col("start") - 1).select(F.col("node").alias("a"), F.col("p").alias("b"))
    edges = edges.unionByName(_set_edges(on.select("site_id", "node", "url").distinct(), threshold))
    found = connected_components(edges).select("node", F.col("component").alias("cluster"))
    return shared.select("node").join(found, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def is_link_shuffle(lines: Column) -> Column:
    """Whether changed lines are only a list of short links of which some went and about as many came."""
    texts = F.transform(lines, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"(?U)^\s+|\s+$", ""))
    short = F.forall(texts, lambda t: (F.length(t) <= SHUFFLE_LENGTH) & ~t.rlike(r"[.!?:]$"))
    out = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("-"))))
    into = F.size(lines) - out
    return (F.size(lines) >= SHUFFLE_LINES) & short & (out >= 3) & (into >= 3) & (F.greatest(out, into) <= 3 * F.least(out, into))


def without_moved(lines: Column) -> Column:
    """Lines of a page whose text is not both removed and added."""
    text = lambda x: F.substring(x, F.lit(2), F.length(x))
    out = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("-"))), text)
    into = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("+"))), text)
    moved = F.array_intersect(out, into)
    return F.filter(lines, lambda x: ~F.array_contains(moved, text(x)))


def marked_lines(diffs: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site_id, url, run, pos, line, cluster`` of all changed lines; the cluster is null for a page's own ones."""
    runs = written(change_lines(diffs), "runs")
    pieces = written(shingles(runs), "pieces")
    shared = written(shared_pieces(pieces, min_pages), "shared")
    of = clusters(pieces, shared)
    hits = pieces.withColumn("node", F.xxhash64("site_id", "piece")).join(of, "node")
    covered = hits.select(*PAGE, "run", "start", "cluster", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("pos"))
    covered = covered.groupBy(*PAGE, "run", "pos").agg(F.max_by("cluster", "start").alias("cluster"))
    lines = runs.select(*PAGE, "run", F.posexplode("lines").alias("pos", "line"))
    return written(lines.join(covered, [*PAGE, "run", "pos"], "left"), "marked")


def own_changes(marked: DataFrame) -> DataFrame:
    """``site_id, url, own_text`` of pages with shared lines or mere link shuffles; null where nothing else changed."""
    own = F.array_sort(F.collect_list(F.when(F.col("cluster").isNull(), F.struct("run", "pos", "line"))))
    rows = marked.groupBy(*PAGE).agg(F.max(F.col("cluster").isNotNull()).alias("touched"), own.alias("own"))
    rows = rows.withColumn("own", without_moved(F.transform("own", lambda x: x["line"])))
    little = letters(F.array_join("own", "")) < OWN_LETTERS
    shuffle = is_link_shuffle(F.col("own"))
    rows = rows.filter(F.col("touched") | shuffle)
    return rows.select(*PAGE, F.when(~(little & F.col("touched")) & ~shuffle & (F.size("own") > 0), F.array_join("own", "\n")).alias("own_text"))


def groups(marked: DataFrame, limit: int = GROUP_LINES) -> DataFrame:
    """``site_id, cluster, n_pages, first_url, lines`` of each shared change, its most frequent lines with words first."""
    rows = marked.filter("cluster is not null").withColumn("key", mask_digits(F.col("line")))
    per_page = rows.groupBy("site_id", "cluster", "key", "url").agg(F.min(F.struct("run", "pos", "line")).alias("at"))
    keys = per_page.groupBy("site_id", "cluster", "key").agg(F.count("*").alias("pages"), F.min(F.struct("url", "at.run", "at.pos", "at.line")).alias("first"))
    totals = rows.groupBy("site_id", "cluster").agg(F.countDistinct("url").alias("n_pages"), F.min("url").alias("first_url"))
    wordless = letters(F.col("key")) == 0
    nth = F.row_number().over(Window.partitionBy("site_id", "cluster").orderBy(wordless, F.desc("pages"), "first"))
    top = keys.withColumn("nth", nth).filter(F.col("nth") <= limit).join(totals, ["site_id", "cluster"])
    part = F.concat(F.lit("   [на "), F.col("pages"), F.lit(" стр. из "), F.col("n_pages"), F.lit("]"))
    shown = F.concat(F.col("first.line"), F.when(F.col("pages") < F.col("n_pages"), part).otherwise(F.lit("")))
    made = top.groupBy("site_id", "cluster", "n_pages", "first_url").agg(F.array_sort(F.collect_list(F.struct("nth", shown.alias("line")))).alias("l"))
    return made.select("site_id", "cluster", "n_pages", "first_url", F.transform("l", lambda x: x["line"]).alias("lines"))


def group_answers(marked: DataFrame, own: DataFrame, answers: DataFrame) -> DataFrame:
    """``site_id, url, summary, importance, sitewide_pages`` of pages without changes of their own.

    A page takes the answer ``(cluster, summary, importance)`` of the largest change it belongs to, where that has one;
    a page in none of them, which is a mere shuffle of links, gets a fixed answer of low importance.
    """
    whole = own.filter("own_text is null").select(*PAGE)
    sizes = marked.filter("cluster is not null").groupBy("site_id", "cluster").agg(F.countDistinct("url").alias("pages"))
    member = marked.filter("cluster is not null").select(*PAGE, "cluster").distinct().join(sizes, ["site_id", "cluster"])
    first = member.groupBy(*PAGE).agg(F.max_by(F.struct("cluster", "pages"), F.struct("pages", "cluster")).alias("g"))
    rows = whole.join(first, PAGE, "left").select(*PAGE, "g.cluster", "g.pages").join(answers.withColumn("told", F.lit(True)), "cluster", "left")
    rows = rows.filter("cluster is null or told")
    text = F.concat(F.lit(f"{SITEWIDE_LABEL} на "), F.col("pages"), F.lit(" стр.: "), F.coalesce("summary", F.lit("")))
    text = F.regexp_replace(text, "[: ]+$", "")
    return rows.select(
        *PAGE,
        F.when(F.col("cluster").isNull(), SHUFFLE_SUMMARY).otherwise(text).alias("summary"),
        F.when(F.col("cluster").isNull(), "low").otherwise(F.col("importance")).alias("importance"),
        F.col("pages").alias("sitewide_pages"),
    )
