"""URL inventories from already fetched responses: sitemaps, robots.txt, link pages, and a crawl over known links."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sitetide.functions import urls
from sitetide.functions.markup import extract_links, link_parts
from sitetide.functions.text import parse_lastmod
from sitetide.operators.ordered import numbered, running_at
from sitetide.session import own_folder, ship, trim, written

MAX_SUB_FILES = 200
#: Entries of a map or links of a page in one row, and bytes of a file that are parsed at a time.
ENTRIES, SLICE = 10_000, 1 << 20
#: Text and address of a link to a site's own map.
MAP_TEXT = r"(?iuU)карта\s+сайта|site\s*map"
MAP_PATH = r"(?iU)sitemap|site-map|karta[-_]?sa[ijy]{0,2}ta"


def gunzip(body: bytes | None) -> bytes:
    """Packed bodies by their first two bytes; broken ones are empty."""
    if body and body[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(body)
        except (OSError, EOFError):
            return b""
    return bytes(body or b"")


def _top_elements(raw: bytes) -> Iterator[ElementTree.Element]:
    """The root of an XML file, then each of its children when it is whole; one that was seen is let go."""
    parser, depth, root = ElementTree.XMLPullParser(("start", "end")), 0, None

    def seen() -> Iterator[ElementTree.Element]:
        nonlocal depth, root
        for event, e in parser.read_events():
            depth += 1 if event == "start" else -1
            if root is None:
                root = e
                yield e
            elif event == "end" and depth == 1:
                yield e
                root.clear()

    for at in range(0, len(raw), SLICE):
        parser.feed(raw[at : at + SLICE])
        yield from seen()
    parser.close()
    yield from seen()


def sitemap_parts(body: bytes | None, size: int) -> Iterator[tuple[str | None, int, list[dict]]]:
    """``kind, at, entries``: the root's name (``urlset`` or ``sitemapindex``) and ``url, lastmod`` of its entries, ``size`` of
    them at a time from the number ``at`` on; one part without entries, if there are none, and none of a kind for anything
    else. The file is read to its end before the first part, as a broken one has no entries."""
    space, raw = "{http://www.sitemaps.org/schemas/sitemap/0.9}", gunzip(body)
    kind, subs = None, []
    try:
        for k, e in enumerate(_top_elements(raw)):
            if k == 0:
                kind = e.tag.rpartition("}")[2]
            elif len(subs) < MAX_SUB_FILES:
                subs += [s for s in (x.findtext(f"{space}loc") for x in e.iter(f"{space}sitemap")) if s]
    except ElementTree.ParseError:
        kind = None
    if kind not in ("urlset", "sitemapindex"):
        yield None, 0, []
        return
    if subs:
        yield "sitemapindex", 0, [{"url": s, "lastmod": None} for s in subs[:MAX_SUB_FILES]]
        return
    at, held = 0, []
    for k, e in enumerate(_top_elements(raw)):
        for x in e.iter(f"{space}url") if k else ():
            u = x.findtext(f"{space}loc")
            if u:
                held.append({"url": u, "lastmod": x.findtext(f"{space}lastmod")})
        if len(held) >= size:
            yield "urlset", at, held
            at, held = at + len(held), []
    if held or not at:
        yield "urlset", at, held


def parse_sitemap(body: bytes | None) -> tuple[str | None, list[dict]]:
    """The root's name (``urlset`` or ``sitemapindex``) and ``url, lastmod`` of its entries; none for anything else."""
    kind, entries = None, []
    for kind, _, part in sitemap_parts(body, ENTRIES):
        entries += part
    return kind, entries


@F.pandas_udf(T.BooleanType())
def is_map(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a body is an XML map or index."""
    for series in bodies:
        yield pd.Series([next(sitemap_parts(x, 1))[0] is not None for x in series], dtype="bool")


def _in_parts(rows: DataFrame, kind: str, parts) -> DataFrame:
    """All columns but the last, and for each of ``parts(last column)`` a row with its values, of type ``kind``. A row and a
    part of it are held at a time, however long what a row holds."""
    ship(rows.sparkSession)
    made = T.StructType([*rows.schema.fields[:-1], *T.DataType.fromDDL(kind).fields])
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = [c.slice(k, 1) for c in batch.columns[:-1]]
                for values in parts(batch.columns[-1][k].as_py()):
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array([v], t) for v, t in zip(values, types[len(own) :], strict=True)]], made.names)
        trim()

    return rows.mapInArrow(run, made)


def maps_of(rows: DataFrame) -> DataFrame:
    """``.., kind, at, entries`` of ``rows (.., body)`` that are XML maps: each map in rows of some thousand entries."""
    parts = _in_parts(rows.withColumn("body", F.col("body").cast("binary")), "kind string, at int, entries array<struct<url:string,lastmod:string>>", lambda body: sitemap_parts(body, ENTRIES))
    return parts.filter("kind is not null")


def links_of(rows: DataFrame) -> DataFrame:
    """``.., at, links`` of ``rows (.., html)``: the links of each page in rows of some thousand."""
    return _in_parts(rows, "at int, links array<struct<href:string,text:string>>", lambda html: link_parts(html, ENTRIES))


@F.pandas_udf(T.StringType())
def join_url(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(base: str, href: str) -> str | None:
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    for base, href in cols:
        yield pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")


def read_sitemaps(responses: DataFrame) -> DataFrame:
    """``site_id, source, url, lastmod`` of responses ``(site_id, url, status, body)``.

    A sitemap index is replaced by the entries of those of its first 200 files that were fetched and can be read.
    """
    parsed = responses.filter("status = 200").select("site_id", F.col("url").alias("source"), "body")
    parsed = written(maps_of(parsed), "sitemaps")
    entries = parsed.select("site_id", "source", "kind", F.explode("entries").alias("e"))
    direct = entries.filter("kind = 'urlset'").select("site_id", "source", "e.url", "e.lastmod")
    index = entries.filter("kind = 'sitemapindex'").select("site_id", F.col("source").alias("index"), F.col("e.url").alias("source"))
    return direct.join(index, ["site_id", "source"], "left").select("site_id", F.coalesce("index", "source").alias("source"), "url", "lastmod")


def robots_sitemaps(body: Column) -> Column:
    """Addresses of the ``Sitemap:`` lines."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))) == "sitemap")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))), lambda x: x != "")


def html_links(pages: DataFrame) -> DataFrame:
    """``url, pos, href, text, target`` of every link of ``pages (url, html)``; targets are absolute."""
    each = pages.select("url", F.posexplode(extract_links("html")).alias("pos", "l"))
    return each.select("url", "pos", "l.href", "l.text", join_url("url", "l.href").alias("target"))


def links_as_entries(pages: DataFrame) -> DataFrame:
    """A page of links read as a sitemap without dates."""
    return html_links(pages).select("url", urls.strip_tracking(F.col("target")).alias("entry"), F.lit(None).cast("string").alias("lastmod"))


def sitemap_page_link(pages: DataFrame) -> DataFrame:
    """``url, link``: the link to the site's own map, first by its text, then by its address, on the same host only."""
    found = html_links(pages).filter(~F.col("href").rlike("^(#|mailto:|tel:|javascript:)") & urls.same_domain(F.col("target"), F.col("url")))
    rank = F.when(F.col("text").rlike(MAP_TEXT), 0).when(urls.path(F.col("target")).rlike(MAP_PATH), 1)
    return found.withColumn("rank", rank).filter("rank is not null").groupBy("url").agg(F.min_by("target", F.struct("rank", "pos")).alias("link"))


def to_entries(raw: DataFrame) -> DataFrame:
    """``site_id, url, lastmod`` of ``raw (site_id, base_url, pos, url, lastmod)``: normalised pages of the same host,
    without files; of repeated addresses the last one counts."""
    rows = raw.withColumn("url", urls.normalize_url(F.col("url")))
    rows = rows.filter(urls.same_domain(F.col("url"), F.col("base_url")) & ~urls.is_file(F.col("url")))
    last = rows.groupBy("site_id", "url").agg(F.max_by(F.struct("lastmod"), "pos").alias("l"))
    return last.select("site_id", "url", parse_lastmod(F.col("l.lastmod")).alias("lastmod"))


def _entries_of(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """``site_id, rank, place, pos, kind, url, lastmod`` of the maps ``wanted (site_id, rank, place, source)`` that were fetched.

    An index gives the entries of its files in turn. A file that is no XML map has no rows here."""
    maps = written(maps_of(responses.filter("status = 200").select("site_id", F.col("url").alias("source"), "body")), "maps")
    own = wanted.join(maps, ["site_id", "source"])
    direct = own.filter("kind = 'urlset'").select("site_id", "rank", "place", F.lit(0).alias("file"), "at", F.posexplode("entries").alias("pos", "e"))
    files = own.filter("kind = 'sitemapindex'").select("site_id", "rank", "place", F.posexplode("entries").alias("file", "f")).withColumn("source", F.col("f.url"))
    nested = files.join(maps.filter("kind = 'urlset'"), ["site_id", "source"]).select("site_id", "rank", "place", "file", "at", F.posexplode("entries").alias("pos", "e"))
    each = direct.unionByName(nested)
    return each.select("site_id", "rank", F.struct("place", "file", (F.col("at") + F.col("pos")).alias("pos")).alias("pos"), "e.url", "e.lastmod")


def discover(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``site_id, rank, url, lastmod``: the pages of each site by the first source that has any.

    ``sites (site_id, base_url, sitemap_url)``, ``responses (site_id, url, status, body)`` of all that was fetched. A site
    with a map of its own setting has only that (rank 0): an XML map or index, else the links of the page. The others have
    ``/sitemap.xml`` (1); where it is missing, no map or empty, the maps of robots.txt together (2); where these bring
    nothing, the page that the home page links as its map (3), read like one of its own setting. Each site is judged by
    what its own responses hold. Entries come normalised, of the same host, without files, the last of each address.
    """
    base = F.regexp_replace("base_url", r"^(https?://[^/?#]+).*$", "$1")
    own = F.coalesce(F.nullif(F.trim("sitemap_url"), F.lit("")), F.lit(""))
    ruled = own != ""
    zero = F.lit(0).alias("place")
    given = sites.filter(ruled).select("site_id", F.lit(0).alias("rank"), zero, own.alias("source"))
    rest = sites.filter(~ruled).withColumn("root", base)
    main = rest.select("site_id", F.lit(1).alias("rank"), zero, F.concat("root", F.lit("/sitemap.xml")).alias("source"))
    got = responses.filter("status = 200").select("site_id", "url", F.col("body").cast("string").alias("html"))
    robots = rest.select("site_id", F.concat("root", F.lit("/robots.txt")).alias("url")).join(got, ["site_id", "url"])
    listed = robots.select("site_id", F.lit(2).alias("rank"), F.posexplode(F.slice(robots_sitemaps(F.col("html")), 1, MAX_SUB_FILES)).alias("place", "source"))
    home = rest.select("site_id", F.col("base_url").alias("url")).join(got, ["site_id", "url"])
    linked = home.join(sitemap_page_link(home.select("url", "html")), "url").select("site_id", F.lit(3).alias("rank"), zero, F.col("link").alias("source"))
    wanted = written(given.unionByName(main).unionByName(listed).unionByName(linked).filter("source is not null"), "wanted")
    by_map = _entries_of(responses, wanted)
    pages = wanted.filter("rank in (0, 3)").select("site_id", "rank", F.col("source").alias("url")).join(got, ["site_id", "url"])
    pages = pages.filter(~is_map(F.col("html").cast("binary")))
    parts = links_of(pages.select("site_id", "rank", "url", "html"))
    each = parts.select("site_id", "rank", "url", F.col("at").alias("first"), F.posexplode("links").alias("nth", "l")).withColumn("at", F.col("first") + F.col("nth"))
    by_page = each.select("site_id", "rank", F.struct(F.lit(0).alias("place"), F.lit(0).alias("file"), F.col("at").alias("pos")).alias("pos"), urls.strip_tracking(join_url("url", "l.href")).alias("url"), F.lit(None).cast("string").alias("lastmod"))
    found = written(by_map.unionByName(by_page), "found")
    best = found.groupBy("site_id").agg(F.min("rank").alias("rank"))
    raw = found.join(best, ["site_id", "rank"]).join(sites.select("site_id", "base_url"), "site_id")
    return to_entries(raw).join(best, "site_id").select("site_id", "rank", "url", "lastmod")


def link_crawl(links: DataFrame, starts: DataFrame, max_pages: int, states: DataFrame | None = None) -> DataFrame:
    """``site_id, url, depth, place, state``: the pages of each site first come, first served, up to ``max_pages`` loaded ones.

    ``links (site_id, url, pos, target)``: a page's links in order; only those to the same host count. Pages wait in the
    order of the pages that first linked them and of the links there. ``states (site_id, url, state)`` says which pages are
    ``ok`` or ``blocked``; others cannot be loaded: they have no links and do not count. Without it all pages load. A site
    ends at its first blocked page, which is the last of its rows, with the state ``blocked``.

    A level is one join of the last one's pages and one anti join with the pages met so far; it is written beside the
    levels before it, which stay as they are. Ranks within a level are taken by all tasks together.
    """
    spark, path = links.sparkSession, f"{own_folder(links.sparkSession)}/crawl-{uuid.uuid4().hex}"
    same = links.filter(urls.same_domain(F.col("url"), F.col("target")))
    edges = same.select("site_id", urls.normalize_url(F.col("url")).alias("url"), urls.normalize_url(F.col("target")).alias("next"), "pos")
    edges = written(edges.groupBy("site_id", "url", "next").agg(F.min("pos").alias("pos")), "links")
    known = None
    if states is not None:
        known = states.select("site_id", urls.normalize_url(F.col("url")).alias("url"), "state")
        known = written(known.groupBy("site_id", "url").agg(F.min("state").alias("state")), "states")  # blocked, if any says so
    reached = starts.select("site_id", urls.normalize_url(F.col("url")).alias("url")).distinct()
    reached = reached.select("*", F.lit(0).cast("long").alias("rank"), F.lit(0).alias("pos"))
    done = None  # how many pages each site has, and whether it ended
    depth = 0
    while True:
        level = reached.join(known, ["site_id", "url"], "left") if known is not None else reached.withColumn("state", F.lit("ok"))
        level = numbered(level.withColumn("state", F.coalesce("state", F.lit("failed"))), ["site_id", "rank", "pos", "url"], "nth")
        level = level.withColumn("loaded", (F.col("state") == "ok").cast("long"))
        level = running_at(level, "nth", "loaded", "before")
        first = level.groupBy("site_id").agg(F.min("before").alias("skip"), F.min(F.when(F.col("state") == "blocked", F.col("nth"))).alias("wall"))  # one row a site
        level = level.join(F.broadcast(first), "site_id")
        if done is not None:
            level = level.join(F.broadcast(done.select("site_id", "n")), "site_id")
        else:
            level = level.withColumn("n", F.lit(0).cast("long"))
        place = F.col("n") + F.col("before") - F.col("skip")
        cut = (place < max_pages) & (F.col("wall").isNull() | (F.col("nth") <= F.col("wall")))
        level = level.withColumn("place", place).withColumn("taken", cut)
        level.select("site_id", "url", F.lit(depth).alias("depth"), "place", "state", "nth", "taken").write.parquet(f"{path}/level={depth}")
        kept = spark.read.parquet(f"{path}/level={depth}")
        now = kept.filter("taken").groupBy("site_id").agg(F.count_if(F.col("state") == "ok").alias("more"), F.max((F.col("state") == "blocked").cast("int")).alias("ended"))
        if done is None:
            done = now.select("site_id", F.col("more").alias("n"), F.col("ended") == 1)
        else:
            done = done.join(now, "site_id", "left").select("site_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.coalesce("ended", F.lit(0)) == 1))
        done = written(done.toDF("site_id", "n", "over"), "crawled")
        open_ = done.filter(~F.col("over") & (F.col("n") < max_pages)).select("site_id")
        parents = kept.filter("taken and state = 'ok'").join(F.broadcast(open_), "site_id", "left_semi")  # one row a site
        seen = spark.read.parquet(path).select("site_id", "url")
        found = parents.join(edges, ["site_id", "url"]).groupBy("site_id", F.col("next").alias("url")).agg(F.min(F.struct(F.col("nth").alias("rank"), "pos")).alias("at"))
        reached = written(found.join(seen, ["site_id", "url"], "left_anti").select("site_id", "url", "at.rank", "at.pos"), "reached")
        depth += 1
        if reached.isEmpty():
            break
    return spark.read.parquet(path).filter("taken and state <> 'failed'").select("site_id", "url", "depth", "place", "state")


def host_of(url: str) -> str:
    return urlsplit(url).netloc
