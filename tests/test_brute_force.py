"""Queries that SQL cannot express against plain Python on the smallest tables."""

import difflib
import hashlib
import math
import re
from collections import Counter, defaultdict
from html import unescape
from urllib.parse import urljoin

import pytest

from sitetide.functions import diffs, noise, text
from sitetide.operators import sitewide, topics
from sitetide.plans import catalog
from sitetide.plans.stand_ins import view
from sitetide.sources import sitemap
from tests.test_diffs import plain_runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def changed(spark):
    """Old and new text of each page that changed beyond noise."""
    old = {(r["site_id"], r["url"]): r["text"] or "" for r in view(spark, SF, "crawl_prev").collect()}
    new = {(r["site_id"], r["url"]): r["text"] or "" for r in view(spark, SF, "crawl_cur").collect()}
    return {k: (old[k], new[k]) for k in old.keys() & new.keys() if noise.normalize(old[k]) != noise.normalize(new[k])}


def test_unified_diff_is_that_of_the_texts(spark, changed):
    rows = {(r["site_id"], r["url"]): r["diff_text"] for r in catalog.queries()["unified_diff"](spark, SF).collect() if r["change_type"] == "changed"}
    strip = lambda x: noise.strip_rotating(x).splitlines()
    assert rows == {k: "\n".join(difflib.unified_diff(strip(old), strip(new), "было", "стало", lineterm="", n=2)) for k, (old, new) in changed.items()}


def test_side_by_side_shows_both_texts(spark, changed):
    rows = defaultdict(list)
    for r in catalog.queries()["side_by_side"](spark, SF).orderBy("site_id", "url", "pos").collect():
        rows[r["site_id"], r["url"]].append(r)
    assert rows.keys() == changed.keys()
    for key, (old, new) in changed.items():
        at = [0, 0]
        lines = [[x for x in t.splitlines() if x.strip()] for t in (old, new)]
        for r in rows[key]:
            if r["kind"] == "skip":
                assert lines[0][at[0] : at[0] + r["skipped"]] == lines[1][at[1] : at[1] + r["skipped"]]
                at = [at[0] + r["skipped"], at[1] + r["skipped"]]
                continue
            for side, shown in enumerate((r["old_line"], r["new_line"])):
                if shown is not None:
                    assert lines[side][at[side]] == shown
                    at[side] += 1
            assert r["kind"] == ("added" if r["old_line"] is None else "removed" if r["new_line"] is None else "equal" if r["old_line"] == r["new_line"] else "changed")
        assert len(rows[key]) == diffs.MAX_ROWS or at == [len(lines[0]), len(lines[1])]


def test_normalized_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in view(spark, SF, "documents").collect()}
    for r in catalog.queries()["normalize_text"](spark, SF).collect():
        assert r["content_hash"] == hashlib.sha256((noise.normalize(texts[r["doc_id"]]) or "").encode()).hexdigest()


def plain_groups(changed):
    """Pieces of changed lines on three pages at least, joined where they stand side by side or on almost the same pages."""
    pages, places = defaultdict(set), []
    for (site, url), (old, new) in changed.items():
        for run, lines in enumerate(plain_runs(old, new)):
            masked = [re.sub(r"[0-9][0-9  ]*", "#", x) for x in lines]
            for start in range(max(1, len(masked) - sitewide.SHINGLE + 1)):
                piece = (site, "\n".join(masked[start : start + sitewide.SHINGLE]))
                places.append((site, url, run, start, len(masked[start : start + sitewide.SHINGLE]), piece))
                if len(re.sub(r"[^A-Za-zА-Яа-яЁё]", "", piece[1])) >= sitewide.MIN_LETTERS:
                    pages[piece].add(url)
    shared = [p for p, u in pages.items() if len(u) >= sitewide.MIN_PAGES]
    root = {p: p for p in shared}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    before = {}
    for site, url, run, start, _, piece in sorted(places):
        if piece in root and (site, url, run, start - 1) in before:
            root[find(piece)] = find(before[site, url, run, start - 1])
        if piece in root:
            before[site, url, run, start] = piece
    for a in shared:
        for b in shared:
            if a[0] == b[0] and len(pages[a] & pages[b]) >= sitewide.JACCARD * len(pages[a] | pages[b]):
                root[find(a)] = find(b)
    members, touched = defaultdict(set), set()
    for site, url, *_, piece in places:
        if piece in root:
            members[find(piece)].add(url)
            touched.add((site, url))
    return Counter((k[0], len(u), min(u)) for k, u in members.items()), touched


def test_sitewide_groups(spark, changed):
    want, touched = plain_groups(changed)
    got = catalog.queries()["sitewide_groups"](spark, SF).collect()
    assert want and Counter((r["site_id"], r["n_pages"], r["first_url"]) for r in got) == want
    own = {(r["site_id"], r["url"]): r["own_text"] for r in catalog.queries()["sitewide_own_changes"](spark, SF).collect()}
    assert touched <= own.keys()
    for key, said in own.items():
        lines = [x for run in plain_runs(*changed[key]) for x in run]
        assert said is None or all(x in lines for x in said.split("\n"))


def test_html(spark):
    """Links, text and headings of the pages by patterns, after scripts and comments were cut out."""
    pages = {r["page_id"]: (r["url"], r["html"]) for r in view(spark, SF, "pages").collect()}
    plain = {k: (u, re.sub(r"<!--.*?-->|<(script|style|noscript|template|svg|iframe)\b.*?</\1\s*>", " ", h, flags=re.I | re.S)) for k, (u, h) in pages.items()}
    links = defaultdict(list)
    for r in catalog.queries()["html_links"](spark, SF).orderBy("url", "pos").collect():
        links[r["url"]].append((r["href"], r["target"]))
    texts = {r["page_id"]: r["text"] for r in catalog.queries()["html_text"](spark, SF).collect()}
    heads = {r["page_id"]: r for r in catalog.queries()["html_structure"](spark, SF).collect()}
    assert len(texts) == len(heads) == len(pages) and sum(map(len, links.values())) > 100
    for k, (url, html) in plain.items():
        found = [unescape(m[2]) for m in re.finditer(r"<a\b[^>]*?\bhref=([\"'])(.*?)\1", html, re.I | re.S)]
        assert [h for h, _ in links[url]] == found and all(t == urljoin(url, h) for h, t in links[url])
        title = re.search(r"<title[^>]*>(.*?)</title>", html, re.I | re.S)
        if title and heads[k]["meta_title"] is not None:
            assert heads[k]["meta_title"] == " ".join(unescape(title[1]).split())
        said = set(unescape(re.sub(r"<[^>]*>", " ", html)).split())
        assert sum(w in said for w in texts[k].split()) >= 0.9 * len(texts[k].split())
        assert all(h["level"] in (2, 3) for h in heads[k]["headings"])


def test_link_crawl(spark):
    """Breadth first from one page a host, in plain Python, and a chain deeper than any fixed number of levels."""
    links = sitemap.html_links(view(spark, SF, "pages").select("url", "html")).collect()
    host = lambda u: re.sub(r"^https?://", "", u).split("/")[0].split("?")[0].lower()
    normal = lambda u: re.sub(r"#.*$", "", u).rstrip("/") if re.sub(r"#.*$", "", u).rstrip("/") else u
    bare = lambda h: re.sub(r"^www\.", "", h)
    urls_of = defaultdict(list)
    for r in view(spark, SF, "pages").collect():
        urls_of[host(r["url"])].append(r["url"])
    edges = defaultdict(set)
    for r in links:
        if r["target"] and bare(host(r["url"])) == bare(host(r["target"])):
            edges[host(r["url"]), normal(r["url"])].add(normal(r["target"]))
    want = {}
    for h, us in urls_of.items():
        front, depth = [normal(min(us, key=lambda u: (len(u), u)))], 0
        while front:
            for u in front:
                want[h, u] = depth
            depth += 1
            front = sorted({n for u in front for n in edges[h, u]} - {u for g, u in want if g == h})
    got = {(r["site_id"], r["url"]): r["depth"] for r in catalog.queries()["link_crawl"](spark, SF).collect()}
    assert got == want
    chain = spark.createDataFrame([(1, f"https://a.example/{k}", 0, f"https://a.example/{k + 1}") for k in range(30)], "site_id long, url string, pos int, target string")
    start = spark.createDataFrame([(1, "https://a.example/0")], "site_id long, url string")
    assert sitemap.link_crawl(chain, start, 1000).count() == 31 and sitemap.link_crawl(chain, start, 20).count() == 20


def test_topic_merge(spark):
    """Each case in order of ids joins the most similar earlier one of another site that joined nobody."""
    rows = view(spark, SF, "documents").collect()
    stop, terms = set(text.STOPWORDS.split()), {}
    for k, t in ((r["doc_id"], r["text"]) for r in rows):
        words = re.findall("[а-яёa-z0-9]+", (t or "").lower().replace("ё", "е"))
        terms[k] = Counter(re.sub(text.STEM, r"\1", w) for w in words if len(w) > 2 and w not in stop)
    df = Counter(t for c in terms.values() for t in c)
    vectors = {}
    for k, c in terms.items():
        v = {t: n * (math.log((len(terms) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[k] = {t: x / size for t, x in v.items()} if size else {}
    joined = {}
    for k in sorted(vectors):
        near = [(round(s, 6), -e) for e in joined if joined[e] is None and e % 4 != k % 4 and (s := sum(x * vectors[e].get(t, 0) for t, x in vectors[k].items())) >= topics.MERGE]
        joined[k] = -max(near)[1] if near else None
    got = {r["id"]: r["same_as"] for r in catalog.queries()["topic_merge"](spark, SF).collect()}
    assert got == joined and any(v is not None for v in got.values())
