"""Long maps and pages of links are read piece by piece, with the entries of a whole reading."""

from xml.etree import ElementTree

import pytest

from sitetide.functions.markup import link_parts, page_links
from sitetide.sources import sitemap

HEAD = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"


def whole(body):
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    return [(e.findtext(f"{space}loc"), e.findtext(f"{space}lastmod")) for e in ElementTree.fromstring(body).iter(f"{space}url")]


@pytest.mark.parametrize("step", [7, 100, 1 << 20])
def test_parts_of_a_map(monkeypatch, step):
    monkeypatch.setattr(sitemap, "SLICE", step)
    each = "".join(f"<url><loc>https://a/{k}</loc>{'<lastmod>2024</lastmod>' if k % 2 else ''}</url>" for k in range(25))
    body = f"{HEAD}{each}<group><url><loc>https://a/я</loc></url></group></urlset>".encode()
    parts = list(sitemap.sitemap_parts(body, 10))
    assert [(k, at, len(e)) for k, at, e in parts] == [("urlset", 0, 10), ("urlset", 10, 10), ("urlset", 20, 6)]
    assert [(x["url"], x["lastmod"]) for _, _, e in parts for x in e] == whole(body)
    assert list(sitemap.sitemap_parts(body[:-3], 10)) == [(None, 0, [])] == list(sitemap.sitemap_parts(None, 10))
    assert list(sitemap.sitemap_parts(f"{HEAD}</urlset>".encode(), 10)) == [("urlset", 0, [])]
    index = HEAD.replace("urlset", "sitemapindex") + "".join(f"<sitemap><loc>f{k}</loc></sitemap>" for k in range(300)) + "</sitemapindex>"
    assert [(k, len(e)) for k, _, e in sitemap.sitemap_parts(index.encode(), 10)] == [("sitemapindex", 200)]


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_parts_of_a_page_of_links(step):
    page = "".join(f"<p><a href='/p/{k}?a=1&amp;b'>Страница  {k} &lt;</a> x<a>no</a><A href=/q{k}>open" for k in range(12)) + "<a href='/end'>end"
    parts = list(link_parts(page, 5, step))
    assert [at for at, _ in parts] == [0, 5, 10, 15, 20] and max(len(x) for _, x in parts) <= 5
    assert [(x["href"], x["text"]) for _, e in parts for x in e] == page_links(page) and not list(link_parts(None, 5))


def test_a_long_map_takes_many_rows(spark, monkeypatch):
    monkeypatch.setattr(sitemap, "ENTRIES", 10)
    body = HEAD + "".join(f"<url><loc>https://a/{k}</loc></url>" for k in range(95)) + "</urlset>"
    rows = sitemap.maps_of(spark.createDataFrame([(1, body), (2, "<html>")], "site_id long, body string")).collect()
    assert sorted((r["site_id"], r["at"], len(r["entries"])) for r in rows) == [(1, 10 * k, 10 if k < 9 else 5) for k in range(10)]
