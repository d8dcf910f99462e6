"""Link crawls against a plain queue: first come, first served, cuts inside a level, pages that fail, sites that block."""

import random
from collections import defaultdict

import pytest

from sitetide.sources import sitemap

LINKS, STATES = "site_id long, url string, pos int, target string", "site_id long, url string, state string"


def plain(links, starts, max_pages, states):
    out = defaultdict(list)
    of = defaultdict(list)
    for site, url, pos, target in sorted(links):
        of[site, url].append((pos, target))
    for site, start in starts:
        seen, queue = {start}, [(start, 0)]
        while queue and sum(s == "ok" for *_, s in out[site]) < max_pages:
            url, depth = queue.pop(0)
            state = states.get((site, url), "failed") if states is not None else "ok"
            if state == "failed":
                continue
            out[site].append((url, depth, state))
            if state == "blocked":
                break
            for _, target in of[site, url]:
                if target not in seen and target.split("/")[2] == url.split("/")[2]:
                    seen.add(target)
                    queue.append((target, depth + 1))
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize(("cap", "with_states"), [(1000, True), (7, True), (12, False), (1, True)])
def test_equals_a_plain_queue(spark, cap, with_states):
    rng = random.Random(cap)
    links, states = [], {}
    for site in range(5):
        n = 40
        for a in range(n):
            states[site, f"https://s{site}.example/{a}"] = rng.choices(("ok", "failed", "blocked"), (30, 6, 1 if site % 2 else 0))[0]
            for pos in range(rng.randrange(5)):
                other = "x.example" if rng.random() < 0.1 else f"s{site}.example"
                links.append((site, f"https://s{site}.example/{a}", pos, f"https://{other}/{rng.randrange(n)}"))
        states[site, f"https://s{site}.example/0"] = "ok"
    starts = [(site, f"https://s{site}.example/0") for site in range(5)]
    given = spark.createDataFrame([(*k, v) for k, v in states.items() if v != "failed"], STATES) if with_states else None
    got = defaultdict(list)
    for r in sitemap.link_crawl(spark.createDataFrame(links, LINKS).repartition(3), spark.createDataFrame(starts, "site_id long, url string"), cap, given).collect():
        got[r["site_id"]].append((r["place"] + (r["state"] == "blocked") * 0.5, r["url"], r["depth"], r["state"]))
    want = plain(links, starts, cap, states if with_states else None)
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == want


def test_start_that_blocks_or_fails(spark):
    links = spark.createDataFrame([(1, "https://a.example/", 0, "https://a.example/b")], LINKS)
    starts = spark.createDataFrame([(1, "https://a.example/"), (2, "https://b.example/")], "site_id long, url string")
    states = spark.createDataFrame([(1, "https://a.example", "blocked"), (1, "https://a.example/b", "ok")], STATES)
    assert [tuple(r) for r in sitemap.link_crawl(links, starts, 9, states).collect()] == [(1, "https://a.example", 0, 0, "blocked")]
    assert sitemap.link_crawl(links, starts.limit(0), 9).count() == 0
