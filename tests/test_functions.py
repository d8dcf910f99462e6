import pytest
from pyspark.sql import functions as F

from sitetide.functions import markup, noise, parsers, text, urls
from sitetide.operators import similarity, sitewide, topics
from sitetide.sources import sitemap, store


def same(a, b):
    return noise.normalize(a) == noise.normalize(b)


@pytest.mark.parametrize(
    "old,new,equal",
    [
        ("Курс\nвы соглашаетесь с тем, что мы используем\ncookies\nПринять\n5313", "Курс\n6 002", True),
        ("Курс\n5313", "Курс\n6 002", True),
        ("Уже идёт 17 дней", "Уже идёт 1 день", True),
        ("Цена\n1 390\n₽", "Цена\n1 490\n₽", False),
        ("04:52\nдней\n12 мин", "03:10\nдня\n7 мин", True),
        ("A\nПохожие статьи\nX\n1 мая 2026\nY\n2 мая 2026", "A\nПохожие статьи\nZ\n3 мая 2026", True),
        ("A\nПохожие статьи\nбез дат", "A\nПохожие статьи\nсовсем без дат", False),
        ("1503\nотзыва", "1510\nотзывов", True),
    ],
)
def test_noise(old, new, equal):
    assert same(old, new) is equal


def test_reviews_are_cut_where_the_last_card_ends():
    cards = "".join(f"\nИмя{k}\n{k} мая 2026\n5\nтекст {k}\nна курс\nхвост {k}" for k in (1, 2, 3))
    assert noise.strip_reviews("до\nОтзывы учеников" + cards + "\nпосле").splitlines() == ["до", "после"]
    assert noise.strip_reviews("Отзывы\n1 мая 2026\nтекст") == "Отзывы\n1 мая 2026\nтекст"


def test_page_structure():
    body = "слово " * 100
    html = (
        "<head><title> T  t </title><meta name='Description' content='d'></head><body><nav>menu</nav>"
        f"<article><h1>Заголовок</h1><h2>Один</h2><p>{body}<a href='/x'>ссылка</a>, дальше</p><h3>Похожие статьи</h3>"
        "<div class='share'>поделиться</div></article><footer>f</footer></body>"
    )
    made = markup.structure(html)
    assert (made["meta_title"], made["meta_description"], made["h1"]) == ("T t", "d", "Заголовок")
    assert made["headings"] == [{"level": 2, "text": "Один"}]
    assert "ссылка, дальше" in made["main_text"] and "поделиться" not in made["main_text"]
    assert markup.structure(None)["main_text"] == "" and markup.page_text("<p>a<b>c</b></p><script>x</script>") == "a\nc"
    assert markup.page_links("<a href='/a'>x <b>y</b><a href='/b'>z</a><a>no</a>") == [("/a", "x y"), ("/b", "z")]


def test_sitemaps(spark):
    import gzip

    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.ru/x/</loc><lastmod>2026-01-02</lastmod></url></urlset>'
    index = b'<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.ru/s.gz</loc></sitemap></sitemapindex>'
    rows = [(1, "https://a.ru/sitemap.xml", 200, index), (1, "https://a.ru/s.gz", 200, gzip.compress(xml)), (1, "https://a.ru/h", 200, b"<p>no</p>"), (1, "https://a.ru/b", 200, b"\x1f\x8bbad")]
    found = sitemap.read_sitemaps(spark.createDataFrame(rows, "site_id long, url string, status int, body binary")).collect()
    assert [(r["source"], r["url"], r["lastmod"]) for r in found] == [("https://a.ru/sitemap.xml", "https://a.ru/x/", "2026-01-02")]
    raw = spark.createDataFrame(
        [(1, "https://a.ru", k, u, m) for k, (u, m) in enumerate([("https://a.ru/x/#t", "bad"), ("https://a.ru/x", "2026-01-02T03:04:05+03:00"), ("https://b.ru/y", None), ("https://a.ru/f.PDF", None)])],
        "site_id long, base_url string, pos int, url string, lastmod string",
    )
    (only,) = sitemap.to_entries(raw).collect()
    assert only["url"] == "https://a.ru/x" and str(only["lastmod"]) == "2026-01-02 00:04:05"
    robots = spark.createDataFrame([("User-agent: *\r\nSITEMAP : https://a.ru/m.xml\nsitemap:\n",)], "b string")
    assert robots.select(sitemap.robots_sitemaps(F.col("b"))).first()[0] == ["https://a.ru/m.xml"]


def test_expressions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(urls.parse_rules(F.lit("/a/, b*  !c/"))) == ["/a", "/b*", "!/c"]
    rules = urls.site_rules(F.lit("/courses /podg-*"), F.lit(False))
    for url, kept in [("https://x/", True), ("https://x/courses/1", True), ("https://x/courses-old", False), ("https://x/podg-9", True), ("https://x/courses/college-1", False)]:
        assert value(urls.path_included(F.lit(url), rules)) is kept
    assert value(urls.same_page(F.lit("http://www.A.ru/x/"), F.lit("https://a.ru/x#f"))) and not value(urls.same_page(F.lit("https://a.ru/x"), F.lit("https://a.ru/x?y")))
    assert value(urls.strip_tracking(F.lit("https://a.ru/x?UTM_a=1&q=a%20b~&e&gclid=2#f"))) == "https://a.ru/x?q=a+b~&e=#f"
    assert [value(text.stem(F.lit(w))) for w in ("курсов", "цена", "егэ", "английского")] == ["курс", "цена", "егэ", "английск"]
    assert value(text.tokens(F.lit("Ещё Курсы для ЕГЭ и ёлки"))) == ["курс", "егэ", "елки"]
    assert value(text.week_title(F.to_timestamp(F.lit("2026-10-25 22:30:00")))) == "Неделя 26.10–01.11.2026"
    assert [value(text.page_number(F.lit(x))) for x in ("", "abc", "2.5", "0", "-5", "  7  ")] == [1, 1, 1, 1, 1, 7]
    assert value(text.union_ci(F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b"), F.lit("b")))) == ["A", "b", "b"]
    assert value(text.clip(F.lit("a  b c"), 4)) == "a b…" and value(text.blocked_reason(F.lit(200), F.lit("Just a moment"))) == "just a moment"
    raw = spark.createDataFrame([('x {"verdict": "да", "our_url": "u", "importance": "low"} y',), ("no object",), (None,)], "raw string")
    assert [r["comparison"] and r["comparison"]["verdict"] for r in parsers.with_comparison(raw).collect()] == ["similar", None, None]
    found = parsers.with_analysis(raw).select("analysis.category", "analysis.importance")
    assert [r["importance"] for r in found.collect()] == ["low", None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_answers_are_validated(spark):
    raw = '{"results": [{"n": 1, "decision": "update", "our_url": "x"}, {"n": "2", "decision": "Covered", "our_url": "b"}, {"n": 9, "decision": "new"}]}'
    rows = spark.createDataFrame([(1, [["a"], ["b"]], raw)], "batch_id long, candidates array<array<string>>, raw string")
    found = {r["n"]: (r["decision"], r["our_url"], r["coverage"]) for r in parsers.match_results(rows).collect()}
    assert found == {1: ("new", None, "none"), 2: ("covered", "b", "full")}
    cards = spark.createDataFrame([(1, 1, '{"cards": [{"n": 1, "topic": "t", "material_type": "Тест по теме", "subintents": ["a", " "]}]}')], "batch_id long, size int, raw string")
    card = parsers.intent_cards(cards).first()
    assert (card["main_intent"], card["material_type"], card["subintents"]) == ("t", "тест", ["a"])


def test_site_wide_banner(spark):
    rows = [(1, f"u{k}", "changed", "a\nb", f"a\nСкидка {k}0% на всё\nтолько сегодня\nуспейте записаться\nb") for k in range(5)]
    rows += [(1, "own", "changed", "a\nb", "a\nСкидка 7% на всё\nтолько сегодня\nуспейте записаться\nb\nсвой новый модуль про дроби"), (1, "one", "changed", "a", "совсем другая правка текста")]
    marked = sitewide.marked_lines(spark.createDataFrame(rows, "site_id long, url string, change_type string, old_text string, new_text string"))
    (group,) = sitewide.groups(marked).collect()
    assert group["n_pages"] == 6 and len(group["lines"]) == 3
    own = {r["url"]: r["own_text"] for r in sitewide.own_changes(marked).collect()}
    assert own.pop("own") == "+свой новый модуль про дроби" and own == {f"u{k}": None for k in range(5)}


def test_topics_of_one_run_join_the_earliest_of_another_site(spark):
    rows = [(1, 1, "дроби и проценты"), (2, 2, "дроби и проценты"), (3, 1, "дроби и проценты"), (4, 2, "глаголы движения"), (5, 2, "глаголы движения")]
    new = spark.createDataFrame([(i, s, t, t) for i, s, t in rows], "id long, site_id long, title string, text string")
    assert {r["id"]: r["same_as"] for r in topics.same_run_topics(new).collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}


def test_topics_of_a_long_chain_are_all_settled(spark):
    """Each case is like its predecessor only, so one case is settled a round; none may be missing."""
    new = spark.createDataFrame([(k, k % 2, None, " ".join(f"wort{2 * k + x}x" for x in range(10))) for k in range(56)], "id long, site_id long, title string, text string")
    near = {}
    for r in similarity.search(new, new, None, topics.MERGE).filter("id < query_id and id % 2 <> query_id % 2").collect():
        near.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    want = {}
    for k in range(56):
        want[k] = min((p for p in near.get(k, []) if want[p[1]] is None), default=(0, None))[1]
    assert len(near) > 50 and {r["id"]: r["same_as"] for r in topics.same_run_topics(new).collect()} == want


def test_store(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at int")
    assert {(r["k"], r["v"]) for r in store.latest(log, ["k"], ["at"]).collect()} == {(1, "b"), (2, "c")}
    path = f"{tmp_path}/weeks"
    store.overwrite_week(spark.createDataFrame([("w1", 1), ("w2", 2)], "week string, x int"), path)
    store.overwrite_week(spark.createDataFrame([("w2", 3)], "week string, x int"), path)
    assert {(r["week"], r["x"]) for r in spark.read.parquet(path).collect()} == {("w1", 1), ("w2", 3)}


def test_item_structure(spark):
    """Headings are markdown lines, the first of level 1 is the heading of the page, lists of other articles are no part."""
    md = "intro\n# **Main**  title #\n# Second\r\n## Part *one*\n### Похожие статьи\n#### deep\n##\n ## Last "
    row = ("  T  t", "", md, "a  b\n\n c\nПохожие статьи\nX\n1 мая 2026")
    got = spark.createDataFrame([row, (None, None, None, None)], "t string, d string, m string, x string").select(markup.item_structure(*[F.col(c) for c in "tdmx"]).alias("s")).collect()
    s = got[0]["s"]
    assert (s["meta_title"], s["meta_description"], s["h1"]) == ("T t", None, "Main title")
    assert [(h["level"], h["text"]) for h in s["headings"]] == [(2, "Part one"), (2, "Last")] and s["main_text"] == "a b\nc"
    assert got[1]["s"].asDict() == {"meta_title": None, "meta_description": None, "h1": None, "headings": [], "main_text": ""}


def test_next_run(spark):
    """A Wednesday: overdue and nearly due runs start in two minutes, all others become the next Sunday at three."""
    rows = [("2024-01-10 08:00:00",), ("2024-01-10 09:01:00",), ("2024-01-12 09:00:00",), (None,)]
    made = spark.createDataFrame(rows, "s string").select(text.next_run(F.to_timestamp("s"), F.lit("2024-01-10 09:00:00").cast("timestamp")).cast("string").alias("r"))
    assert [r["r"] for r in made.collect()] == ["2024-01-10 09:02:00"] * 2 + ["2024-01-14 00:00:00"] * 2


def test_pages_that_share_all_take_the_answer_of_their_group(spark):
    lines = [(1, f"u{k}", 0, 0, "+Banner", 7) for k in range(3)] + [(1, "u9", 0, k, f"{'-' if k % 2 else '+'}link {k}", None) for k in range(10)]
    marked = spark.createDataFrame(lines, "site_id long, url string, run int, pos int, line string, cluster long")
    own = spark.createDataFrame([(1, f"u{k}", None) for k in (0, 1, 2, 9)], "site_id long, url string, own_text string")
    answers = spark.createDataFrame([(7, "New banner", "high")], "cluster long, summary string, importance string")
    got = {r["url"]: (r["summary"], r["importance"], r["sitewide_pages"]) for r in sitewide.group_answers(marked, own, answers).collect()}
    assert got["u0"] == ("Сквозное изменение на 3 стр.: New banner", "high", 3) and got["u9"] == (sitewide.SHUFFLE_SUMMARY, "low", None)
