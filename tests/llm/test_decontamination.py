import hashlib
import re

from sitetide.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                of = windows.get(tuple(w[k : k + n]))
                if of:
                    hit.update(range(k, k + n))
                    found |= of
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute(docs, items)
    for r in decontamination.op6_aho_corasick(spark, small).collect():
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_odd_rows_and_several_automata(spark, docs, rows):
    items = [(1, "Brown FOX"), (2, None), (3, ""), (4, rows[0][1]), (None, "one two three"), (5, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (decontamination.PART_CHARS, 60):
        found = decontamination.contamination(docs, bench, part_chars=part, keep=True)
        assert found.columns == [*docs.columns, "n_words", "hit", "ids"]
        got = {r["doc_id"]: (r["n_words"], len(r["hit"]), sorted(x for x in r["ids"] if x)) for r in found.filter("doc_id <> 3").collect()}
        want = {k: v for k, v in brute([(i, t) for i, t, *_ in rows], items).items() if k in got}
        assert got == want
    assert decontamination.contamination(docs, bench.limit(0)).filter("size(hit) > 0").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in decontamination.hit_spans(decontamination.contamination(docs, bench)).collect()}
    assert [(s["start"], s["end"]) for s in spans[12]] == [(0, 13)]
