"""Cases with equal texts follow the earliest one of another site, and no text is shuffled for it."""

import random

from sitetide.operators import topics
from sitetide.plans import catalog


def test_cases_follow_the_earliest_of_another_site(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, 0, 0, 0, 1, 2, 3]), rng.choice([None, "", "a", "b", "b ", "c", f"own {k}"])) for k in range(300)]
    rows += [(5, 2, "b"), (None, 1, "b"), (700, None, "a"), (701, 0, "only here"), (702, 0, "only here")]
    new = spark.createDataFrame(rows, "id long, site_id long, text string").repartition(3)
    want = {}
    for k, site, text in rows:
        met = [j for j, other, same in rows if None not in (k, j, site, other, text) and j < k and other != site and same == text]
        want[k] = min([*met, *([want[k]] if want.get(k) is not None else [])], default=None)
    assert {r["id"]: r["same_as"] for r in topics.same_text(new).collect()} == want and any(want.values())


def test_no_text_is_shuffled_for_copies(spark):
    new = spark.createDataFrame([(k, k % 4, "same text " * 50) for k in range(400)], "id long, site_id long, text string")
    found = catalog._twins(new)
    assert "hashpartitioning(text" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["same_as"]) for r in found.collect()} == {(k, (None if k == 0 else 0 if k % 4 else 1 if k > 1 else None)) for k in range(400)}
