"""What a similarity join writes grows with the texts, not with the pairs that were looked at."""

from sitetide.operators import similarity


def test_join_writes_no_pairs_that_fall_short(spark, monkeypatch):
    rows = [(k, 0, None, " ".join([*[f"common{j}" for j in range(3)], *[f"own{k}word{j}" for j in range(4)]])) for k in range(300)]
    written, sizes = similarity.written, {}

    def counted(df, label, *more):
        made = written(df, label, *more)
        sizes[label] = made.count()
        return made

    monkeypatch.setattr(similarity, "written", counted)
    monkeypatch.setattr(similarity, "PACK", 64)
    _, pairs = similarity.similarity_join(spark.createDataFrame(rows, "id long, site_id long, title string, text string"), 0.7)
    assert pairs.count() == 0 and "packs" in sizes and max(sizes.values()) <= 300


def test_similar_documents_make_their_pairs_once(spark, small_tables="/root/testdata/sf0.001"):
    from sitetide.plans import catalog

    plan = catalog.queries()["similar_documents"](spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_lists_of_a_pack_are_squeezed(spark):
    rows = [(k, None, f"words of page own{k} other{k % 7}") for k in range(100)]
    packs = similarity.index(spark.createDataFrame(rows, "id long, title string, text string")).packs
    assert {packs.schema[c].dataType.simpleString() for c in ("at", "codes", "tfs", "ranks", "idfs")} == {"binary"}
    assert packs.selectExpr("sum(size(ids))").first()[0] == 100
