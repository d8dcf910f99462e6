import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from sitetide.llm import bpe, pii, sharding, token_output, toxicity
from sitetide.session import drop_scratch, scratch_dir, table
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_simhash import jaccard_groups


def test_run_equals_a_plain_version(spark, small):
    """Toxicity by the operator's own model; the other stages by comparing all pairs, plain windows and the library."""
    docs = table(spark, small, "documents")
    model = toxicity.train(docs, table(spark, small, "labels"))
    clean = [(r["doc_id"], r["text"]) for r in toxicity.score(docs, model).filter("predicted = 0").orderBy("doc_id").collect()]
    least = jaccard_groups(clean, corpus_pipeline.SHINGLE)
    clean = [(i, t) for (i, t), first in zip(clean, least, strict=True) if i == first]
    found = leaks(clean, [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()])
    clean = [(i, t) for i, t in clean if not found[i][1]]
    anchors, tokenizer, want = pii._anchors(), bpe.load(bpe.vocabulary_path()), {}
    for i, t in clean:
        for kind, s, e, _ in reversed(pii.spans_of(t, anchors)):
            t = t[:s] + f"[{kind.upper()}]" + t[e:]
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (ids, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, docs, rows, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and 0 < out.count() <= len(rows)
        assert stage(spark, docs.limit(0), small).count() == 0
    names = ("score", "predicted", "hit", "ids", "n_words", "spans", "fp", "kept_id", "_nth", "_toxic", "n_tokens", "ids_sha256", "chunk", "bucket")
    wide = docs.drop("n_chars").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, small)
        assert out.columns == wide.columns and {tuple(r)[4:] for r in out.collect()} == {tuple(range(len(names)))}
    assert corpus_pipeline.STAGES[-1][1](spark, wide, small).count() == len(rows)


def test_near_copies_equal_all_pairs_by_jaccard(spark, small):
    """One of each group at a true Jaccard index of 0.8 or more stays."""
    docs = table(spark, small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = set(jaccard_groups(rows, corpus_pipeline.SHINGLE))
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    assert got == want


def test_last_stage_without_further_columns(spark, docs, rows, small):
    out = corpus_pipeline.encode(spark, docs.select("doc_id", "text"), small)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == len(rows)


def test_nothing_is_left_behind(spark, small):
    """After ``drop_scratch`` the shared folder and the catalog hold nothing of the pipeline, op2, op5 or op9."""
    assert corpus_pipeline.run(spark, small).count() > 0
    for query in (token_output.op2_orc_tokens, bpe.op5_word_table_bpe, sharding.op9_virtual_slots):
        assert query(spark, small).count() > 0
    drop_scratch(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    left = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    own = (spark.sparkContext.getCheckpointDir() or "").rsplit("/", 1)[-1]  # Spark makes this one when it starts
    assert [n for f in left if (n := f.getPath().getName()) != own] == [] and spark.catalog.listTables() == []
