"""The last stage of the pipeline holds a few megabytes of text at a time."""

import corpus_pipeline
from sitetide.llm import bpe


def test_last_stage_cuts_texts_into_small_chunks(spark, monkeypatch):
    made, chunks = [], bpe.chunks

    def kept(*given):
        made.append(chunks(*given))
        return made[-1]

    monkeypatch.setattr(bpe, "chunks", kept)
    docs = spark.range(0, 220, 1, 1).selectExpr("id as doc_id", "'en' as lang", "repeat(concat('word', id, ' of it. '), 4000) as text")
    got = corpus_pipeline.encode(spark, docs, None)
    assert got.count() == 220 and made[0].filter("bucket < 0").select("chunk").distinct().count() >= 3
    text, ids = docs.filter("doc_id = 7").first()["text"], got.filter("doc_id = 7").first()["ids"]
    assert ids == bpe.load(bpe.vocabulary_path()).encode(text, add_special_tokens=False).ids
