import hashlib
import zlib

import numpy as np
import pytest

from sitetide.llm import bpe, token_output


@pytest.fixture(scope="module")
def model():
    return bpe.load(bpe.vocabulary_path())


@pytest.mark.parametrize("chunk", [1, 200, bpe.CHUNK_BYTES])
def test_encoding_and_decoding_equal_the_library(docs, rows, model, chunk):
    """With a chunk for each batch up to one for all rows; columns pass through."""
    got = bpe.decode(bpe.encode(docs, chunk=chunk)).collect()
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])) for r in got)
    for r in got:
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == model.decode(ids, skip_special_tokens=False)


def test_word_table_counts_all_words(docs, rows):
    table = {r["word"]: r["n"] for r in bpe.word_table(docs).collect()}
    assert sum(table.values()) == sum(len((t or "").encode().split()) for _, t, *_ in rows)


def test_query_equals_the_library(spark, small, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.op5_word_table_bpe(spark, small).collect():
        ids = model.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digests_equal_the_parts(docs, model):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, chunk=300).collect())
    want = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids
        text = model.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table_and_clashing_columns(empty, docs):
    assert bpe.decode(bpe.encode(empty)).count() == 0
    again = bpe.encode(bpe.encode(docs))
    assert again.columns.count("ids") == 1


def test_orc_round_trip(spark, small, model):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in token_output.op2_orc_tokens(spark, small).collect()}
    start = 0
    for doc_id, text in texts:
        ids = [*model.encode(text, add_special_tokens=False).ids, token_output.END_ID]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_orc_of_odd_rows(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/a"
    token_output.write_tokens(docs, path)
    got = token_output.with_starts(token_output.read_tokens(spark, path).selectExpr("*", "cast(size(ids) as long) n_tokens")).orderBy("part", "seq").collect()
    assert len(got) == len(rows) and got[0]["doc_id"] is None
    assert [r["doc_id"] for r in got[1:]] == sorted(i for i, *_ in rows if i is not None)
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"][-1] == token_output.END_ID
        at += r["n_tokens"]
    assert [r["doc_id"] for r in token_output.read_tokens(spark, path, [5]).collect()] == [5]
    token_output.write_tokens(empty, f"file://{tmp_path}/b")
    assert token_output.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_reads_are_pruned_by_row_indexes_and_bloom_filters(spark, tmp_path):
    """A scan for one id gives the rows of one index stride at most; for an absent id between others, none at all."""
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('word ', id) AS text", "1 AS part", "'x' AS ids")
    path = f"file://{tmp_path}/pruned"
    token_output.write_tokens(docs, path)

    def scanned(ids):
        rows = token_output.read_tokens(spark, path, ids)
        found = sorted(r["doc_id"] for r in rows.collect())
        leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numOutputRows").value()

    found, n = scanned([20_002])
    assert found == [20_002] and n <= int(token_output.ORC["orc.row.index.stride"])
    found, n = scanned([20_003])
    assert found == [] and n <= 0.1 * 20_000  # statistics alone would give a whole stride of each file's range
    assert token_output.read_tokens(spark, path).count() == 20_000
