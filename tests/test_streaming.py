from sitetide.streaming import changes


def run(spark, stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_page_changes_keep_the_state_between_batches(spark, tmp_path):
    folder = f"{tmp_path}/versions"
    first = [(1, "a", "2024-01-01 00:00:00", "x", False), (1, "b", "2024-01-01 00:00:00", "y", False), (1, "a", "2024-01-02 00:00:00", "x", False)]
    again = [(1, "a", "2024-01-03 00:00:00", "z", False), (1, "b", "2024-01-03 00:00:00", None, True), (1, "a", "2023-12-01 00:00:00", "old", False)]
    for k, rows in enumerate((first, again)):
        made = spark.createDataFrame(rows, "site_id long, url string, at string, content_hash string, is_removed boolean")
        made = made.selectExpr("site_id", "url", "cast(at as timestamp) fetched_at", "content_hash", "is_removed")
        made.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(changes.VERSION).parquet(folder)
        found = run(spark, changes.page_changes(stream), f"changes{k}", tmp_path)
    assert {(r["url"], r["change_type"]) for r in found} == {("a", "new"), ("b", "new"), ("a", "changed"), ("b", "removed")}


def test_weekly_counts_start_on_monday(spark, tmp_path):
    rows = spark.sql("select 1L site_id, 'new' change_type, cast(d as timestamp) detected_at from values ('2024-01-01'), ('2024-01-07 23:59:59'), ('2024-01-08') t(d)")
    rows.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    found = run(spark, changes.weekly_counts(stream), "weeks", tmp_path, "complete")
    assert {(str(r["window"]["start"]), r["n"]) for r in found} == {("2024-01-01 00:00:00", 2), ("2024-01-08 00:00:00", 1)}


def test_trailing_counts_and_first_fetches(spark, tmp_path):
    rows = spark.sql("select 1L site_id, 'new' change_type, cast(d as timestamp) detected_at from values ('2024-01-01'), ('2024-01-05'), ('2024-01-09') t(d)")
    rows.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    found = {str(r["window"]["end"])[:10]: r["n"] for r in run(spark, changes.trailing_counts(stream), "trailing", tmp_path, "complete")}
    assert found["2024-01-02"] == 1 and found["2024-01-06"] == found["2024-01-08"] == 2 and found["2024-01-10"] == 2 and found["2024-01-16"] == 1
    pages = spark.sql("select 1L site_id, u url, cast(d as timestamp) fetched_at from values ('a', '2024-01-01 00:00:00'), ('a', '2024-01-01 05:00:00'), ('b', '2024-01-01 05:00:00') t(u, d)")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    stream = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/pages")
    assert sorted(r["url"] for r in run(spark, changes.first_fetches(stream), "first", tmp_path)) == ["a", "b"]
