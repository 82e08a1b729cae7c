from scholia.streaming.scan_stream import counts_by_window, scan_stream

SCHEMA = "path string, content string, committed_at timestamp"


def test_files_are_scanned_as_they_arrive(spark, tmp_path):
    spark.sql("select 'a.go' path, '// TODO: x\n// FIXME: y\n' content, timestamp '2024-01-01 01:00:00' committed_at").write.parquet(str(tmp_path / "in"))
    tasks = scan_stream(spark, str(tmp_path / "in"), SCHEMA, ("committed_at",))
    query = counts_by_window(tasks).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.type, r.n) for r in spark.table("counted").collect()) == [("FIXME", 1), ("TODO", 1)]
