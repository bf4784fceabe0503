from framelark.streaming import neighbours


def test_excess_over_the_frame_before(spark, tmp_path):
    rows = [(f, y, 0, 10 * f * y) for f in range(4) for y in range(2)]
    schema = "f bigint, y int, x int, v int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = neighbours.excess_over_previous(stream).writeStream.format("memory").queryName("excess").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.f, r.y): r.d for r in spark.sql("SELECT * FROM excess").collect()}
    assert got == {(f, y): None if f == 0 else 10 * y for f in range(4) for y in range(2)}


def test_counts_by_window(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'gray' AS ch UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'gray'").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, ch string").parquet(str(tmp_path / "ev"))
    q = neighbours.counts_by_window(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT * FROM counts").collect()) == [1, 1]


def test_state_is_kept_between_batches_by_tile(spark, tmp_path):
    schema = "f bigint, y int, x int, v int"
    (folder := tmp_path / "in").mkdir()
    spots = [(0, 0), (0, 70), (63, 63), (64, 64), (130, 5)]
    stream = neighbours.excess_over_previous(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    want = {}
    for f in range(4):
        rows = [(f, y, x, (f * (y + 3) + x) % 50) for y, x in spots if (f + x) % 3]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        last = {}
        for g in range(f):
            last |= {(y, x): (g * (y + 3) + x) % 50 for y, x in spots if (g + x) % 3}
        want |= {(f, y, x): max(v - last[y, x], 0) if (y, x) in last else None for _, y, x, v in rows}
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    got = {(r.f, r.y, r.x): r.d for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    stream = neighbours.counts_by_window(spark.readStream.schema("ts timestamp, ch string").parquet(str(folder)))
    for number, times in enumerate((["00:10", "00:50", "01:10"], ["05:00"], ["00:20", "05:30"], ["09:00"])):
        values = ", ".join(f"(timestamp'2024-01-01 {t}:00', 'gray')" for t in times)
        spark.sql(f"SELECT * FROM VALUES {values} AS t(ts, ch)").coalesce(1).write.mode("append").parquet(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = {(r.w.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 2), (1, 1), (5, 2)}
