from pyspark.sql import functions as F

from framelark.plans.batchrun import run_batches


def test_batches_are_written_in_turn_and_a_stopped_run_goes_on(spark, tmp_path):
    files = spark.range(45).select(F.col("id").alias("frame_idx"), F.concat(F.lit("p"), F.col("id")).alias("path"))
    seen, asked = [], iter([False, True])

    def work(rows):
        seen.append(rows.count())
        return rows.where("is_core").select("path", "frame_idx")

    out = str(tmp_path / "out")
    assert run_batches(files, work, out, stop=lambda: next(asked)) == 1 and seen == [21]
    assert run_batches(files, work, out) == 2 and seen == [21, 22, 6]
    assert run_batches(files, work, out) == 0
    back = spark.read.parquet(out)
    assert back.count() == 45 and {(r.batch, r.n) for r in back.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(0, 20), (1, 20), (2, 5)}
    assert run_batches(files.limit(0), work, str(tmp_path / "none")) == 0
