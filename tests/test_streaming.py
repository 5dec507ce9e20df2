from lociframe.streaming.metric_log import watch


def test_best_epoch_of_a_stream(spark, tmp_path):
    rows = [("r", "f", e, v) for e, v in enumerate([5.0, 4.0, 4.5, 4.4, 3.0], 1)]
    spark.createDataFrame(rows, "run string, fold string, epoch int, loss double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, fold string, epoch int, loss double").parquet(str(tmp_path / "in"))
    q = watch(stream, patience=2).writeStream.format("memory").queryName("watched").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select * from watched").collect()]
    assert got == [("r", "f", 2, 4.0, True)]
