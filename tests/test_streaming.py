from datetime import datetime

from redpen.streaming.clean import clean_stream


def test_clean_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, i), s) for i, s in enumerate(["Das ist ein Satz mit vielen guten Worten.", "das  ist ein Satz mit vielen guten Worten.", "Das ist ein Satz mit vielen guten Worten.", "Zu kurz."])]
    spark.createDataFrame(rows, "ts timestamp, sentence string").write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema("ts timestamp, sentence string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("clean_out").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("clean_out").count() == 1
