from pagemill.sources.pdf import page_rows
from pagemill.streaming.arrivals import arriving_files
from test_converter import FakeReader


def test_arriving_files_become_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")

    def keep(batch, number):
        page_rows(batch, FakeReader()).select("doc_id", "page_number").write.mode("append").parquet(str(tmp_path / "out"))

    stream = arriving_files(spark, str(tmp_path / "in")).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state"))
    stream.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"].rpartition("/")[2], r["page_number"]) for r in got) == [("a.pdf", 0), ("a.pdf", 1)]
