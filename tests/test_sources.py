"""Archives that are whole or not there, and pages read in ranges."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from prismatic.functions.text import archive_name
from prismatic.sources.archives import members, write_archives
from prismatic.sources.paged import paged


def test_archives_by_value(spark, tmp_path):
    rows = [(f"job{k % 3}", f"{k:03d}_é.jpg", bytearray(f"content {k}".encode())) for k in range(40)] + [("job0", "empty", None), (None, "lost", bytearray(b"x")), ("job9", None, bytearray(b"x"))]
    frame = spark.createDataFrame(rows, "archive string, name string, content binary").repartition(7)
    write_archives(frame, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["job0.zip", "job1.zip", "job2.zip"]
    archive = zipfile.ZipFile(tmp_path / "out" / "job0.zip")
    assert archive.testzip() is None and archive.namelist() == sorted([f"{k:03d}_é.jpg" for k in range(0, 40, 3)] + ["empty"])
    assert archive.read("003_é.jpg") == b"content 3" and archive.read("empty") == b""
    assert members(spark, str(tmp_path / "out")).groupBy("archive").count().orderBy("archive").collect()[0]["count"] == 15
    first = (tmp_path / "out" / "job1.zip").read_bytes()
    with pytest.raises(Exception, match="job"):  # they are there
        write_archives(frame, str(tmp_path / "out"))
    write_archives(frame, str(tmp_path / "out"), mode="overwrite")
    assert (tmp_path / "out" / "job1.zip").read_bytes() == first and sorted(os.listdir(tmp_path / "out")) == ["job0.zip", "job1.zip", "job2.zip"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = [(f"job{k}", "a", bytearray(b"1")) for k in range(8)]
    frame = spark.createDataFrame([*good, ("job8", "same", bytearray(b"1")), ("job8", "same", bytearray(b"2"))], "archive string, name string, content binary")
    with pytest.raises(Exception, match="two members"):
        write_archives(frame, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []

    broken = spark.createDataFrame(good, "archive string, name string, content binary").withColumn("content", F.when(F.col("archive") == "job5", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        write_archives(broken, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_names_beyond_999_differ(spark):
    frame = spark.range(998, 1003).select(archive_name(F.col("id"), F.lit("a/b\\pic.png"), F.lit("x")).alias("name"))
    assert [r["name"] for r in frame.collect()] == [f"{k:03d}_pic.jpg" for k in range(998, 1003)]


def pages(folder, items, limit):
    folder.mkdir(exist_ok=True)
    for k in range(0, max(len(items), 1), limit):
        (folder / f"page-{k}.json").write_text(json.dumps({"total": len(items), "items": items[k : k + limit]}, ensure_ascii=False))


def test_pages_in_ranges(spark, tmp_path):
    items = [{"id": k, "name": f"né{k}"} for k in range(47)]
    pages(tmp_path / "p", items, 5)
    frame = paged(spark, f"{tmp_path}/p/page-{{offset}}.json", limit=5, pages_per_task=3)
    assert frame.rdd.getNumPartitions() == 4
    found = sorted((r["position"], json.loads(r["item"])) for r in frame.collect())
    assert found == list(enumerate(items))
    pages(tmp_path / "none", [], 5)
    assert paged(spark, f"{tmp_path}/none/page-{{offset}}.json", limit=5).isEmpty()
    (tmp_path / "p" / "page-20.json").write_text(json.dumps({"total": 47, "items": items[20:22]}))
    with pytest.raises(Exception, match="2 items at 20"):
        frame.collect()


def test_a_stream_of_pages_goes_on_where_it_was(spark, tmp_path):
    items = [{"id": k} for k in range(30)]

    def run():
        stream = paged(spark, f"{tmp_path}/p/page-{{offset}}.json", limit=4, pages_per_task=2, stream=True)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["position"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    pages(tmp_path / "p", items[:13], 4)
    assert run() == list(range(13))
    pages(tmp_path / "p", items, 4)
    assert run() == list(range(30)) and run() == list(range(30))
