"""Sources and sinks in Spark's readers and writers, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSET = "id string, group_id string, tags array<string>, embedding string, sha256 string, analysis_json string, original_filename string, asset_id string"
PAIR = "query_id string, expected_asset_id string, candidate_asset_id string, similarity_score double, feature_score double, final_score double"


def assets_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Assets, a JSON object a line; the embedding may be an array or its text, rows without one are left out."""
    rows = spark.read.schema(ASSET).json(path)
    vector = F.from_json("embedding", "array<double>")
    return rows.select(F.coalesce("id", "asset_id").alias("id"), "group_id", "tags", vector.alias("embedding"), "sha256", F.try_parse_json("analysis_json").alias("analysis"), "original_filename").where("embedding IS NOT NULL")


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("header", True).csv(path)


def pairs_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("multiLine", True).json(path)


def pictures(spark: SparkSession, path: str, most_bytes: int = 20_000_000) -> DataFrame:
    """Files as rows with their bytes; larger ones are left out before they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """image_id, class and box of an annotation file with categories, images and annotations."""
    kind = "categories array<struct<id:long,name:string>>, images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>"
    whole = spark.read.schema(kind).option("multiLine", True).json(path)
    names = whole.select(F.inline("categories")).withColumnsRenamed({"id": "category_id", "name": "class"})
    b = F.col("bbox")
    rows = whole.select(F.inline("annotations")).join(names, "category_id")
    return rows.select("image_id", "class", b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric events: name, value, labels."""
    rows.select("name", F.col("value").cast("double").alias("value"), F.col("labels").cast("map<string,string>").alias("labels")).write.mode("append").parquet(path)


def append_manifest(rows: DataFrame, path: str, by: str = "job_id") -> None:
    """Jobs' items, in folders by job, so that a job is read without the others."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Queries, a JSON object a line: id (query_id, else id), expected_group_id, sha256, embedding and analysis. A line that isn't one or lacks an id or an embedding fails the job that reads it."""
    kind = "query_id string, id string, expected_group_id string, sha256 string, embedding string, analysis_json string, broken string"
    rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "broken").json(path)
    name = F.coalesce(F.nullif(F.trim("query_id"), F.lit("")), F.nullif(F.trim("id"), F.lit("")))
    vector = F.from_json("embedding", "array<double>")
    bad = F.col("broken").isNotNull() | name.isNull() | vector.isNull() | (F.size(vector) == 0)
    checked = F.when(bad, F.raise_error(F.lit("a line without a query_id or an embedding"))).otherwise(name)
    return rows.select(checked.alias("query_id"), F.nullif(F.trim("expected_group_id"), F.lit("")).alias("expected_group_id"), "sha256", vector.alias("embedding"), F.try_parse_json("analysis_json").alias("analysis"))
