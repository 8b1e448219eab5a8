"""Reading and writing the archive: raw pages, bundles, exports, content-addressed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a raw page and of an object; the longest extension.
MOST_PAGE, MOST_OBJECT, LONGEST_EXTENSION = 8 << 20, 32 << 20, 8


def table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(f"{root}/{name}.parquet")


def raw_pages(spark: SparkSession, pages: DataFrame, root: str, fallback: str | None = None) -> DataFrame:
    """pages with body for those whose file exists and isn't too large; the second root serves files that the first lacks."""

    def files(base: str) -> DataFrame:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= MOST_PAGE)
        return f.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("__p"), F.col("content").alias("body"))

    own = files(root)
    if fallback:
        own = own.unionByName(files(fallback).join(own.select("__p"), "__p", "left_anti"))
    return pages.join(own, F.regexp_extract("raw_path", r"([^/]+/[^/]+)$", 1) == F.col("__p")).drop("__p")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Article bundles (JSON); corrupt files give nulls instead of failing the read."""
    return spark.read.option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def bundle_rows(articles: DataFrame, images: DataFrame) -> DataFrame:
    """(archive_key, bundle): the JSON of each article with its images in order."""
    img = images.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("image_url", "alt"))).alias("images"))
    keep = [c for c in articles.columns if c != "body_html"]
    return articles.join(img, "url", "left").select(F.sha2("url", 256).alias("archive_key"), F.to_json(F.struct(*keep, F.coalesce("images", F.array().cast("array<struct<image_url:string,alt:string>>")).alias("images"))).alias("bundle"))


def write_bundles(articles: DataFrame, images: DataFrame, path: str) -> None:
    """Bundles by key prefix; the writer's commit makes them appear at once."""
    bundle_rows(articles, images).withColumn("prefix", F.substring("archive_key", 1, 2)).write.mode("overwrite").partitionBy("prefix").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def content_addressed(files: DataFrame, body: str = "body", url: str = "url", mime: str = "content_type") -> DataFrame:
    """(sha256, extension, size, body), each content once; the extension is the path's or the type's, '.bin' if longer than 8."""
    by_path = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))
    by_type = F.concat(F.lit("."), F.regexp_extract(F.lower(mime), r"^[a-z]+/(?:x-)?([a-z0-9]+)", 1))
    ext = F.when(by_path != "", by_path).when(by_type != ".", by_type).otherwise(".bin")
    rows = files.where(F.octet_length(body) <= MOST_OBJECT).select(F.sha2(body, 256).alias("sha256"), F.when(F.length(ext) <= LONGEST_EXTENSION, ext).otherwise(".bin").alias("extension"), F.octet_length(body).cast("long").alias("size"), F.col(body).alias("body"))
    return rows.dropDuplicates(["sha256"])


def write_objects(files: DataFrame, path: str, **columns) -> None:
    content_addressed(files, **columns).withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(path)


def digest_conflicts(objects: DataFrame) -> DataFrame:
    """Digests recorded with more than one size."""
    return objects.groupBy("sha256").agg(F.count_distinct("size").alias("sizes")).where("sizes > 1")
