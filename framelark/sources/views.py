"""Views that give general tables the shapes of frame sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _level(e):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.55) * 230))).cast("int")


def px(spark: SparkSession, folder: str) -> DataFrame:
    """``(f, y, x, v)``: each vector is a frame of 8 x 8 samples of 0 to 255."""
    cells = table(spark, folder, "embeddings").select(F.col("vec_id").alias("f"), F.posexplode("embedding").alias("i", "e"))
    return cells.select("f", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), _level(F.col("e")).alias("v"))


def bgr(spark: SparkSession, folder: str) -> DataFrame:
    """``(f, y, x, b, g, r)``: the same samples as 4 x 4 pixels of four channels, the last unused."""
    pixels = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("f"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")
    )
    channel = lambda c: _level(F.element_at("embedding", F.col("p") * 4 + c + 1))
    return pixels.select(
        "f",
        F.expr("p div 4").cast("int").alias("y"),
        (F.col("p") % 4).alias("x"),
        channel(0).alias("b"),
        channel(1).alias("g"),
        channel(2).alias("r"),
    )


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """``(f, event_id, x, y, ch)``: events as point observations, an hour to a frame."""
    e = table(spark, folder, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473352
    return e.select(
        hour.cast("bigint").alias("f"),
        "event_id",
        (F.col("user_id") * 4).cast("int").alias("x"),
        F.floor("value").cast("int").alias("y"),
        F.when(F.col("event_type").isin("error", "purchase"), "color").otherwise("gray").alias("ch"),
    )


def det(spark: SparkSession, folder: str) -> DataFrame:
    """``(f, det_id, x0, y0, x1, y1, s)``: line items as scored boxes, an order to a frame."""
    li = table(spark, folder, "lineitem")
    x0, y0, q = (F.col("l_partkey") % 300).cast("int"), (F.col("l_suppkey") % 60).cast("int"), F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_orderkey").alias("f"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("det_id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 40 + 4 * q).alias("x1"),
        (y0 + 30 + q).alias("y1"),
        F.col("l_extendedprice").alias("s"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``(stem, ext, path, w, h, doc_id)``: documents as a directory listing."""
    d = table(spark, folder, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "tif", "png", "TIFF", "txt"))), (F.col("doc_id") * 7 % 5 + 1).cast("int"))
    stem = F.concat(F.lit("IMG_"), F.expr("doc_id div 2").cast("string"))
    small = F.col("doc_id") % 7 == 0
    return d.select(
        stem.alias("stem"),
        ext.alias("ext"),
        F.concat(stem, F.lit("."), ext).alias("path"),
        F.when(small, 3712).otherwise(5568).alias("w"),
        F.when(small, 2475).otherwise(3712).alias("h"),
        "doc_id",
    )
